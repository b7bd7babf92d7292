"""Literal cases of accuracy scoring."""

from quarry.operators.scoring import case_scores, macro_means, score_accuracy

CASE = "case string, cell string, capability string, kind string, positive boolean, resolution string, targets array<string>, reason string, valid boolean, diagnostics array<string>, must_not_resolve boolean"
RECORD = "case string, cell string, seq long, resolution string, targets array<string>, reason string, valid boolean, diagnostics array<string>"
R = "STATIC_RESOLVED"


def score(spark, cases, records):
    return spark.createDataFrame(cases, CASE), spark.createDataFrame(records, RECORD)


def reference(case, resolution=R, targets=(), reason=None, strict=False, capability="C"):
    return (case, "x", capability, "REFERENCE", True, resolution, list(targets), reason, None, None, strict)


def claim(case, seq, resolution=R, targets=(), reason=None, valid=None, diagnostics=None, cell="x"):
    return (case, cell, seq, resolution, list(targets), reason, valid, diagnostics)


def counts(spark, cases, records, *names):
    return {r["case"]: tuple(r[n] for n in names) for r in case_scores(*score(spark, cases, records)).collect()}


def test_references(spark):
    cases = [reference("hit", targets=["b", "a"]), reference("twice", targets=["a", "b"]), reference("part", targets=["a", "b"]), reference("silent", targets=["a"]), reference("guess", "INFERRED", ["a"])]
    records = [claim("hit", 1, targets=["a", "b"]), *[claim("twice", i, targets=["b", "a"]) for i in (1, 2, 3)], claim("part", 1, targets=["a"]), claim("guess", 1, R, ["a"]), claim("guess", 2, "INFERRED", ["a"])]
    got = counts(spark, cases, records, "tp", "fp", "fn", "duplicates", "false_resolved")
    assert got == {"hit": (1, 0, 0, 0, 0), "twice": (1, 4, 0, 2, 0), "part": (0, 1, 2, 0, 0), "silent": (0, 0, 1, 0, 0), "guess": (1, 1, 0, 0, 1)}


def test_abstentions(spark):
    cases = [reference(c, "UNRESOLVED", reason="DYNAMIC") for c in ("kept", "repeated", "other", "resolved", "silent")] + [reference("open", targets=["a"])]
    records = [claim("kept", 1, "UNRESOLVED", reason="DYNAMIC"), *[claim("repeated", i, "UNRESOLVED", reason="DYNAMIC") for i in (1, 2)], claim("other", 1, "UNRESOLVED", reason="ELSE"), claim("resolved", 1, R, ["z"])]
    records += [claim("open", i, "UNRESOLVED", reason=r) for i, r in enumerate(["P", "P", "Q", None])]
    got = counts(spark, cases, records, "fp", "fn", "false_resolved", "reasons")
    missing = ["ABSTENTION_MISSING"]
    assert got == {"kept": (0, 0, 0, []), "repeated": (1, 0, 0, []), "other": (1, 0, 0, missing), "resolved": (1, 0, 1, missing), "silent": (0, 0, 0, missing), "open": (1, 1, 0, [])}


def test_candidate_sets(spark):
    cases = [(c, "x", "C", "CANDIDATES", True, "CANDIDATES", ["a", "b", "c"], None, None, None, None) for c in ("exact", "some", "other", "none", "two")]
    records = [claim("exact", 1, "CANDIDATES", ["c", "a", "b"]), claim("some", 1, "CANDIDATES", ["a", "z", "a"]), claim("other", 1, R, ["a", "b", "c"]), claim("two", 2, "CANDIDATES", ["a", "q"]), claim("two", 1, "CANDIDATES", ["a", "b", "c"])]
    got = counts(spark, cases, records, "candidate_tp", "candidate_fp", "candidate_fn", "exact_candidate_cases", "candidate_case_precision", "reasons")
    assert got == {"exact": (3, 0, 0, 1, 1.0, []), "some": (1, 1, 2, 0, 0.5, []), "other": (3, 0, 0, 0, 1.0, []), "none": (0, 0, 3, 0, None, []), "two": (3, 2, 0, 1, 1.0, ["DUPLICATE_CANDIDATE_SET"])}


def test_parsers_and_cells(spark):
    parser = lambda c, valid, errors=None: (c, "p", "P", "PARSER", valid, R, None, None, valid, errors, None)
    cases = [parser("good", True), parser("bad", False, ["E1", "E2"]), parser("lost", True), parser("late", False, ["E1"]), reference("s", targets=["a"], capability="S")]
    records = [claim("good", 1, valid=True, cell="p"), claim("good", 2, valid=True, cell="p"), claim("bad", 1, valid=False, diagnostics=["E2", "E9", "E1"], cell="p"), claim("late", 1, valid=False, cell="p")]
    records += [claim("s", 1, targets=["a"]), claim("unknown", 1, cell="new"), claim(None, 1, cell="new")]
    table = score_accuracy(*score(spark, cases, records))
    got = {r.cell: r for r in table.collect()}
    p = got["p"]
    assert (p.tp, p.fp, p.fn, p.valid_files, p.valid_succeeded, p.invalid_files, p.invalid_diagnosed, p.duplicates) == (1, 1, 1, 2, 1, 2, 1, 1)
    assert p.failure_codes == "DUPLICATE_PARSER_RESULT,INVALID_DIAGNOSTIC_MISSING,PARSE_SUCCESS_BELOW_THRESHOLD"
    assert (got["x"].precision, got["x"].recall, got["x"].failure_codes) == (1.0, 1.0, "")
    assert (got["new"].unmatched, got["new"].capability, got["new"].precision, got["new"].failure_codes) == (2, None, None, "ANNOTATION_REVIEW_REQUIRED")
    assert tuple(macro_means(table).first()) == (3, 2, 0.75, 0.75)


def test_nothing_is_null_not_zero_and_thresholds_are_the_callers(spark):
    cases, records = score(spark, [reference("s", targets=["a"])], [])
    r = score_accuracy(cases, records).first()
    assert (r.precision, r.precision_lower, r.recall, r.failure_codes) == (None, None, 0.0, "RECALL_BELOW_THRESHOLD")
    assert score_accuracy(cases, records, {"recall": 0.0}).first().failure_codes == ""
    assert score_accuracy(cases.limit(0), records).count() == 0
