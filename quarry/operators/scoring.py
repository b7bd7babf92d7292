"""Accuracy of claims against judged cases: resolved references, candidate sets, parser results and abstentions, per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import wilson_lower

#: Least shares, and the claims from which on the lower bound is asked for.
THRESHOLDS = {
    "valid_file_success": 0.99, "invalid_diagnostic_recall": 1.0, "symbol_precision": 0.99, "symbol_recall": 0.95, "precision": 0.99, "recall": 0.9,
    "wilson": 0.95, "wilson_least": 200, "candidate_precision": 0.9, "candidate_recall": 0.9, "candidate_exact": 0.85,
}
#: What a case may expect instead of a resolved reference; the first two expect no target at all.
ABSTAIN = ("UNRESOLVED", "UNSUPPORTED")
NOT_RESOLVED = (*ABSTAIN, "INFERRED")
RESOLVED = "STATIC_RESOLVED"
CLAIM = ("resolution", "targets", "reason", "valid", "diagnostics")
COUNTS = (
    "positive_cases negative_cases tp fp fn duplicates false_resolved valid_files valid_succeeded invalid_files invalid_diagnosed "
    "candidate_tp candidate_fp candidate_fn candidate_cases exact_candidate_cases unmatched"
).split()


def _ratio(a: Column | str, b: Column) -> Column:
    return (F.col(a) if isinstance(a, str) else a) / F.nullif(b, F.lit(0))


def _sorted(c: str) -> Column:
    return F.array_sort(F.coalesce(c, F.array().cast("array<string>")))


def case_scores(cases: DataFrame, records: DataFrame) -> DataFrame:
    """The counts of each case and its failure codes (an array), and a row for the claims of each unknown case.

    cases: case (unique), cell, capability (P, S or other), kind (PARSER, CANDIDATES or other), positive, resolution, targets, reason, valid, diagnostics,
    must_not_resolve. records: case, cell, seq, and the same five of the claim. Targets are sets written in any order; null lists are empty, null flags false.
    Equal claims of a case are added up before anything is joined, so a case claimed very often costs one row a different claim."""
    claims = records.select("case", F.col("cell").alias("_cell"), "seq", *[_sorted(c).alias(c) if c in ("targets", "diagnostics") else c for c in CLAIM])
    claims = claims.groupBy("case", "_cell", *CLAIM).agg(F.count("*").alias("_n"), F.min("seq").alias("_seq"))
    claims = claims.select("case", "_cell", "_n", "_seq", *[F.col(c).alias(f"_{c}") for c in CLAIM])
    own = ("cell", "capability", "kind", "positive", "resolution", "targets", "reason", "valid", "diagnostics", "must_not_resolve")
    flags = ("positive", "valid", "must_not_resolve")
    form = lambda c: _sorted(c).alias(c) if c in ("targets", "diagnostics") else F.coalesce(c, F.lit(False)).alias(c) if c in flags else F.col(c)
    known = cases.select("case", *map(form, own), F.lit(True).alias("known"))
    j = known.join(claims, "case", "full").withColumn("cell", F.coalesce("cell", "_cell"))
    size = F.size("_targets")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0))
    same = (F.col("_resolution") == F.col("resolution")) & F.col("_reason").eqNullSafe(F.col("reason"))
    c = j.groupBy("case", *own, "known").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.count("_n").alias("different"),
        F.min(F.when(F.col("_n").isNotNull(), F.struct("_seq", "_resolution", "_targets", "_valid", "_diagnostics"))).alias("first"),
        count(F.col("_resolution") == RESOLVED).alias("resolved"),
        count(size == 0).alias("empty"),
        F.size(F.collect_set(F.when(size == 0, F.struct("_resolution", "_reason")))).alias("empty_kinds"),
        count((size == 0) & same).alias("abstained"),
        count((size > 0) & (F.col("_resolution") == F.col("resolution")) & (F.col("_targets") == F.col("targets"))).alias("correct"),
        F.coalesce(F.sum(F.col("_n") * size), F.lit(0)).alias("named"),
    )
    ok = F.coalesce("known", F.lit(False))
    parser, candidates = F.col("kind") == "PARSER", F.col("kind") == "CANDIDATES"
    plain = ok & ~parser & ~candidates
    abstain = F.col("resolution").isin(*ABSTAIN)
    first, none = F.col("first"), F.array().cast("array<string>")
    got, wanted = F.array_distinct(F.coalesce(first["_targets"], none)), F.array_distinct("targets")
    hit = F.size(F.array_intersect(got, wanted))
    told = F.coalesce(first["_valid"], F.lit(False))
    refused = F.coalesce(~first["_valid"], F.lit(False)) & (F.size(F.array_except("diagnostics", F.coalesce(first["_diagnostics"], none))) == 0)
    one = lambda test: F.coalesce(F.when(test, 1), F.lit(0)).cast("long")
    matched = one(F.col("correct") > 0)
    fp_plain = F.col("named") - matched * F.size("targets") + F.when(abstain, F.col("empty") - F.least("abstained", F.lit(1))).otherwise(F.col("empty") - F.col("empty_kinds"))
    resolves = F.col("must_not_resolve") | F.col("resolution").isin(*NOT_RESOLVED)
    missing = abstain & ~parser & (F.col("abstained") == 0)
    more = F.col("n") > 1
    value = {
        "positive_cases": one(ok & F.col("positive")),
        "negative_cases": one(ok & ~F.col("positive")),
        "tp": F.when(parser, one(F.col("valid") & told)).when(plain, matched),
        "fp": F.when(parser, F.greatest(F.col("n") - 1, F.lit(0))).when(plain, fp_plain),
        "fn": F.when(parser, one(F.col("valid") & ~told)).when(plain, (1 - matched) * F.size("targets")),
        "duplicates": F.when(ok, F.col("n") - F.col("different")),
        "false_resolved": F.when(ok & resolves, F.col("resolved")),
        "valid_files": one(parser & F.col("valid")),
        "valid_succeeded": one(parser & F.col("valid") & told),
        "invalid_files": one(parser & ~F.col("valid")),
        "invalid_diagnosed": one(parser & ~F.col("valid") & refused),
        "candidate_tp": F.when(candidates, hit),
        "candidate_fp": F.when(candidates, F.size(got) - hit + F.col("named") - F.size(F.coalesce(first["_targets"], none))),
        "candidate_fn": F.when(candidates, F.size(wanted) - hit),
        "candidate_cases": one(candidates),
        "exact_candidate_cases": one(candidates & (F.size(got) == hit) & (F.size(wanted) == hit) & (first["_resolution"] == F.col("resolution"))),
        "unmatched": F.when(~ok, F.col("n")),
    }
    codes = {
        "DUPLICATE_PARSER_RESULT": parser & more,
        "INVALID_DIAGNOSTIC_MISSING": parser & ~F.col("valid") & ~refused,
        "ABSTENTION_MISSING": missing,
        "DUPLICATE_CANDIDATE_SET": candidates & more,
    }
    return c.select(
        "case", "cell", "capability", *[F.coalesce(value[k], F.lit(0)).cast("long").alias(k) for k in COUNTS],
        F.when(candidates, _ratio(hit, F.size(got))).alias("candidate_case_precision"),
        F.when(candidates, _ratio(hit, F.size(wanted))).alias("candidate_case_recall"),
        F.array_compact(F.array(*[F.when(ok & test, code) for code, test in codes.items()])).alias("reasons"),
    )


def score_accuracy(cases: DataFrame, records: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Per cell its counts, micro shares and their lower bound, means over candidate cases, and failure_codes (sorted, comma-joined). A share of
    nothing is null and fails no threshold. A cell that only claims name has no capability."""
    t = THRESHOLDS | (thresholds or {})
    scored = case_scores(cases, records)
    # A cell's codes are four at most, so the set is small.
    g = scored.groupBy("cell").agg(
        F.max("capability").alias("capability"), *[F.sum(k).alias(k) for k in COUNTS],
        F.avg("candidate_case_precision").alias("candidate_macro_precision"), F.avg("candidate_case_recall").alias("candidate_macro_recall"),
        *[F.bool_or(F.array_contains("reasons", code)).alias(code) for code in ("DUPLICATE_PARSER_RESULT", "INVALID_DIAGNOSTIC_MISSING", "ABSTENTION_MISSING", "DUPLICATE_CANDIDATE_SET")],
    )
    claimed, found = F.col("tp") + F.col("fp"), F.col("candidate_tp") + F.col("candidate_fp")
    g = g.withColumns({
        "precision": _ratio("tp", claimed),
        "recall": _ratio("tp", F.col("tp") + F.col("fn")),
        "precision_lower": wilson_lower(F.col("tp"), claimed, 1.96),
        "valid_file_success": _ratio("valid_succeeded", F.col("valid_files")),
        "invalid_diagnostic_recall": _ratio("invalid_diagnosed", F.col("invalid_files")),
        "candidate_precision": _ratio("candidate_tp", found),
        "candidate_recall": _ratio("candidate_tp", F.col("candidate_tp") + F.col("candidate_fn")),
        "candidate_exact": _ratio("exact_candidate_cases", F.col("candidate_cases")),
    })
    kind = F.coalesce("capability", F.lit(""))
    parse, symbol = kind == "P", kind == "S"
    below = lambda c, least: F.col(c) < F.lit(t[least])
    tests = [(code, F.col(code)) for code in ("DUPLICATE_PARSER_RESULT", "ABSTENTION_MISSING", "DUPLICATE_CANDIDATE_SET")] + [
        ("PARSE_SUCCESS_BELOW_THRESHOLD", parse & below("valid_file_success", "valid_file_success")),
        ("INVALID_DIAGNOSTIC_MISSING", F.col("INVALID_DIAGNOSTIC_MISSING") | parse & F.coalesce(below("invalid_diagnostic_recall", "invalid_diagnostic_recall"), F.lit(False))),
        ("PRECISION_BELOW_THRESHOLD", ~parse & F.when(symbol, below("precision", "symbol_precision")).otherwise(below("precision", "precision"))),
        ("RECALL_BELOW_THRESHOLD", ~parse & F.when(symbol, below("recall", "symbol_recall")).otherwise(below("recall", "recall"))),
        ("WILSON_BELOW_THRESHOLD", ~parse & ~symbol & (claimed >= t["wilson_least"]) & below("precision_lower", "wilson")),
        ("CANDIDATE_PRECISION_BELOW_THRESHOLD", ~parse & below("candidate_precision", "candidate_precision")),
        ("CANDIDATE_RECALL_BELOW_THRESHOLD", ~parse & below("candidate_recall", "candidate_recall")),
        ("CANDIDATE_EXACT_SET_BELOW_THRESHOLD", ~parse & below("candidate_exact", "candidate_exact")),
        ("FALSE_RESOLVED", F.col("false_resolved") > 0),
        ("ANNOTATION_REVIEW_REQUIRED", F.col("unmatched") > 0),
    ]
    codes = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(test, code) for code, test in tests]))), ",")
    shares = ("precision", "recall", "precision_lower", "valid_file_success", "invalid_diagnostic_recall", "candidate_precision", "candidate_recall", "candidate_exact", "candidate_macro_precision", "candidate_macro_recall")
    return g.select("cell", "capability", *COUNTS, *shares, codes.alias("failure_codes"))


def macro_means(scores: DataFrame) -> DataFrame:
    """cells, failed, precision and recall as means over the cells that have them: one row."""
    return scores.agg(F.count("*").alias("cells"), F.count_if(F.col("failure_codes") != "").alias("failed"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
