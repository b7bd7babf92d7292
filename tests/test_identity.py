"""Literal cases of personal data, secrets, identities and references."""

from pyspark.sql import functions as F

from quarry.functions import privacy as P
from quarry.operators import identity as I
from quarry.operators import tables as A


def test_masking_numbers_values_and_checks_them(spark):
    rows = ["a@b.com A@B.com c@d.org", "git@github.com:x", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "ssn 078-05-1120 000-12-3456", "call +82 10 1234 5678 or 010-1234-5678", "v1.2.3 code 123", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(P.mask_pii(F.col("t"))).collect()]
    assert got == ["[EMAIL_1] [EMAIL_1] [EMAIL_2]", rows[1], "card [CARD_1] and 4111 1111 1111 1112", "ssn [SSN_1] 000-12-3456", "call [PHONE_1] or [PHONE_2]", rows[5], None, ""]
    assert all(P.mask_text(t) == t for t in got if t)


def test_masking_does_not_miss_numbers_in_groups_of_two(spark):
    rows = ["call +33 6 12 34 56 78", "+4 (12) 34-56.78 90", "a +1 b", "12 34 56 78"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(P.mask_pii(F.col("t"))).collect()]
    assert got == [P.mask_text(t) for t in rows] == ["call [PHONE_1]", "[PHONE_1]", *rows[2:]]


def test_secrets_and_placeholders(spark):
    rows = [("AKIA" + "A" * 16, False), ('password = "hunter22"', False), ('password = "${PW}"', False), ("token: abcdef", True), ("token: abcdef", False), (None, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, c boolean").orderBy("i")
    got = df.select(P.contains_secret(F.col("t"), F.col("c")), P.redact_secrets(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, True, False, False]
    assert got[0][1] == "[REDACTED]" and got[1][1] == 'password = "[REDACTED]"' and got[2][1] == rows[2][0]


def test_a_type_in_two_files_blocks_its_members(spark):
    nodes = spark.createDataFrame([("java:a.T", "CLASS", "x", 1), ("java:a.T", "CLASS", "y", 1), ("java:a.T#m", "METHOD", "x", 2), ("java:a.TU", "CLASS", "z", 1), ("java:a", "PACKAGE", "x", 1), ("java:a", "PACKAGE", "y", 1)], "natural_key string, node_type string, path string, line_start int")
    assert {r[0] for r in I.blocked_keys(nodes).collect()} == {"java:a.T", "java:a.T#m"}


def test_references_resolve_by_suffix_and_prefix(spark):
    refs = spark.createDataFrame([("n", "NODE", "list"), ("n", "COMMIT", "ABCDEF12"), ("n", "NOTE", "me"), ("n", "FILE", "none")], "note string, kind string, target string")
    t = lambda *r: spark.createDataFrame(list(r), "key string, id string")
    got = I.resolve_note_refs(refs, t(("a", "1")), t(("C#List", "7")), t(("abcdef1299", "5"), ("abcdef1399", "4")), t(("1", "1")), t(("me", "n")))
    assert {r.kind: r.subject for r in got.collect()} == {"NODE": "7", "COMMIT": "5", "NOTE": None, "FILE": None}


def test_vector_blocks_give_the_brute_force_neighbours(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(200, 8))
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = A.cosine_top_k(v, v.filter("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("q")), 3, block=64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(0, 200, 20) for j in [j for j in np.argsort(-(u @ u[i])) if j != i][:3]}
    assert {(r.query, r.id) for r in got.collect()} == want


def test_masking_literal_cases():
    m = P.mask_text
    assert m("mail jane.doe+ci@example.co.kr, cc Ops@Example.invalid, again JANE.DOE+ci@example.co.kr") == "mail [EMAIL_1], cc [EMAIL_2], again [EMAIL_1]"
    assert m("call 010-2345-6789 / 01023456789 / 010.2345.6789") == "call [PHONE_1] / [PHONE_1] / [PHONE_1]"
    assert m("office 02-345-6789, 031 234 5678, 070-1234-5678") == "office [PHONE_1], [PHONE_2], [PHONE_3]"
    assert m("intl +82 10-2345-6789, +44 20 7946 0958, +1 (415) 555-0132") == "intl [PHONE_1], [PHONE_2], [PHONE_3]"
    assert m("US (415) 555-0132 or 415-555-0132") == "US [PHONE_1] or [PHONE_1]"
    assert m("RRN 900101-1234567 and 0412313234567") == "RRN [RRN_1] and 0412313234567"
    assert m("rrn=8001011234560") == "rrn=[RRN_1]"
    assert m("card 4111 1111 1111 1111, 4111-1111-1111-1111, 5500000000000004") == "card [CARD_2], [CARD_2], [CARD_1]"
    assert m("amex 3782 822463 10005") == "amex [CARD_1]" and m("SSN 078-05-1120") == "SSN [SSN_1]"
    for same in (
        'version "2.345.678.9012" // semver 10.2345.6789',
        "1791292686000L 1791292686000000L 4111111111111112L 4111111111111112 0.0102345678",
        "9f86d081884c7d659a2feaeaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a 550e8400-e29b-41d4-a716-446655440000 192.168.10.200",
        "lodash@4.17.21 @types/node@20.1.0 git@github.com:org/repo.git ssh://git@github.com/org/repo.git 2026-10-07 12:34:56",
        "user_01023456789 A010-2345-6789 file:src/App.java:120 000-12-3456 901301-1234567 +1 23",
        "010-2345\n-6789\njane\n@example.invalid",
        "",
    ):
        assert m(same) == same


def test_references_to_many_of_one_key_do_not_meet_them_all(spark):
    t = lambda *r: spark.createDataFrame(list(r), "key string, id string")
    n = 4000
    refs = spark.range(n).select(F.concat(F.lit("n"), "id").alias("note"), F.lit("FILE").alias("kind"), F.lit("a.md").alias("target"))
    refs = refs.unionByName(spark.createDataFrame([("t1", "NOTE", "me"), ("t2", "NOTE", "me"), ("x", "COMMIT", "abcdef13")], refs.schema))
    files = spark.range(n).select(F.lit("a.md").alias("key"), F.col("id").cast("string").alias("id"))
    commits = t(*[(f"abcdef{i}", str(i)) for i in (1299, 1399, 1377)])
    got = I.resolve_note_refs(refs, files, t(("A", "1")), commits, t(("1", "1")), t(("me", "t1"), ("me", "t1"), ("me", None), ("me", "t2"), ("me", "t3")))
    out = got.collect()
    assert {(r.kind, r.subject) for r in out if r.kind == "FILE"} == {("FILE", "0")} and len(out) == n + 3
    assert {r.note: r.subject for r in out if r.kind != "FILE"} == {"t1": "t2", "t2": "t1", "x": "1377"}
    joined = [m["value"] for m in _join_rows(got)]
    assert joined and max(joined) <= 2 * (n + 3)


def _join_rows(df):
    """Rows that each join of a collected query gave."""
    out, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        p = open_.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            open_.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            open_.append(p.plan())
        elif "Join" in p.nodeName():
            m = p.metrics().get("numOutputRows")
            out += [{"name": p.nodeName(), "value": m.get().value()}] if m.isDefined() else []
        c = p.children()
        open_ += [c.apply(i) for i in range(c.size())]
    return out
