"""Literal cases of signals, trees, import summaries, phases and guarded outcomes."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import signals as S

OK = '{"schemaVersion":1,"policyVersion":"local-ingest-v1","acceptedFiles":3,"bytesRead":9,"excludedEntriesByReason":{"IGNORED":2}}'


@pytest.mark.parametrize(
    "text, good",
    [
        (OK, True),
        (OK.replace('{"IGNORED":2}', "{}"), True),
        (None, False),
        ("", False),
        (OK + "x", False),
        (OK + "]", False),
        (OK + "}", False),
        (OK + ",1", False),
        (OK[:-1], False),
        ("[1]", False),
        (OK.replace('"bytesRead":9', '"bytesRead":9,"bytesRead":9'), False),
        (OK.replace('"bytesRead":9', '"bytesRead":"9"'), False),
        (OK.replace('"bytesRead":9', '"bytesRead":-1'), False),
        (OK.replace('"bytesRead":9', '"bytesRead":9.0'), False),
        (OK.replace('"bytesRead":9', '"bytesRead":536870913'), False),
        (OK.replace('"acceptedFiles":3', '"acceptedFiles":50001'), False),
        (OK.replace('"bytesRead":9,', ""), False),
        (OK.replace("v1", "v2"), False),
        (OK.replace("Version\":1", "Version\":0"), False),
        (OK.replace("IGNORED", "UNKNOWN"), False),
        (OK.replace('"IGNORED":2', '"IGNORED":null'), False),
        (OK.replace('"IGNORED":2', '"IGNORED":199998'), False),
        (OK.replace('"IGNORED":2', '"IGNORED":199997'), True),
        (OK.replace('"IGNORED":2', '"IGNORED":2,"IGNORED":2'), False),
        (OK + " " * 2048, False),
    ],
)
def test_import_summary(spark, text, good):
    row = spark.createDataFrame([(text,)], "j string").select(S.import_summary(F.col("j")).alias("s")).first().s
    assert (row is not None) == good
    if text == OK:
        assert (row.accepted_files, row.bytes_read, row.excluded) == (3, 9, {"IGNORED": 2})


def test_signals(spark):
    files = spark.createDataFrame(
        [(1, "b/package.json", '{"NestJS": "express"}'), (1, "a/x.java", None), (1, "a/y.java", "@Service"), (2, "pom.xml", "none"), (3, "z.java", "@Service nestjs")],
        "snapshot_id int, path string, text string",
    )
    rules = [
        S.Signal("BACKEND", "Spring", 0.25, "CONTENT", "**/*.java", ("@RestController", "@Service")),
        S.Signal("BACKEND", "NestJS", 0.55, "MENTION", "**/package.json", ("nestjs",)),
        S.Signal("BACKEND", "Express", 0.55, "MENTION", "**/package.json", ("express",), ("nestjs",)),
        S.Signal("BACKEND", "Other", 0.1, "MENTION", "**/none", ("none",)),
        S.Signal("BACKEND", "Java", 0.25, "PATH", "**/*.java"),
    ]
    got = {(r.snapshot_id, r.technology): (r.path, r.detail) for r in S.detect_signals(files, rules).collect()}
    assert got == {
        (1, "Spring"): ("a/y.java", "@Service"),
        (1, "NestJS"): ("b/package.json", "nestjs"),
        (1, "Java"): ("a/x.java", None),
        (2, "Other"): ("pom.xml", "none"),
        (3, "Spring"): ("z.java", "@Service"),
        (3, "Java"): ("z.java", None),
    }
    assert S.detect_signals(files.limit(0), rules).count() == 0


def test_feature_tree(spark):
    rows = [(1, None, "root"), (2, 1, "b"), (3, 1, "a"), (4, 3, "c"), (5, 6, "loop"), (6, 5, "loop"), (7, 99, "lost"), (8, None, "alone")]
    got = S.feature_tree(spark.createDataFrame(rows, "id int, parent_id int, name string")).orderBy("trail").collect()
    assert [(r.id, r.root_id, r.depth) for r in got] == [(8, 8, 0), (1, 1, 0), (3, 1, 1), (4, 1, 2), (2, 1, 1)]


def test_phase_sampling(spark):
    samples = spark.createDataFrame([("r", "p", 100, 5.0, True), ("r", "p", 300, 7.0, True), ("s", "p", 0, 1.0, True), ("s", "q", 5, 1.0, False)], "run string, phase string, t_ms long, value double, owner boolean")
    phases = spark.createDataFrame([("r", "p", 0, 350), ("r", "late", 350, 400), ("s", "p", 0, 260), ("t", "p", 0, 251)], "run string, phase string, start_ms long, end_ms long")
    got = {(r.run, r.phase): (r.n, r.max_gap, r.peak, r.complete) for r in S.phase_sampling(samples, phases).collect()}
    assert got == {("r", "p"): (2, 200, 7.0, True), ("r", "late"): (0, 50, None, False), ("s", "p"): (1, 260, 1.0, False), ("t", "p"): (0, 251, None, False)}


def test_guarded_outcomes(spark):
    nodes = spark.createDataFrame([("k", "CLASS", "a", 1), ("k", "CLASS", "b", 1), ("l", "CLASS", "c", 1), ("k", "CLASS", "d", None)], "natural_key string, node_type string, path string, line_start int")
    outcomes = spark.createDataFrame([("a", "SUCCESS"), ("c", "SUCCESS"), ("b", "FAILED")], "path string, status string")
    assert {(r.path, r.status) for r in S.guarded_outcomes(nodes, outcomes).collect()} == {("a", "PARTIAL"), ("b", "FAILED"), ("c", "SUCCESS")}
