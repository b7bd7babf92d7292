"""Literal cases of admission, facts, reviews, verdicts, migrations and flows."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import compare as C
from quarry.operators import config
from quarry.operators import derive as D
from quarry.operators import history as H
from quarry.operators import ingest as N
from quarry.operators import migrations as M
from quarry.operators import tables as A


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_folders_are_judged_before_their_files(spark):
    files = [("node_modules/a", "symlink"), ("node_modules/b/node_modules/c", "file"), ("fr/.env", "file"), ("fr/big.bin", "file"), ("en/lib/.git", "file"), ("en/lib/x/F.java", "file"), ("en/skip/deep/F.java", "file"), ("en/link", "symlink"), ("en/.env.local", "hard_link"), ("en/F.java", "file"), ("en/hard.java", "hard_link"), ("root.java", "file"), (".git/HEAD", "file")]
    df = spark.createDataFrame([(1, p, 9, "x", k) for p, k in files], "root int, path string, size long, text string, kind string")
    got = N.admit(df, ["skip/", "!F.java"], ["en"], [])
    assert {r.path: (r.reason, r.pruned) for r in got.collect()} == {
        "node_modules/a": ("GENERATED_DIRECTORY", "node_modules"),
        "node_modules/b/node_modules/c": ("GENERATED_DIRECTORY", "node_modules"),
        "fr/.env": ("OUT_OF_SCOPE", "fr"),
        "fr/big.bin": ("OUT_OF_SCOPE", "fr"),
        "en/lib/.git": ("SUBMODULE", "en/lib"),
        "en/lib/x/F.java": ("SUBMODULE", "en/lib"),
        "en/skip/deep/F.java": ("IGNORED", "en/skip"),
        "en/link": ("SYMLINK", None),
        "en/.env.local": ("SECRET_PATH", None),
        "en/F.java": (None, None),
        "en/hard.java": ("HARD_LINK", None),
        "root.java": ("OUT_OF_SCOPE", None),
        ".git/HEAD": ("GENERATED_DIRECTORY", ".git"),
    }
    assert rows(N.exclusion_counts(got), "reason", "n") == [("GENERATED_DIRECTORY", 2), ("HARD_LINK", 1), ("IGNORED", 1), ("OUT_OF_SCOPE", 2), ("SECRET_PATH", 1), ("SUBMODULE", 1), ("SYMLINK", 1)]
    assert N.admit(df.limit(0), [], [], []).count() == 0


def facts(spark, *pairs):
    return spark.createDataFrame(pairs, "key string, value int")


def test_only_the_exact_fact_is_passed_over(spark):
    none = spark.createDataFrame([], "key string, value int")
    got = C.verify_facts(facts(spark, ("a", 1)), facts(spark, ("a", 2), ("b", 9), ("c", 8)), facts(spark, ("b", 9), ("c", 9)))
    assert rows(got, "key", "problem", "want", "got") == [("a", "CHANGED", 1, 2), ("c", "UNEXPECTED", None, 8)]
    got = C.verify_facts(facts(spark, ("a", 1), ("a", 1), ("b", 1)), facts(spark, ("a", 2), ("a", 2)), none)
    assert rows(got, "key", "problem") == [("a", "CHANGED"), ("a", "DUPLICATE_ACTUAL"), ("a", "DUPLICATE_EXPECTED"), ("b", "MISSING")]
    with pytest.raises(ValueError):
        C.verify_facts(facts(spark, ("a", 1)), none, facts(spark, ("a", 2)))


def test_the_worst_findings_come_first_with_their_place(spark):
    pulls = spark.createDataFrame([(1, 7, "h")], "project_id int, number int, head_sha string")
    files = spark.createDataFrame([(1, "h", "b", "ADD"), (1, "h", "a", "DELETE"), (1, "other", "c", "ADD")], "project_id int, sha string, path string, change_type string")
    found = spark.createDataFrame([(1, 1, "LOW", "c", "t", "OPEN"), (1, 2, "MEDIUM", "c", "t", "OPEN"), (1, 3, "CRITICAL", "c", "t", "OPEN"), (1, 4, "CRITICAL", "c", "t", "DISMISSED"), (1, 5, "CRITICAL", "c", "t", "OPEN")], "project_id int, id int, severity string, category string, title string, status string")
    places = spark.createDataFrame([(1, 1, "f", 3), (2, 2, "g", None), (3, 3, None, 4), (4, 4, "f", 1)], "finding_id int, evidence_id int, path string, line int")
    got = H.review_context(pulls, files, found, places, most=2)
    assert rows(got, "kind", "place", "item", "detail", "at") == [("FILE", 1, "a", "DELETE", None), ("FILE", 2, "b", "ADD", None), ("FINDING", 1, "3", "CRITICAL c t", None), ("FINDING", 2, "2", "MEDIUM c t", "g:1")]


def test_blank_fingerprints_are_no_renames(spark):
    side = lambda *r: spark.createDataFrame(r, "category string, key string, fingerprint string, members string")
    base = side(("FEATURE", "old", "x", "m"), ("FEATURE", "gone", "y", ""), ("FEATURE", "gone2", "z", None))
    target = side(("FEATURE", "new", "q", "m"), ("FEATURE", "come", "r", ""), ("FEATURE", "come2", "s", " "))
    assert rows(A.renames(base, target, "members"), "old_key", "new_key") == [("old", "new")]


def test_a_recorded_edge_is_the_verdict(spark):
    edges = spark.createDataFrame([(1, "r", "e", "CONSUMES", "POSSIBLE"), (2, "r", "e", "CALLS", "CONFIRMED"), (3, "e", "m", "CALLS", "LIKELY")], "edge_id int, source string, target string, edge_type string, confidence string")
    steps = spark.createDataFrame([(1, 1, "r", "r", 3), (1, 2, "r", "r", None), (1, 3, "e", "r", 1), (1, 4, "e", "r", 99), (1, 5, "m", "r", None)], "flow int, seq int, node string, entry_node string, edge_id int")
    assert rows(D.step_verdicts(steps, edges), "seq", "entry", "edge_type", "confidence") == [(1, False, "CALLS", "LIKELY"), (2, True, None, None), (3, False, "CONSUMES", "POSSIBLE"), (4, False, "CALLS", "CONFIRMED"), (5, False, "CALLS", "LIKELY")]


# Migrations.


def replay(spark, *files, follow=True):
    df = spark.createDataFrame([(1, p, t) for p, t in files], "project int, path string, text string")
    return rows(M.replay_migrations(df, follow), "table", "kind", "position", "name", "type", "path", "line_start", "line_end")


V = "db/migration/V{}__x.sql"


def test_a_table_and_its_index(spark):
    got = replay(spark, (V.format(2), "create index todos_done on todos (done);"), (V.format(1), "create table todos (\n  id bigserial primary key,\n  title text not null,\n  done boolean default false\n);\n"))
    assert got == [
        ("todos", "COLUMN", 1, "id", "bigserial", V.format(1), 2, 2),
        ("todos", "COLUMN", 2, "title", "text", V.format(1), 3, 3),
        ("todos", "COLUMN", 3, "done", "boolean", V.format(1), 4, 4),
        ("todos", "INDEX", 1, "todos_done", None, None, None, None),
        ("todos", "TABLE", 0, "todos", None, V.format(1), 1, 5),
    ]


def test_versions_are_numbers_and_quotes_hide_semicolons(spark):
    text = "-- ; create table a (x int);\n/* create table b (x int); */\ninsert into t values (';', $$;create table c (x int);$$, $q$ $$ ; $q$);\ncreate table \"D d\" (\"x y\" timestamp with time zone[] default now(), unique (\"x y\"), z numeric(1 , 2));"
    got = replay(spark, (V.format(10), "alter table \"D d\" drop column z;"), (V.format("9_1"), text), ("notes.sql", "create table no (x int);"))
    assert [r[:5] for r in got] == [("D d", "COLUMN", 1, "x y", "timestamp with time zone[]"), ("D d", "TABLE", 0, "D d", None)]
    assert [r[6:] for r in got] == [(None, None), (4, 4)]


def test_renames_take_the_history_along(spark):
    files = [
        (V.format(1), "create table a (x int, y int); create table b (z int);"),
        (V.format(2), "alter table a rename to c; alter table b rename to a; alter table a rename column z to w;"),
        (V.format(3), "alter table c add column a_only text; alter table a add column b_only text, drop column if exists nothing;"),
        (V.format(4), "alter table c rename to d; create table c (fresh int);"),
        (V.format(5), "drop table if exists a cascade; alter table b add column late int;"),
    ]
    got = replay(spark, *files)
    assert [(t, n) for t, k, _, n, *_ in got if k == "COLUMN"] == [("b", "late"), ("c", "fresh"), ("d", "x"), ("d", "y"), ("d", "a_only")]
    plain = replay(spark, *files, follow=False)
    assert [(t, n) for t, k, _, n, *_ in plain if k == "COLUMN"] == [("b", "z"), ("b", "late"), ("c", "fresh")]


def test_broken_files_change_nothing(spark):
    files = [(V.format(1), "create table t (x int);"), (V.format(2), "alter table t add column y int; insert into t values ('open);"), (V.format(3), " -- nothing\n"), (V.format(4), None), (V.format(5), "create table u (x int"), (V.format(6), "select 1;")]
    df = spark.createDataFrame([(1, p, t) for p, t in files], "project int, path string, text string")
    assert [r[3] for r in replay(spark, *files)] == ["x", "t"]
    assert rows(M.migration_outcomes(df), "path", "status") == [(V.format(i), "SUCCESS" if i in (1, 6) else "FAILED") for i in range(1, 7)]
    assert M.replay_migrations(df.limit(0)).count() == 0


# Flows.


def test_flows_put_later_components_in_front(spark):
    nodes = [("r", "FE_ROUTE", "R", "{}"), ("ca", "COMPONENT", "A", "{}"), ("cb", "COMPONENT", "B", "{}"), ("hook", "HOOK", "H", "{}"), ("e", "API_ENDPOINT", "E", '{"handlerKey":"m"}'), ("c", "CLASS", "C", '{"layer":"CONTROLLER"}'), ("m", "METHOD", "list", "{}"), ("x", "METHOD", "save", "{}"), ("lone", "FE_ROUTE", "L", "{}"), ("k", "CONTAINER", "K", "{}"), ("k2", "CONTAINER", "K2", "{}"), ("q", "QUEUE_TOPIC", "Q", "{}"), ("q2", "QUEUE_TOPIC", "Q2", "{}")]
    edges = [("r", "ca", "CONTAINS"), ("r", "cb", "CONTAINS"), ("r", "hook", "CONTAINS"), ("r", "e", "CONSUMES"), ("r", "ca", "CONSUMES"), ("r", "r", "CONSUMES"), ("r", "gone", "CONSUMES"), ("c", "e", "EXPOSES"), ("c", "m", "DECLARES"), ("c", "x", "DECLARES"), ("k", "c", "DEPLOYED_IN"), ("k2", "gone", "DEPLOYED_IN"), ("m", "q", "SUBSCRIBES"), ("x", "q", "PUBLISHES"), ("m", "q", "PUBLISHES")]
    n, e = spark.createDataFrame(nodes, "natural_key string, node_type string, name string, metadata string"), spark.createDataFrame(edges, "source string, target string, edge_type string")
    steps = lambda f: rows(f(n, e), "flow", "seq", "node", "edge_type", "description")
    assert steps(D.fe_be_flows) == [
        ("r", 1, "r", None, "Route R"),
        ("r", 2, "cb", "CONTAINS", "B"),
        ("r", 3, "ca", "CONSUMES", "CONSUMES A"),
        ("r", 4, "ca", None, "A"),
        ("r", 5, "e", "CONSUMES", "CONSUMES E"),
        ("r", 6, "e", None, "E"),
        ("r", 7, "c", None, "C"),
        ("r", 8, "m", None, "list"),
    ]
    assert steps(D.infra_flows) == [("k", 1, "k", None, "K"), ("k", 2, "c", "DEPLOYED_IN", "DEPLOYED_IN C")]
    assert [r[2:4] for r in steps(D.event_flows)] == [("m", "PUBLISHES"), ("x", "PUBLISHES"), ("m", "SUBSCRIBES"), ("q", None)]
    assert D.fe_be_flows(n, e.limit(0)).count() == 0


# YAML.


def test_yaml_rows_and_refusals():
    text = "# head\na:\n  - x: 1 # no\n    y: 'it''s'\n  - \"q\\\"#\"\n  -\n    - z\nb: [p, \"q, r\"]\nc: |\n  one\n    two: #\n\nd: http://h:1/x#y\ne:\n- f\ng:\n---\n{}\n---\nh: []\n...\n"
    got = [(d, "/".join(p), k, v, n) for d, p, k, v, n in config.read_yaml(text)]
    assert got == [
        (0, "", "MAP", None, 2),
        (0, "a", "LIST", None, 2),
        (0, "a/[0]", "MAP", None, 3),
        (0, "a/[0]/x", "SCALAR", "1", 3),
        (0, "a/[0]/y", "SCALAR", "it's", 4),
        (0, "a/[1]", "SCALAR", 'q"#', 5),
        (0, "a/[2]", "LIST", None, 6),
        (0, "a/[2]/[0]", "SCALAR", "z", 7),
        (0, "b", "LIST", None, 8),
        (0, "b/[0]", "SCALAR", "p", 8),
        (0, "b/[1]", "SCALAR", "q, r", 8),
        (0, "c", "SCALAR", "one\n  two: #", 9),
        (0, "d", "SCALAR", "http://h:1/x#y", 13),
        (0, "e", "LIST", None, 14),
        (0, "e/[0]", "SCALAR", "f", 15),
        (0, "g", "SCALAR", None, 16),
        (1, "", "MAP", None, 18),
        (2, "", "MAP", None, 20),
        (2, "h", "LIST", None, 20),
    ]
    for bad in ("a: &x 1", "a: *x", "a: !t 1", "a: {b: c}", "a: [[1], 2]", "a:\n\tb: 1", "words", "a: 1\n  b: 2", "a:\n    b: 1\n  c: 2", 'a: "open'):
        assert [r[2] for r in config.read_yaml(bad)] == ["REFUSED"], bad
    assert config.read_yaml("") == config.read_yaml("# only\n---\n") == []


def test_deep_and_empty_files(spark):
    deep = "".join("  " * i + f"k{i}:\n" for i in range(200))
    df = spark.createDataFrame([("a.yml", None), ("b.YAML", deep), ("c.txt", "a: 1"), ("compose.yml", "services:\n  web:\n    ports: 80\n    build: {}\n  db:\n")], "path string, text string")
    got = config.yaml_rows(df)
    assert {r.file: r.kind for r in got.filter("file = 'b.YAML'").collect()} == {"b.YAML": "REFUSED"}
    services = {r.service: r for r in config.compose_services(got).collect()}
    assert services["web"].ports == ["80"] and services["web"].context == "." and services["db"].context is None and services["db"].ports == []


# Digests, notes, histories.


def test_digests_do_not_depend_on_partitions(spark):
    from quarry.operators import digests as G

    made = [(s, f"p{i:04d}", i, f"h{i}") for s, n in ((1, 700), (2, 5), (3, 16), (4, 17)) for i in range(n)]
    df = spark.createDataFrame(made, "snapshot_id int, path string, size int, content_hash string")
    one = rows(G.manifest_digest(df.repartition(1)), "snapshot_id", "digest", "files", "bytes")
    assert one == rows(G.manifest_digest(df.repartition(64)), "snapshot_id", "digest", "files", "bytes") == rows(G.manifest_digest(df.repartition(4, "path")), "snapshot_id", "digest", "files", "bytes")
    tree = lambda d: dict(rows(G.tree_digest(d, ["snapshot_id"], "path", F.col("path"), fan=4), "snapshot_id", "digest"))
    assert tree(df.filter("snapshot_id = 3"))[3] == tree(df)[3] != tree(df)[4]  # other keys' heights do not matter
    sealed = G.manifest_digest(df, "p")
    moved = df.withColumn("size", F.when((F.col("snapshot_id") == 1) & (F.col("path") == "p0001"), 2).when((F.col("snapshot_id") == 1) & (F.col("path") == "p0002"), 1).otherwise(F.col("size"))).filter("not (snapshot_id = 2 and size = 4) and snapshot_id <> 4")
    assert rows(G.verify_seal(moved, sealed, "p"), "snapshot_id", "verdict") == [(1, "CHANGED"), (2, "COUNT"), (3, "VALID"), (4, "MISSING")]
    assert {r.verdict for r in G.verify_seal(df, sealed, "other").collect()} == {"CHANGED"}


def test_patterns_in_texts_are_those_of_every_pair(spark):
    import random

    from quarry.operators import matching as K

    rnd = random.Random(4)
    piece = lambda: rnd.choice(["src", "Main", "a", "b1", "é", "x_y", "Makefile", "tsx", "-", "aa"])
    texts = [(s, i, rnd.choice([None, "", "".join(piece() + rnd.choice(["/", ".", " ", "", "\n"]) for _ in range(rnd.randint(1, 14)))])) for i in range(150) for s in (rnd.randint(0, 1),)]
    patterns = sorted({(s, "".join(piece() + rnd.choice(["/", ".", ""]) for _ in range(rnd.randint(1, 4)))) for _ in range(120) for s in (0, 1)} | {(0, ""), (0, "%"), (1, "..")})
    got = K.contained(spark.createDataFrame(texts, "scope int, id int, text string"), spark.createDataFrame(patterns, "scope int, pattern string"), "scope")
    want = [(s, i, p) for s, i, t in texts for q, p in patterns if s == q and p and p.lower() in (t or "").lower()]
    assert rows(got, "scope", "id", "pattern") == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_scan_replaces_what_belongs_to_its_commits(spark):
    from quarry.operators import records as R

    c = "project_id int, sha string, committed_at timestamp, message string"
    f, r = "project_id int, sha string, path string, change_type string", "project_id int, kind string, name string, head_sha string"
    at = lambda d: __import__("datetime").datetime(2024, 1, d)
    out = R.replace_history(
        spark.createDataFrame([(1, "a", at(1), "old"), (1, "b", at(2), "old"), (2, "a", None, "other")], c),
        spark.createDataFrame([(1, "a", "x", "ADD"), (1, "b", "y", "ADD"), (2, "a", "z", "ADD"), (9, "gone", "w", "ADD")], f),
        spark.createDataFrame([(1, "TAG", "t", "a"), (2, "TAG", "t", "a")], r),
        spark.createDataFrame([(1, "b", at(2), "new"), (1, "c", at(3), "new")], c),
        spark.createDataFrame([(1, "c", "q", "ADD"), (1, "a", "ignored", "ADD")], f),
        spark.createDataFrame([(1, "BRANCH", "main", "c"), (2, "BRANCH", "no", "c")], r),
        spark.createDataFrame([(1,)], "project_id int"),
        max_commits=3,
    )
    assert rows(out, "kind", "project_id", "key", "child", "detail") == [("BRANCH", 1, "main", None, "c"), ("COMMIT", 1, "a", None, "old"), ("COMMIT", 1, "b", None, "new"), ("COMMIT", 1, "c", None, "new"), ("COMMIT", 2, "a", None, "other"), ("FILE", 1, "a", "x", "ADD"), ("FILE", 1, "c", "q", "ADD"), ("FILE", 2, "a", "z", "ADD"), ("TAG", 2, "t", None, "a")]


def test_histories_are_folded_in_a_stream_of_events(spark):
    files = [(p, f"db/migration/V{v}_{t}__x.sql", text) for p in (1, None) for t in range(12) for v, text in ((1, f"create table t{t} (\n  id int\n);"), (2, f"alter table t{t} add column b text, add column c text, drop column id;"), (3, f"alter table t{t} rename to u{t};"))]
    df = spark.createDataFrame(files, "project long, path string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = M.replay_migrations(df)
        got = rows(out, "project", "table", "kind", "position", "name")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(1, f"u{t}", k, i, n.format(t)) for t in range(12) for k, i, n in (("TABLE", 0, "u{}"), ("COLUMN", 1, "b"), ("COLUMN", 2, "c"))]
    assert [r for r in got if r[0] == 1] == sorted(want, key=repr)
    # Calls of Python follow the rows, not the tables.
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
