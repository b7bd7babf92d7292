"""Literal cases of derived facts, extraction and streams."""

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import compare as C
from quarry.operators import derive as D
from quarry.operators import extract as X
from quarry.operators import ingest as N
from quarry.streaming import jobs


def merged(spark, *seeds):
    rows = [(i, n, e, list(x)) for i, (n, e, x) in enumerate(seeds)]
    df = spark.createDataFrame(rows, "seed long, name string, endpoint boolean, nodes array<string>")
    return sorted((r.name, r.endpoint, "".join(r.nodes)) for r in D.merge_seeds(df).collect())


def test_seeds_merge_at_half_overlap(spark):
    assert merged(spark, ("zed", False, "a"), ("auth", True, "ab"), ("c", False, "c")) == [("auth", True, "ab"), ("c", False, "c")]
    assert merged(spark, ("b", False, "abc"), ("a", False, "bcd")) == [("a", False, "abcd")]
    assert merged(spark, ("b", False, ""), ("a", False, "")) == [("a", False, "")]
    assert merged(spark, ("b", False, "abcd"), ("a", False, "def")) == [("a", False, "def"), ("b", False, "abcd")]


def test_seeds_merge_as_a_plain_loop_does(spark):
    import random

    r = random.Random(1)
    seeds = [(f"s{r.randrange(9)}", r.random() < 0.3, {f"n{r.randrange(25)}" for _ in range(r.randrange(0, 4))}) for _ in range(40)]
    todo = [(n, e, frozenset(x)) for n, e, x in seeds]
    done = False
    while not done:
        done = True
        for i in range(len(todo)):
            for j in range(i + 1, len(todo)):
                (a, e, x), (b, f, y) = todo[i], todo[j]
                if done and (len(x & y) / len(x | y) if x | y else 1.0) >= 0.5:
                    todo = [t for k, t in enumerate(todo) if k not in (i, j)] + [(a if e > f else b if f > e else min(a, b), e or f, x | y)]
                    done = False
                    break
            if not done:
                break
    df = spark.createDataFrame([(i, n, e, sorted(x)) for i, (n, e, x) in enumerate(seeds)], "seed long, name string, endpoint boolean, nodes array<string>")
    got = sorted((x.name, x.endpoint, tuple(x.nodes)) for x in D.merge_seeds(df).collect())
    assert got == sorted((n, e, tuple(sorted(x))) for n, e, x in todo)


def test_scalars_of_metadata_and_lines(spark):
    r = spark.range(1).select(
        T.meta_merge(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}')).alias("merged"),
        T.package_cluster(F.lit("java:com.acme.Shop.Cart")).alias("vendor"),
        T.package_cluster(F.lit("java:shop.cart.Cart")).alias("own"),
        T.package_cluster(F.lit("java:Cart")).alias("none"),
        T.count_config_lines(F.lit("a\r\nb\rc\n")).alias("lines"),
        T.count_config_lines(F.lit("")).alias("empty"),
        T.line_of(F.lit("a\nb x\nc"), "x").alias("at"),
        T.format_author(F.lit("N"), F.lit("e@x")).alias("author"),
        T.format_author(F.lit(" "), F.lit("e@x")).alias("mail"),
        T.parse_skip_count(F.lit("12")).alias("n"),
        T.parse_skip_count(F.lit("1x")).alias("bad"),
        T.abbrev_sha(F.lit("0123456789abcdef")).alias("sha"),
        D.layer_of(F.array(F.lit("Service")), F.array().cast("array<string>")).alias("service"),
        D.layer_of(F.array().cast("array<string>"), F.array(F.lit("MyJpaRepository"))).alias("repo"),
        N.is_binary(F.lit("a/b.PNG"), F.lit("x")).alias("png"),
        N.is_binary(F.lit("a/b.txt"), F.lit("x\x00y")).alias("nul"),
        N.name_reason(F.lit("node_modules"), True).alias("generated"),
        N.name_reason(F.lit(".SSH"), True).alias("secret"),
        N.name_reason(F.lit("build"), False).alias("file"),
    ).first()
    assert r.merged == '{"a":"1","b":"3"}' and (r.vendor, r.own, r.none) == ("shop", "shop", None)
    assert (r.lines, r.empty, r.at, r.author, r.mail, r.n, r.bad, r.sha) == (3, 1, 2, "N <e@x>", "e@x", 12, None, "0123456789")
    assert (r.service, r.repo, r.png, r.nul, r.generated, r.secret, r.file) == ("SERVICE", "REPOSITORY", True, True, "GENERATED_DIRECTORY", "SECRET_PATH", None)


def test_ignore_rules(spark):
    paths = ["a.log", "x/a.log", "x/keep.log", "build/a", "x/build", "x/y/z.tmp", "docs/a/b.md", "q/docs/b.md"]
    df = N.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), ["*.log", "!keep.log", "build/", "x/**/*.tmp", "/docs/"])
    assert {r.path for r in df.filter("ignored").collect()} == {"a.log", "x/a.log", "build/a", "x/y/z.tmp", "docs/a/b.md"}


def test_excluded_blocks_must_exist(spark):
    b = spark.createDataFrame([("NOTE", "a"), ("NOTE", "b")], "kind string, content string")
    ids = b.filter("content = 'a'").select(C.block_id(F.col("kind"), F.col("content")).alias("block_id"))
    assert [r.content for r in C.exclude_blocks(b, ids).collect()] == ["b"]
    try:
        C.exclude_blocks(b, spark.createDataFrame([("NOTE:x",)], "block_id string"))
        raise AssertionError
    except ValueError:
        pass


def test_dockerfiles_of_services(spark):
    s = spark.createDataFrame([("web", "deploy/compose.yml", "../web", None), ("db", "compose.yml", None, "db/Dockerfile.prod"), ("no", "compose.yml", "x", None)], "service string, compose_path string, context string, dockerfile string")
    f = spark.createDataFrame([("web/Dockerfile",), ("db/Dockerfile.prod",)], "path string")
    assert {(r.service, r.path) for r in X.resolve_dockerfiles(s, f).collect()} == {("web", "web/Dockerfile"), ("db", "db/Dockerfile.prod")}


def test_manifests(spark):
    pom = "<project><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency></project>"
    df = spark.createDataFrame([("x/pom.xml", pom), ("package.json", '{"dependencies":{"r":"^1"},"devDependencies":{"t":"2"}}'), ("package.json", "not json"), ("pom.xml", None)], "path string, text string")
    got = {(r.scope, r.dependency, r.version) for r in X.extract_dependencies(df).collect()}
    assert got == {("test", "g:a", "1"), ("dependencies", "r", "^1"), ("devDependencies", "t", "2")}


def run_stream(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_job_state_overflow_and_steps_on_streams(spark, tmp_path):
    spark.createDataFrame([(1, 1, "RUN"), (1, 2, "DONE"), (1, 3, "RUN")], "job_id int, seq int, state string").coalesce(1).write.parquet(str(tmp_path / "s"))
    got = run_stream(jobs.latest_state(spark.readStream.schema("job_id int, seq int, state string").parquet(str(tmp_path / "s"))), tmp_path, "states", "complete")
    assert [tuple(r) for r in got] == [(1, "DONE", 2)]
    spark.createDataFrame([("a", 1, 300), ("a", 1, 300), ("b", 1, 1), ("b", -1, 1)], "subscriber string, delta long, chars long").write.parquet(str(tmp_path / "d"))
    got = run_stream(jobs.overflow(spark.readStream.schema("subscriber string, delta long, chars long").parquet(str(tmp_path / "d")), 64, 500), tmp_path, "pending", "complete")
    assert {(r.subscriber, r.pending, r.closed) for r in got} == {("a", 2, True), ("b", 0, False)}
    step = "job_id int, step string, seq int, kind string, progress int"
    spark.createDataFrame([(1, "x", 1, "START", None), (1, "x", 2, "PROGRESS", 40), (1, "x", 3, "FAILED", None), (1, "x", 4, "START", None)], step).write.parquet(str(tmp_path / "p"))
    got = run_stream(jobs.step_status(spark.readStream.schema(step).parquet(str(tmp_path / "p"))), tmp_path, "steps", "complete")
    assert [tuple(r) for r in got] == [(1, "x", 2, 40, "RUNNING")]


def test_idle_sessions_and_sampling_on_streams(spark, tmp_path):
    spark.sql("SELECT 1 AS job_id, timestamp'2024-01-01 10:00:00' AS ts UNION ALL SELECT 1, timestamp'2024-01-01 10:00:10' UNION ALL SELECT 1, timestamp'2024-01-01 10:01:00'").write.parquet(str(tmp_path / "i"))
    got = run_stream(jobs.idle_sessions(spark.readStream.schema("job_id int, ts timestamp").parquet(str(tmp_path / "i"))), tmp_path, "idle", "complete")
    assert sorted(r.n for r in got) == [1, 2]
    sample = "run long, phase string, t_ms long, value double"
    spark.createDataFrame([(1, "a", 0, 1.0), (1, "a", 200, 5.0), (1, "a", 600, None), (1, "b", 0, 2.0)], sample).coalesce(1).write.parquet(str(tmp_path / "g"))
    got = run_stream(jobs.sampling(spark.readStream.schema(sample).parquet(str(tmp_path / "g"))), tmp_path, "gaps", "update")
    assert {(r.phase, r.n, r.max_gap, r.peak, r.complete) for r in got} == {("a", 3, 400, 5.0, False), ("b", 1, 0, 2.0, True)}
