"""Small literal cases of the operators."""

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import graph as G
from quarry.operators import tables as A
from quarry.streaming import jobs


def test_impact_counts_paths_and_keeps_the_weakest_edge(spark):
    edges = spark.createDataFrame([("controller", "target", "CALLS", "CONFIRMED"), ("retry", "target", "CALLS", "LIKELY"), ("retry", "controller", "CALLS", "CONFIRMED"), ("page", "retry", "CALLS", "POSSIBLE")], "source string, target string, edge_type string, confidence string")
    got = {r.node: (r.min_depth, r.path_count, r.strength, r.impact_group) for r in G.impact(edges, spark.sql("SELECT 'target' AS start")).collect()}
    nodes = spark.createDataFrame([("controller", "CLASS"), ("retry", "METHOD"), ("page", "METHOD")], "natural_key string, node_type string")
    assert G.risk_score(G.impact(edges, spark.sql("SELECT 'target' AS start"), count_paths=False), nodes).first()[1:] == (4, "LOW")
    assert got == {"controller": (1, 1, 3, "CONFIRMED_DEPENDENCY"), "retry": (1, 2, 3, "CONFIRMED_DEPENDENCY"), "page": (2, 2, 1, "CANDIDATE_IMPACT")}


def test_link_calls_grades(spark):
    ends = spark.createDataFrame([("a", "GET", "/users/{id}"), ("b", "ANY", "/todos"), ("c", "GET", "/x")], "endpoint string, method string, path string")
    calls = spark.createDataFrame([("1", "GET", "/users/{id}"), ("2", "GET", "/users/${id}"), ("3", "POST", "/api/todos"), ("4", "POST", "/x"), ("5", "get", "https://h.example.com/users/{id}/?q=1"), ("6", "ANY", "/x")], "caller string, method string, path string")
    assert {r.caller: (r.endpoint, r.grade) for r in G.link_calls(calls, ends).collect()} == {"1": ("a", 3), "2": ("a", 2), "3": ("b", 1), "5": ("a", 3)}


def test_pack_skips_what_does_not_fit(spark):
    b = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 4), (1, 4, 1), (1, 5, 1)], "ctx int, seq long, size long")
    assert A.pack(b, 10).first()[1:] == (10, 3, "1,3,4")


def test_nearest_rank_counts_failures_as_infinite(spark):
    d = spark.createDataFrame([("a", float(i)) for i in range(1, 20)] + [("a", None)], "k string, v double")
    r = A.nearest_rank(d, ["k"], "v").first()
    assert (r.p, r.worst, r.n) == (19.0, float("inf"), 20)


def test_scalars(spark):
    r = spark.range(1).select(
        T.to_snake_case(F.lit("HTTPServerName")).alias("snake"),
        T.url_path(F.lit("https://h.example.com/a/b/?q=1")).alias("path"),
        T.normalize_template(F.lit("/Users/${id}/x/:key")).alias("norm"),
        T.join_route(F.lit("/api/"), F.lit("/v1//x/")).alias("route"),
        T.migration_sort_key(F.lit("db/V1_2__x.sql")).alias("key"),
        T.trigram_similarity(F.lit("word"), F.lit("word")).alias("sim"),
        T.glob_match(F.lit("a/b/c.java"), "**/*.java").alias("glob"),
        T.count_lines(F.lit("a\nb")).alias("lines"),
        T.wilson_lower(F.lit(0), F.lit(0)).alias("none"),
    ).first()
    assert r.snake == "http_server_name" and r.path == "/a/b" and r.norm == "/users/{}/x/{}" and r.route == "/api/v1/x"
    assert r.key == "000000000001.000000000002" and r.sim == 1.0 and r.glob and r.lines == 2 and r.none is None


def test_nothing_counts_after_a_terminal_state(spark):
    e = spark.createDataFrame([(1, 1, "RUN"), (1, 2, "DONE"), (1, 3, "RUN"), (2, 1, "RUN")], "job_id int, seq int, state string")
    assert {r.job_id: r.state for r in jobs.latest_state(e).collect()} == {1: "DONE", 2: "RUN"}


def test_usage_stream(spark, tmp_path):
    spark.sql("SELECT 1L AS user_id, timestamp'2024-01-01 10:00:00' AS ts, 60L AS tokens UNION ALL SELECT 1L, timestamp'2024-01-01 12:00:00', 50L").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("user_id long, ts timestamp, tokens long").parquet(str(tmp_path / "in"))
    q = jobs.usage_by_day(src, 100).writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("usage").first()[2:] == (110, True)
