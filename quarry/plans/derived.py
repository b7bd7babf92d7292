"""The library's tables, derived from the given ones by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each view as SQL that both engines run, over the given tables and the views before it.
VIEWS = {
    "g_nodes": """SELECT concat('region:', r_regionkey) AS natural_key, 'DB_TABLE' AS node_type, r_name AS name FROM region
 UNION ALL SELECT concat('nation:', n_nationkey), 'CLASS', n_name FROM nation
 UNION ALL SELECT concat('customer:', c_custkey), CASE WHEN c_custkey % 97 = 0 THEN 'AMBIGUOUS' ELSE 'COMPONENT' END, c_name FROM customer
 UNION ALL SELECT concat('supplier:', s_suppkey), 'METHOD', s_name FROM supplier
 UNION ALL SELECT concat('part:', p_partkey), 'API_ENDPOINT', p_name FROM part
 UNION ALL SELECT concat('order:', o_orderkey), 'FE_ROUTE', o_orderpriority FROM orders""",
    "g_edges": """SELECT concat('nation:', n_nationkey) AS source, concat('region:', n_regionkey) AS target, 'CONTAINS' AS edge_type, 'CONFIRMED' AS confidence FROM nation
 UNION ALL SELECT concat('customer:', c_custkey), concat('nation:', c_nationkey), 'CALLS', CASE WHEN c_custkey % 3 = 0 THEN 'CONFIRMED' WHEN c_custkey % 3 = 1 THEN 'LIKELY' ELSE 'POSSIBLE' END FROM customer
 UNION ALL SELECT concat('supplier:', s_suppkey), concat('nation:', s_nationkey), 'USES_TYPE', CASE WHEN s_suppkey % 2 = 0 THEN 'CONFIRMED' ELSE 'LIKELY' END FROM supplier
 UNION ALL SELECT concat('nation:', n_nationkey), concat('nation:', (n_nationkey + 7) % 25), 'IMPORTS', 'LIKELY' FROM nation
 UNION ALL SELECT concat('order:', o_orderkey), concat('customer:', o_custkey), 'CONSUMES', CASE WHEN o_orderkey % 5 = 0 THEN 'POSSIBLE' ELSE 'CONFIRMED' END FROM orders
 UNION ALL SELECT concat('order:', o_orderkey), concat('customer:', o_custkey), 'CONTAINS', 'CONFIRMED' FROM orders WHERE o_orderkey % 3 <> 0
 UNION ALL SELECT concat('customer:', c_custkey), concat('part:', c_custkey % 100 + 1), 'CONSUMES', 'LIKELY' FROM customer WHERE c_custkey % 3 = 0
 UNION ALL SELECT DISTINCT concat('part:', l_partkey), concat('supplier:', l_suppkey), 'CALLS', CASE WHEN l_partkey % 2 = 0 THEN 'CONFIRMED' ELSE 'POSSIBLE' END FROM lineitem""",
    "g_files": """SELECT doc_id % 3 AS snapshot_id, concat(source, '/', lang, '/', CASE WHEN doc_id % 5 = 0 THEN 'test/' ELSE 'main/' END, 'F', doc_id, CASE doc_id % 6 WHEN 0 THEN '.java' WHEN 1 THEN '.tsx' WHEN 2 THEN '.sql' WHEN 3 THEN '.md' WHEN 4 THEN '.py' ELSE '.bin' END) AS path,
 n_chars AS size, coalesce(text, '') AS text, source AS project, doc_id FROM documents""",
    "g_base": "SELECT 'FILE' AS category, concat(source, '/', doc_id) AS key, sha2(coalesce(text, ''), 256) AS fingerprint FROM documents WHERE doc_id % 10 <> 0",
    "g_target": "SELECT 'FILE' AS category, concat(source, '/', CASE WHEN doc_id % 13 = 0 THEN concat('moved-', doc_id) ELSE concat('', doc_id) END) AS key, sha2(CASE WHEN doc_id % 11 = 0 THEN concat(coalesce(text, ''), '!') ELSE coalesce(text, '') END, 256) AS fingerprint FROM documents WHERE doc_id % 7 <> 0",
    "r_base": "SELECT 'FILE' AS category, concat(source, '/', doc_id) AS key, CASE WHEN doc_id % 26 = 0 THEN ' ' ELSE sha2(coalesce(text, ''), 256) END AS fingerprint FROM documents WHERE doc_id % 10 <> 0",
    "r_target": "SELECT 'FILE' AS category, concat(source, '/', CASE WHEN doc_id % 13 = 0 THEN concat('moved-', doc_id) ELSE concat('', doc_id) END) AS key, CASE WHEN doc_id % 26 = 0 THEN ' ' WHEN doc_id % 11 = 0 THEN sha2(concat(coalesce(text, ''), '!'), 256) ELSE sha2(coalesce(text, ''), 256) END AS fingerprint FROM documents WHERE doc_id % 7 <> 0",
    "g_commits": "SELECT o_orderkey AS commit_id, o_custkey % 20 AS project_id, md5(concat('c', o_orderkey)) AS sha, o_orderdate AS committed_at FROM orders",
    "g_samples": "SELECT user_id AS run, event_id AS seq, CAST(unix_millis(CAST(date_trunc('second', ts) AS TIMESTAMP)) AS BIGINT) AS t_ms, value FROM events",
    "g_usage": "SELECT user_id, ts, event_id, CAST(floor(coalesce(value, 0)) AS BIGINT) AS tokens FROM events",
    "g_requests": """SELECT o_custkey % 40 AS installation, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'SETTLED' WHEN 'O' THEN 'RESERVED' ELSE 'DISPATCHED' END AS status,
 CAST(floor(o_totalprice) AS BIGINT) AS reserved, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice / 2) AS BIGINT) END AS actual, CAST(o_orderkey % 1000 AS BIGINT) AS floor FROM orders""",
    "g_endpoints": "SELECT DISTINCT CASE WHEN page_id % 4 = 0 THEN 'ANY' WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[0-9]+$', '{id}') AS path FROM pages",
    "g_calls": """SELECT concat('page:', page_id) AS caller, CASE WHEN page_id % 3 = 0 THEN 'GET' ELSE 'post' END AS method, concat(CASE WHEN page_id % 5 = 0 THEN concat('/api', regexp_replace(url, '^[a-z]+://[^/]*', '')) WHEN page_id % 7 = 0 THEN regexp_replace(url, '[0-9]+$', ':id') WHEN page_id % 2 = 0 THEN regexp_replace(url, '[0-9]+$', '{id}') ELSE regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[0-9]+$', '{id}') END, CASE page_id % 4 WHEN 1 THEN '/' WHEN 2 THEN '?q=1' ELSE '' END) AS path FROM pages
 UNION ALL SELECT concat('page:', page_id), 'get', regexp_extract(html, 'href="([^"]*)', 1) FROM pages""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; only the given tables it names are opened."""
    sql = VIEWS[name]
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        if f"FROM {t}" in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def with_views(sql: str) -> str:
    """`sql` with the views it names, for DuckDB."""
    used = [n for n in VIEWS if n in sql]
    duck = lambda s: s.replace("unix_millis(", "epoch_ms(").replace("sha2(", "sha256(").replace(", 256)", ")").replace(" div ", " // ").replace("array(", "list_value(")
    head = ",\n".join(f"{n} AS ({duck(VIEWS[n])})" for n in used)
    return f"WITH RECURSIVE {head}{', ' if used and sql.startswith('+') else ''}{sql.removeprefix('+')}" if used else sql
