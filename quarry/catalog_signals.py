"""Registered queries over signals, trees, summaries and phases; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.catalog_identity import BLOCKED
from quarry.operators import signals as S
from quarry.plans.derived import VIEWS, view

VIEWS.update({
    "q_features": """SELECT concat('r', r_regionkey) AS id, CAST(NULL AS STRING) AS parent_id, r_name AS name FROM region
 UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM nation
 UNION ALL SELECT concat('c', c_custkey), concat('n', CASE WHEN c_custkey % 31 = 0 THEN 99 ELSE c_nationkey END), c_name FROM customer
 UNION ALL SELECT concat('s', s_suppkey), concat('c', s_suppkey * 3), s_name FROM supplier""",
    "q_imports": """SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN concat('{"schemaVersion":1,"policyVersion":"local-ingest-v1","acceptedFiles":', n_chars) WHEN 1 THEN concat('{"schemaVersion":1,"policyVersion":"local-ingest-v1","acceptedFiles":"', n_chars, '","bytesRead":1,"excludedEntriesByReason":{}}')
 WHEN 2 THEN concat('{"schemaVersion":1,"policyVersion":"local-ingest-v1","acceptedFiles":', n_chars, ',"bytesRead":1,"excludedEntriesByReason":{"OTHER":1}}') WHEN 3 THEN concat('{"schemaVersion":2,"policyVersion":"local-ingest-v1","acceptedFiles":', n_chars, ',"bytesRead":1,"excludedEntriesByReason":{}}')
 WHEN 4 THEN concat('{"schemaVersion":1,"policyVersion":"local-ingest-v1","acceptedFiles":', n_chars, ',"bytesRead":1.5,"excludedEntriesByReason":{}}') WHEN 5 THEN concat('{"schemaVersion":1,"policyVersion":"local-ingest-v1","acceptedFiles":', n_chars, ',"bytesRead":1,"more":1,"excludedEntriesByReason":{}}')
 WHEN 6 THEN concat('{"schemaVersion":1,"policyVersion":"local-ingest-v1","acceptedFiles":', n_chars, ',"bytesRead":7,"excludedEntriesByReason":{"IGNORED":', 1000 * n_chars, '}}')
 ELSE concat('{"bytesRead":', 1000 * n_chars, ',"schemaVersion":1,"policyVersion":"local-ingest-v1","acceptedFiles":', 10 * n_chars, ',"excludedEntriesByReason":{"BINARY":', doc_id % 5, ',"SYMLINK":2}}') END AS excerpt, n_chars FROM documents""",
    "q_samples": "SELECT user_id AS run, event_type AS phase, CAST(unix_millis(CAST(date_trunc('second', ts) AS TIMESTAMP)) AS BIGINT) AS t_ms, value, event_id % 700 <> 3 AS owner FROM events",
    "q_phases": "SELECT run, phase, min(t_ms) - 60000 AS start_ms, max(t_ms) + 90000 AS end_ms FROM q_samples GROUP BY run, phase",
    "q_outcomes": "SELECT concat('a/S', s_suppkey, '.java') AS path, CASE s_suppkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM supplier WHERE s_suppkey % 7 <> 0",
})

RULES = [
    S.Signal("BACKEND", "Java", 0.25, "PATH", "**/main/*.java"),
    S.Signal("BACKEND", "License", 0.25, "CONTENT", "**/*.java", ("copyright", "license")),
    S.Signal("OTHER", "Secrets", 0.55, "MENTION", "**/none.xml", ("password",)),
    S.Signal("OTHER", "Tokens", 0.55, "MENTION", "**/*.sql", ("TOKEN",), ("no such word",)),
    S.Signal("OTHER", "Never", 0.55, "PATH", "**/*.py", (), ("password",)),
]
MAY = lambda token: f"coalesce(bool_or(regexp_matches(path, '/[^/]*[.]md$') AND contains(lower(text), '{token}')), false)"


@query(f"""+ g AS (SELECT snapshot_id, min(path) AS f, min(path) FILTER (regexp_matches(path, '(^|/)main/[^/]*[.]java$')) AS java, min(path) FILTER (path LIKE '%.java' AND (contains(text, 'copyright') OR contains(text, 'license'))) AS lic,
 min(path) FILTER (path LIKE '%.sql') AS sq, min(path) FILTER (path LIKE '%.py') AS py, {MAY('password')} AS pw, {MAY('token')} AS tk, {MAY('no such word')} AS no FROM n_files GROUP BY 1)
SELECT snapshot_id, 'BACKEND' AS area, 'Java' AS technology, 0.25::DOUBLE AS weight, java AS path, NULL::VARCHAR AS detail FROM g WHERE java IS NOT NULL
UNION ALL SELECT g.snapshot_id, 'BACKEND', 'License', 0.25, lic, CASE WHEN contains(text, 'copyright') THEN 'copyright' ELSE 'license' END FROM g JOIN n_files n ON n.snapshot_id = g.snapshot_id AND n.path = lic
UNION ALL SELECT snapshot_id, 'OTHER', 'Secrets', 0.55, f, 'password' FROM g WHERE pw UNION ALL SELECT snapshot_id, 'OTHER', 'Tokens', 0.55, coalesce(sq, f), 'TOKEN' FROM g WHERE tk AND NOT no
UNION ALL SELECT snapshot_id, 'OTHER', 'Never', 0.55, py, NULL FROM g WHERE py IS NOT NULL AND NOT pw""")
def detection_signals(spark, d):
    """Rules of all kinds over every file, with the Markdown files as manifests."""
    return S.detect_signals(view(spark, d, "n_files"), RULES, ["**/*.md"])


@query("""+ t AS (SELECT id, parent_id, id AS root_id, 0 AS depth, name AS trail FROM q_features WHERE parent_id IS NULL
 UNION ALL SELECT q.id, q.parent_id, t.root_id, t.depth + 1, concat(t.trail, ' / ', q.name) FROM t JOIN q_features q ON q.parent_id = t.id) FROM t""")
def feature_tree(spark, d):
    return S.feature_tree(view(spark, d, "q_features")).withColumn("trail", F.array_join("trail", " / "))


@query("""SELECT doc_id, CASE WHEN doc_id % 12 = 6 THEN n_chars::INT ELSE (10 * n_chars)::INT END AS accepted_files, CASE WHEN doc_id % 12 = 6 THEN 7 ELSE 1000 * n_chars END::BIGINT AS bytes_read,
 CASE WHEN doc_id % 12 = 6 THEN concat('IGNORED=', 1000 * n_chars) ELSE concat('BINARY=', doc_id % 5, ',SYMLINK=2') END AS excluded FROM documents
WHERE (doc_id % 12 = 6 AND 1000 * n_chars + n_chars <= 200000) OR (doc_id % 12 > 6 AND 10 * n_chars <= 50000 AND 1000 * n_chars <= 536870912 AND 10 * n_chars + doc_id % 5 + 2 <= 200000)""")
def import_summaries(spark, d):
    s = view(spark, d, "q_imports").select("doc_id", S.import_summary(F.col("excerpt")).alias("s")).filter("s IS NOT NULL")
    pairs = F.transform(F.map_entries("s.excluded"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return s.select("doc_id", "s.accepted_files", "s.bytes_read", F.array_join(pairs, ",").alias("excluded"))


@query("""+ r AS (SELECT run, phase, t_ms, value, 1 AS k FROM q_samples UNION ALL SELECT run, phase, start_ms, NULL, 0 FROM q_phases UNION ALL SELECT run, phase, end_ms, NULL, 0 FROM q_phases),
l AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY run, phase ORDER BY t_ms) AS gap FROM r)
SELECT run, phase, sum(k)::BIGINT AS n, max(gap)::BIGINT AS max_gap, max(value) AS peak, sum(k) > 0 AND max(gap) <= 50000000 AND run NOT IN (SELECT run FROM q_samples WHERE NOT owner) AS complete FROM l GROUP BY run, phase""")
def phase_sampling(spark, d):
    samples = view(spark, d, "q_samples")
    samples.createOrReplaceTempView("q_samples")
    return S.phase_sampling(samples, view(spark, d, "q_phases"), 50_000_000)


@query(f"""+ {BLOCKED}, hit AS (SELECT DISTINCT path FROM i_nodes WHERE natural_key IN (FROM bad)) SELECT path, CASE WHEN h.path IS NOT NULL AND coalesce(status, '') <> 'FAILED' THEN 'PARTIAL' ELSE status END AS status FROM q_outcomes FULL JOIN hit h USING (path)""")
def guarded_outcomes(spark, d):
    return S.guarded_outcomes(view(spark, d, "i_nodes"), view(spark, d, "q_outcomes"))
