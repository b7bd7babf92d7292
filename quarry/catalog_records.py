"""Registered queries over evidence, judgments, commits and annotations; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.operators import records as R
from quarry.plans.derived import VIEWS, view

VIEWS.update({
    "r_entities": "SELECT o_orderkey AS entity, concat('Order', o_orderkey % 3000) AS name, concat('t', o_custkey) AS table_key FROM orders",
    "r_tables": "SELECT concat('t', c_custkey) AS table_key, concat('ORDER', c_custkey * 2 % 700) AS name FROM customer WHERE c_custkey % 5 <> 0",
    "r_repos": "SELECT concat('r', s_suppkey) AS repo, concat(s_name, 'Repository') AS name FROM supplier",
    "r_mapped": "SELECT concat('com.shop.Supplier#', lpad(CAST(p_partkey AS STRING), 9, '0')) AS entity, concat('#0000000', p_partkey % 90) AS table_name FROM part",
    "r_unresolved": "SELECT o_orderkey AS call, concat('m', o_custkey) AS name FROM orders",
    "r_methods": "SELECT s_suppkey AS method, concat('m', s_suppkey % 40) AS name FROM supplier",
    "r_claims": """SELECT event_id % 3000 AS claim, event_type AS confidence, CASE event_id % 3 WHEN 0 THEN concat('file:doc/', event_id % 500, ':', event_id % 40)
 WHEN 1 THEN concat('commit:', substr(md5(concat('c', event_id)), 1, CAST(7 + event_id % 5 AS INT))) ELSE concat('pr:', event_id) END AS ref FROM events""",
    "r_lines": "SELECT concat('doc/', doc_id) AS path, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 30 END AS line_count FROM documents",
    "r_shas": "SELECT md5(concat('c', o_orderkey)) AS sha FROM orders",
    "r_pulls": "SELECT o_orderkey AS number FROM orders WHERE o_orderstatus <> 'F'",
    "r_findings": "SELECT o_orderkey AS stable_key, '2' AS rule_version, concat('f', o_custkey % 10) AS fingerprint FROM orders",
    "r_judgments": "SELECT o_orderkey AS stable_key, CASE o_orderkey % 4 WHEN 0 THEN 'FALSE_POSITIVE' WHEN 1 THEN 'ACCEPTED' ELSE 'FIXED' END AS status, CASE WHEN o_orderkey % 9 = 0 THEN '1' ELSE '2' END AS rule_version, concat('f', o_custkey % 12) AS fingerprint FROM orders WHERE o_orderkey % 3 <> 0",
    "r_current": "SELECT doc_id AS file, sha2(coalesce(text, ''), 256) AS content_hash FROM documents",
    "r_summaries": "SELECT doc_id AS file, CASE doc_id % 3 WHEN 0 THEN sha2(coalesce(text, ''), 256) WHEN 1 THEN 'stale' END AS content_hash, concat('s', doc_id) AS content FROM documents",
    "r_old_commits": "SELECT o_custkey % 20 AS project_id, md5(concat('c', o_orderkey)) AS sha, o_orderdate AS committed_at, 'old' AS message FROM orders WHERE o_orderkey % 2 = 0",
    "r_new_commits": "SELECT o_custkey % 20 AS project_id, md5(concat('c', o_orderkey)) AS sha, o_orderdate AS committed_at, 'new' AS message FROM orders WHERE o_orderkey % 3 = 0",
    "r_old_evidence": "SELECT conv_id AS subject, turn AS line, role AS kind FROM conversations",
    "r_new_evidence": "SELECT conv_id AS subject, turn + 100 AS line, role AS kind FROM conversations WHERE conv_id % 3 = 0 AND turn % 2 = 0",
    "r_gold_a": "SELECT doc_id AS case_id, quality, toxic FROM labels WHERE doc_id % 11 <> 0",
    "r_gold_b": "SELECT doc_id AS case_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality, CASE WHEN doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END AS toxic FROM labels WHERE doc_id % 13 <> 0",
    "r_notes": "SELECT concat(conv_id, '-', turn) AS note, concat('see @file:', role, '/', turn, '.md [[ note ', conv_id, ' ]] @task ', turn, ' ', coalesce(text, '')) AS body FROM conversations",
})


@query("""+ n AS (SELECT lower(name) AS k, max(table_key) AS t FROM r_tables GROUP BY 1)
SELECT entity, coalesce(t, r_tables.table_key) AS target, CASE WHEN t IS NOT NULL THEN 'NAME' ELSE 'KEY' END AS how FROM r_entities e LEFT JOIN n ON lower(e.name) = k LEFT JOIN r_tables ON e.table_key = r_tables.table_key WHERE target IS NOT NULL""")
def link_maps_to(spark, d):
    return R.link_maps_to(view(spark, d, "r_entities"), view(spark, d, "r_tables"))


@query("""SELECT DISTINCT repo, table_name FROM r_repos JOIN r_mapped ON lower(regexp_replace(name, 'Repository$', '')) = lower(string_split(entity, '.')[-1]) OR contains(lower(name), lower(table_name))""")
def link_reads_writes(spark, d):
    return R.link_reads_writes(view(spark, d, "r_repos"), view(spark, d, "r_mapped"))


@query("SELECT call, method, CASE WHEN method IS NULL THEN 'EXTERNAL_TARGET' ELSE 'POSSIBLE' END AS outcome FROM r_unresolved LEFT JOIN r_methods USING (name)")
def call_candidates(spark, d):
    return R.call_candidates(view(spark, d, "r_unresolved"), view(spark, d, "r_methods"))


@query("""+ f AS (SELECT * FROM r_lines), good AS (
 SELECT claim, ref FROM r_claims WHERE ref LIKE 'file:%' AND EXISTS (SELECT 1 FROM f WHERE path = string_split(ref, ':')[2] AND (line_count IS NULL OR line_count >= string_split(ref, ':')[3]::BIGINT))
 UNION ALL SELECT claim, ref FROM r_claims WHERE ref LIKE 'commit:%' AND EXISTS (SELECT 1 FROM r_shas WHERE substr(sha, 1, 7) = substr(ref, 8, 7) AND starts_with(sha, substr(ref, 8)))
 UNION ALL SELECT claim, ref FROM r_claims WHERE ref LIKE 'pr:%' AND substr(ref, 4)::BIGINT IN (SELECT number FROM r_pulls)),
k AS (SELECT claim, string_agg(ref, ',' ORDER BY ref) AS kept FROM good GROUP BY claim), c AS (SELECT claim, max(upper(confidence)) AS conf FROM r_claims GROUP BY claim)
SELECT claim, coalesce(kept, '') AS kept, CASE WHEN kept IS NULL THEN 'UNKNOWN' ELSE conf END AS confidence FROM c LEFT JOIN k USING (claim)""")
def validate_claims(spark, d):
    return R.validate_claims(*[view(spark, d, n) for n in ("r_claims", "r_lines", "r_shas", "r_pulls")])


@query("""+ s AS (SELECT f.stable_key, CASE WHEN f.rule_version = j.rule_version AND f.fingerprint = j.fingerprint THEN j.status ELSE 'NEEDS_REVIEW' END AS status FROM r_findings f LEFT JOIN r_judgments j USING (stable_key))
SELECT stable_key, status, false AS hidden FROM s WHERE status <> 'FALSE_POSITIVE'""")
def overlay_judgments(spark, d):
    return R.overlay_judgments(view(spark, d, "r_findings"), view(spark, d, "r_judgments"))


@query("SELECT c.file, content FROM r_current c JOIN r_summaries s USING (file) WHERE s.content_hash IS NULL OR s.content_hash = c.content_hash")
def valid_summaries(spark, d):
    return R.valid_summaries(view(spark, d, "r_current"), view(spark, d, "r_summaries"))


@query("""+ u AS (SELECT * FROM r_new_commits UNION ALL SELECT * FROM r_old_commits WHERE sha NOT IN (SELECT sha FROM r_new_commits))
SELECT *, greatest(count(*) OVER (PARTITION BY project_id) - 300, 0) AS omitted FROM u QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY committed_at DESC NULLS LAST, sha) <= 300""")
def merge_commits(spark, d):
    """Two loads of commits; the newest 300 of a project (the cap is the feature)."""
    return R.merge_commits(view(spark, d, "r_old_commits"), view(spark, d, "r_new_commits"), 300)


@query("SELECT * FROM r_old_evidence WHERE subject NOT IN (SELECT subject FROM r_new_evidence) UNION ALL SELECT * FROM r_new_evidence")
def replace_evidence(spark, d):
    return R.replace_evidence(view(spark, d, "r_old_evidence"), view(spark, d, "r_new_evidence"))


@query("""SELECT coalesce(a.case_id, b.case_id) AS "case", CASE WHEN b.case_id IS NULL THEN 'ONLY_A' WHEN a.case_id IS NULL THEN 'ONLY_B' WHEN a.quality IS DISTINCT FROM b.quality OR a.toxic IS DISTINCT FROM b.toxic THEN 'DIFFERENT' ELSE 'AGREED' END AS kind,
CASE WHEN a.case_id IS NOT NULL AND b.case_id IS NOT NULL THEN nullif(concat_ws(',', CASE WHEN a.quality IS DISTINCT FROM b.quality THEN 'quality' END, CASE WHEN a.toxic IS DISTINCT FROM b.toxic THEN 'toxic' END), '') END AS fields FROM r_gold_a a FULL JOIN r_gold_b b USING (case_id)""")
def annotator_differences(spark, d):
    a, b = (view(spark, d, n).withColumnRenamed("case_id", "case") for n in ("r_gold_a", "r_gold_b"))
    return R.annotator_differences(a, b, ["quality", "toxic"])


@query("+ x AS (SELECT (SELECT count(*) FROM (FROM g_base EXCEPT ALL FROM g_target)) AS only_left, (SELECT count(*) FROM (FROM g_target EXCEPT ALL FROM g_base)) AS only_right) SELECT *, only_left = 0 AND only_right = 0 AS equal FROM x")
def compare_dumps(spark, d):
    return R.compare_dumps(view(spark, d, "g_base"), view(spark, d, "g_target"))


@query("""+ x AS (SELECT note, 'FILE' AS kind, unnest(regexp_extract_all(body, '@file(?::|\\s+)(\\S+)', 1)) AS target FROM r_notes UNION ALL SELECT note, 'TASK', unnest(regexp_extract_all(body, '@task(?::|\\s+)([0-9]+)', 1)) FROM r_notes
 UNION ALL SELECT note, 'NOTE', unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)) FROM r_notes) SELECT note, kind, trim(target) AS target FROM x""")
def note_references(spark, d):
    return view(spark, d, "r_notes").select("note", F.explode(R.note_refs(F.col("body"))).alias("r")).select("note", "r.kind", "r.target")
