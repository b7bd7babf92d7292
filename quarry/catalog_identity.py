"""Registered queries over identities, seeds, references and personal data; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import catalog_records  # noqa: F401  # its views are used below
from quarry.catalog import query
from quarry.functions import privacy as P
from quarry.operators import identity as I
from quarry.operators import records as R
from quarry.plans.derived import VIEWS, view
from quarry.sources.tables import read_table

VIEWS.update({
    "i_nodes": """SELECT concat('java:com.S', s_suppkey) AS natural_key, 'CLASS' AS node_type, concat('a/S', s_suppkey, '.java') AS path, 1 AS line_start FROM supplier
 UNION ALL SELECT concat('java:com.S', s_suppkey), 'CLASS', concat('b/S', s_suppkey, '.java'), 1 FROM supplier WHERE s_suppkey % 10 = 0
 UNION ALL SELECT concat('java:com.S', l_suppkey, '#m', l_partkey % 50), 'METHOD', concat('a/S', l_suppkey, '.java'), l_linenumber FROM lineitem""",
    "i_edges": "SELECT concat('java:com.S', l_suppkey, '#m', l_partkey % 50) AS source, concat('java:com.S', l_suppkey % 13 + 1) AS target FROM lineitem",
    "i_seeds": "SELECT concat('c', o_custkey % 500) AS name, o_orderstatus = 'O' AS endpoint, concat('order:', o_orderkey % 4000) AS node FROM orders",
    "i_paths": "SELECT concat(role, '/', turn, '.md') AS key, conv_id AS id FROM conversations WHERE turn % 2 = 0",
    "i_titles": "SELECT concat('note ', conv_id) AS key, concat(conv_id, '-', turn) AS id FROM conversations WHERE turn < 2",
    "i_links": "SELECT event_id AS evidence_id, CASE WHEN event_id % 3 = 0 THEN 'FLOW' ELSE 'NODE' END AS subject_type, user_id AS subject_id FROM events",
    "i_subjects": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'FLOW' ELSE 'NODE' END AS subject_type, c_custkey AS subject_id, c_nationkey AS snapshot_id FROM customer",
    "i_evidence": "SELECT event_id AS evidence_id, event_type AS kind FROM events",
})

BLOCKED = """own AS (SELECT natural_key, bool_or(node_type = 'CLASS') AS t FROM i_nodes GROUP BY 1 HAVING count(DISTINCT path) > 1),
bad AS (SELECT natural_key FROM own UNION SELECT n.natural_key FROM (SELECT DISTINCT natural_key FROM i_nodes) n JOIN own ON t AND (starts_with(n.natural_key, own.natural_key || '#') OR starts_with(n.natural_key, own.natural_key || '.')))"""


@query(f"""+ {BLOCKED} SELECT natural_key, node_type, path, line_start FROM i_nodes WHERE natural_key NOT IN (FROM bad)
UNION ALL SELECT natural_key, 'AMBIGUOUS', NULL, NULL FROM bad""")
def guarded_nodes(spark, d):
    return I.guard_identities(view(spark, d, "i_nodes"), view(spark, d, "i_edges"))[0]


@query(f"+ {BLOCKED} SELECT source, target FROM i_edges WHERE source NOT IN (FROM bad) AND target NOT IN (FROM bad)")
def guarded_edges(spark, d):
    return I.guard_identities(view(spark, d, "i_nodes"), view(spark, d, "i_edges"))[1].select("source", "target")


@query("SELECT DISTINCT name, node FROM i_seeds WHERE endpoint")
def feature_seeds(spark, d):
    return I.drop_package_seeds(view(spark, d, "i_seeds"))


@query("""+ x AS (SELECT note, 'FILE' AS kind, unnest(regexp_extract_all(body, '@file(?::|\\s+)(\\S+)', 1)) AS target FROM r_notes UNION ALL SELECT note, 'TASK', unnest(regexp_extract_all(body, '@task(?::|\\s+)([0-9]+)', 1)) FROM r_notes
 UNION ALL SELECT note, 'NOTE', unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)) FROM r_notes), r AS (SELECT DISTINCT note, kind, trim(target) AS target FROM x),
k AS (SELECT 'FILE' AS kind, key, id::VARCHAR AS id FROM i_paths UNION ALL SELECT 'TASK', o_orderkey::VARCHAR, o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'NOTE', key, id FROM i_titles)
SELECT note, r.kind, target, min(id) AS subject FROM r LEFT JOIN k ON r.kind = k.kind AND target = key AND (r.kind <> 'NOTE' OR id <> note) GROUP BY ALL""")
def note_subjects(spark, d):
    refs = view(spark, d, "r_notes").select("note", F.explode(R.note_refs(F.col("body"))).alias("r")).select("note", "r.kind", "r.target")
    nodes = read_table(spark, d, "supplier").select(F.col("s_name").alias("key"), F.col("s_suppkey").alias("id"))
    orders = read_table(spark, d, "orders")
    commits = orders.select(F.md5(F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderkey").alias("id"))
    return I.resolve_note_refs(refs, view(spark, d, "i_paths"), nodes, commits, orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("id")), view(spark, d, "i_titles"))


@query("SELECT subject_id, l.evidence_id, kind FROM i_links l JOIN i_evidence USING (evidence_id) WHERE subject_type = 'NODE' AND subject_id IN (SELECT subject_id FROM i_subjects WHERE subject_type = 'NODE')")
def evidence_of_nodes(spark, d):
    nodes = view(spark, d, "i_subjects").filter("subject_type = 'NODE'")
    return I.evidence_of(nodes, view(spark, d, "i_links"), view(spark, d, "i_evidence"), "NODE").select("subject_id", "evidence_id", "kind")


@query("SELECT DISTINCT evidence_id, snapshot_id FROM i_links JOIN i_subjects USING (subject_type, subject_id)")
def evidence_snapshots(spark, d):
    return I.evidence_snapshots(view(spark, d, "i_links"), view(spark, d, "i_subjects"))


@query(None)
def masked_documents(spark, d):
    """Documents whose text holds personal data, masked."""
    m = read_table(spark, d, "documents").select("doc_id", "text", P.mask_pii(F.col("text")).alias("masked"))
    return m.filter("masked <> text").select("doc_id", "masked")


@query(None)
def secret_files(spark, d):
    """Files with secrets; plain values count in configuration files."""
    f = view(spark, d, "g_files")
    return f.filter(P.contains_secret(F.col("text"), F.col("path").rlike(r"\.(ya?ml|properties|ini|toml|txt|conf|config)$"))).select("path", P.redact_secrets(F.col("text")).alias("redacted"))
