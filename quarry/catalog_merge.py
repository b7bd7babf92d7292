"""Registered queries over notes and paths, digests and merged histories; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.operators import digests as G
from quarry.operators import matching as K
from quarry.operators import records as R
from quarry.plans.derived import VIEWS, view

VIEWS.update({
    "k_notes": "SELECT conv_id % 7 AS project_id, conv_id * 1000 + turn AS id, concat(role, ' ', turn) AS title, concat(coalesce(text, ''), CASE conv_id % 5 WHEN 0 THEN concat(' see SRC/', turn, '/F', conv_id % 40, '.Java:7') WHEN 1 THEN concat('xweb/p', conv_id % 30, '.tsx,') WHEN 2 THEN ' read the Makefile2' ELSE '' END) AS content_md, CASE WHEN turn % 6 <> 5 THEN turn * 100000 + conv_id % 900 END AS updated_at FROM conversations",
    "k_refs": "SELECT conv_id * 1000 + turn AS note_id, CASE WHEN turn % 2 = 0 THEN 'FILE' ELSE 'NODE' END AS subject_type, concat('src/', turn, '/F', conv_id % 40, '.java') AS raw_target FROM conversations WHERE conv_id % 3 = 0",
    "k_paths": "SELECT DISTINCT conv_id % 7 AS project_id, concat('src/', turn, '/F', conv_id % 40, '.java') AS path FROM conversations UNION SELECT DISTINCT conv_id % 7, concat('web/p', conv_id % 30, '.tsx') FROM conversations UNION SELECT DISTINCT conv_id % 7, 'makefile' FROM conversations UNION SELECT DISTINCT conv_id % 7, 'a.b' FROM conversations UNION SELECT DISTINCT conv_id % 7, '--' FROM conversations",
    "d_files": "SELECT doc_id % 3 AS snapshot_id, concat(lang, '/F', doc_id, '.java') AS path, n_chars AS size, sha2(coalesce(text, ''), 256) AS content_hash FROM documents WHERE doc_id % 11 <> 0",
    "d_now": "SELECT doc_id % 3 + CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END AS snapshot_id, concat(lang, '/F', doc_id, '.java') AS path, n_chars AS size, CASE WHEN doc_id % 3 = 1 AND doc_id % 5 = 0 THEN 'other' ELSE sha2(coalesce(text, ''), 256) END AS content_hash FROM documents WHERE doc_id % 11 <> 0",
    "d_tree": "SELECT doc_id % 3 AS project_id, concat(lang, '/F', doc_id, CASE doc_id % 5 WHEN 0 THEN '.java' WHEN 1 THEN '.ts' WHEN 2 THEN '.py' ELSE '.txt' END) AS path, false AS directory, sha2(coalesce(text, ''), 256) AS content_hash, NOT (doc_id % 3 = 1 AND doc_id % 20 = 10) AS inventoried FROM documents UNION ALL SELECT DISTINCT doc_id % 3, lang, true, CAST(NULL AS STRING), false FROM documents WHERE lang IS NOT NULL",
    "h_old": "SELECT o_custkey % 20 AS project_id, md5(concat('c', o_orderkey)) AS sha, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS committed_at, concat('old ', o_orderkey) AS message, o_orderkey FROM orders WHERE o_orderkey % 5 <> 0",
    "h_new": "SELECT o_custkey % 20 AS project_id, md5(concat('c', o_orderkey)) AS sha, CASE WHEN o_orderkey % 60 <> 0 THEN o_orderdate END AS committed_at, concat('new ', o_orderkey) AS message, o_orderkey FROM orders WHERE o_orderkey % 3 = 0",
    "h_oldfiles": "SELECT project_id, sha, concat('f', o_orderkey % 9) AS path, 'ADD' AS change_type FROM h_old UNION ALL SELECT project_id, sha, 'pom.xml', 'MODIFY' FROM h_old WHERE o_orderkey % 2 = 0",
    "h_newfiles": "SELECT project_id, sha, concat('f', o_orderkey % 7) AS path, 'DELETE' AS change_type FROM h_new WHERE o_orderkey % 4 <> 0",
    "h_refs": "SELECT n_nationkey AS project_id, 'BRANCH' AS kind, n_name AS name, md5(n_name) AS head_sha FROM nation",
    "h_newrefs": "SELECT n_nationkey AS project_id, 'TAG' AS kind, concat('v', n_regionkey) AS name, md5(concat('', n_regionkey)) AS head_sha FROM nation",
    "h_scanned": "SELECT n_nationkey AS project_id FROM nation WHERE n_nationkey % 4 = 0",
})


@query("""+ m AS (SELECT p.project_id, p.path, n.id, title, updated_at FROM k_paths p JOIN k_notes n ON n.project_id = p.project_id AND (contains(lower(content_md), lower(p.path)) OR EXISTS (FROM k_refs r WHERE r.note_id = n.id AND r.subject_type = 'FILE' AND r.raw_target = p.path)))
SELECT project_id, path, id, title, row_number() OVER (PARTITION BY project_id, path ORDER BY updated_at DESC NULLS FIRST, id DESC)::INT AS place FROM m QUALIFY place <= 5""")
def notes_for_paths(spark, d):
    """The newest five notes about each path (five is the feature)."""
    return K.notes_for_paths(view(spark, d, "k_notes"), view(spark, d, "k_refs"), view(spark, d, "k_paths"))


def _field(*columns: str) -> str:
    return " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR || ';', '-;')" for c in columns)


def _tree(name: str, source: str, key: str, leaf: str) -> str:
    """Two levels: enough for 65 536 rows a key."""
    return f"""{name}0 AS (SELECT {key}, sha256({leaf}) AS h, row_number() OVER (PARTITION BY {key} ORDER BY path) - 1 AS k, count(*) OVER (PARTITION BY {key}) AS n FROM {source}),
{name}1 AS (SELECT {key}, k // 256 AS k, sha256(string_agg(h, ',' ORDER BY k)) AS h, max(n) AS n FROM {name}0 GROUP BY {key}, k // 256), {name} AS (SELECT {key}, CASE WHEN max(n) <= 256 THEN max(h) ELSE sha256(string_agg(h, ',' ORDER BY k)) END AS digest, max(n) AS n FROM {name}1 GROUP BY {key})"""


def _manifest(name: str, source: str) -> str:
    return f"""{_tree('t_' + name, source, 'snapshot_id', _field('path', "'REGULAR_FILE'", 'size', 'content_hash'))}, {name} AS (SELECT snapshot_id, sha256({_field("'p1'", "''", 'digest', 'n', 'bytes')}) AS digest, n AS files, bytes FROM t_{name} JOIN (SELECT snapshot_id, sum(size)::BIGINT AS bytes FROM {source} GROUP BY 1) USING (snapshot_id))"""


@query(f"+ {_manifest('m', 'd_files')} FROM m")
def manifest_digest(spark, d):
    """What seals each snapshot's files."""
    return G.manifest_digest(view(spark, d, "d_files"), "p1")


@query(f"""+ {_manifest('m', 'd_files')}, {_manifest('w', 'd_now')}
SELECT coalesce(m.snapshot_id, w.snapshot_id) AS snapshot_id, CASE WHEN m.digest IS NULL THEN 'UNSEALED' WHEN w.digest IS NULL THEN 'MISSING' WHEN m.digest = w.digest THEN 'VALID' WHEN m.files = w.files AND m.bytes = w.bytes THEN 'CHANGED' ELSE 'COUNT' END AS verdict FROM m FULL JOIN w ON m.snapshot_id = w.snapshot_id""")
def verified_seals(spark, d):
    """Seals held against files of which some have changed or moved to another snapshot."""
    return G.verify_seal(view(spark, d, "d_now"), G.manifest_digest(view(spark, d, "d_files"), "p1"), "p1")


SEEN = "CASE WHEN NOT directory AND NOT (path LIKE '%.java' AND inventoried) AND NOT regexp_matches(path, '[.](ts|py)$') THEN content_hash END"


@query(f"""+ x AS (SELECT *, CASE WHEN directory THEN 'directory' ELSE 'file' END AS kind, CASE WHEN NOT directory THEN content_hash END AS content, {SEEN} AS seen FROM d_tree),
{_tree('a', 'x', 'project_id', _field('kind', 'path', 'content'))}, {_tree('b', 'x', 'project_id', _field('kind', 'path', 'seen'))}
SELECT project_id, a.digest AS complete, b.digest AS environment, (SELECT bool_and(NOT path LIKE '%.java' OR inventoried) FROM d_tree t WHERE t.project_id = a.project_id) AS java_complete FROM a JOIN b USING (project_id)""")
def environment_hashes(spark, d):
    return G.environment_hash(view(spark, d, "d_tree"))


def _history(spark, d):
    out = {}
    for n in ("h_old", "h_new", "h_oldfiles", "h_newfiles", "h_refs", "h_newrefs", "h_scanned"):
        out[n] = view(spark, d, n)
        out[n].createOrReplaceTempView(n)
    return out


@query("""+ one AS (SELECT project_id, sha, committed_at, message, true AS incoming FROM h_new UNION ALL SELECT project_id, sha, committed_at, message, false FROM h_old o WHERE NOT EXISTS (FROM h_new n WHERE n.project_id = o.project_id AND n.sha = o.sha)),
c AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY committed_at DESC NULLS LAST, sha) <= 300), f AS (SELECT DISTINCT c.project_id, c.sha, path, change_type FROM h_newfiles x JOIN c USING (project_id, sha) WHERE incoming UNION SELECT c.project_id, c.sha, path, change_type FROM h_oldfiles x JOIN c USING (project_id, sha) WHERE NOT incoming)
SELECT 'COMMIT' AS kind, project_id, sha AS key, NULL::VARCHAR AS child, message AS detail FROM c UNION ALL SELECT 'FILE', project_id, sha, path, change_type FROM f
UNION ALL SELECT kind, project_id, name, NULL, head_sha FROM h_refs WHERE project_id NOT IN (FROM h_scanned) UNION ALL SELECT kind, project_id, name, NULL, head_sha FROM h_newrefs WHERE project_id IN (FROM h_scanned)""")
def replaced_history(spark, d):
    """A scan's commits, files and refs in place of the stored ones (the cap is the feature)."""
    v = _history(spark, d)
    drop = lambda n: v[n].drop("o_orderkey")
    return R.replace_history(drop("h_old"), v["h_oldfiles"], v["h_refs"], drop("h_new"), v["h_newfiles"], v["h_newrefs"], v["h_scanned"], 300)
