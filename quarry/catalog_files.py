"""Registered queries over files, their outcomes, history and comparisons; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.functions import text as T
from quarry.operators import compare as C
from quarry.operators import coverage as O
from quarry.operators import history as H
from quarry.operators import ingest as N
from quarry.operators import tables as A
from quarry.plans.derived import VIEWS, view
from quarry.sources.tables import read_table

EXTENSION = "CASE doc_id % 7 WHEN 0 THEN '.java' WHEN 1 THEN '.tsx' WHEN 2 THEN '.sql' WHEN 3 THEN '.md' WHEN 4 THEN '.py' WHEN 5 THEN '.kt' ELSE '.bin' END"
LANG = "CASE doc_id % 7 WHEN 0 THEN 'java' WHEN 1 THEN 'typescript' WHEN 2 THEN 'sql' WHEN 3 THEN 'markdown' WHEN 4 THEN 'python' WHEN 5 THEN 'kotlin' END"
STATUS = "CASE doc_id % 11 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'UNSUPPORTED' WHEN 4 THEN 'TARGETED' WHEN 5 THEN 'LEGACY_UNMEASURED' ELSE 'UNMEASURED' END"
VIEWS.update({
    "n_files": f"SELECT doc_id % 3 AS snapshot_id, concat(source, '/', lang, '/', CASE WHEN doc_id % 5 = 0 THEN 'test/' WHEN doc_id % 13 = 1 THEN 'build/' ELSE 'main/' END, CASE WHEN doc_id % 37 = 3 THEN '.env' ELSE 'F' END, doc_id, {EXTENSION}) AS path, n_chars AS size, coalesce(text, '') AS text, doc_id % 17 = 0 AS submodule, doc_id FROM documents",
    "n_given": f"SELECT doc_id % 3 AS root, concat(lang, '/', CASE WHEN doc_id % 5 = 0 THEN 'test/' WHEN doc_id % 13 = 1 THEN 'build/' WHEN doc_id % 31 = 4 THEN 'lib/sub/in/' ELSE 'main/' END, CASE WHEN doc_id % 37 = 3 THEN '.env' WHEN doc_id % 13 = 1 AND doc_id % 4 = 0 THEN 'node_modules/F' ELSE 'F' END, doc_id, {EXTENSION}) AS path, n_chars AS size, CASE doc_id % 29 WHEN 0 THEN 'password = \"hunter22\"' WHEN 1 THEN 'token = \"${{X}}\"' ELSE 'plain' END AS text, CASE WHEN doc_id % 19 = 2 THEN 'symlink' WHEN doc_id % 23 = 2 THEN 'hard_link' ELSE 'file' END AS kind FROM documents UNION ALL SELECT DISTINCT doc_id % 2, concat(lang, '/lib/sub/.git'), 10, 'gitdir: x', 'file' FROM documents UNION ALL SELECT doc_id % 3, concat('top', doc_id, '.java'), 10, 'plain', 'file' FROM documents WHERE doc_id % 50 = 0",
    "o_files": f"SELECT doc_id % 3 AS snapshot_id, concat('f', doc_id) AS path, {LANG} AS language, {STATUS} AS status, CASE WHEN doc_id % 4 = 0 THEN 'AMBIGUOUS_SYMBOL_IDENTITY' END AS reason, doc_id % 6 = 0 AS targeted FROM documents",
    "o_given": "SELECT concat('f', doc_id) AS path, CASE doc_id % 5 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'TARGETED' WHEN 3 THEN NULL ELSE 'UNMEASURED' END AS status, CASE doc_id % 3 WHEN 0 THEN 'PARSED' WHEN 1 THEN 'free text' END AS reason FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT concat('f', doc_id), 'SUCCESS', 'AGAIN' FROM documents WHERE doc_id % 10 = 0",
    "o_asked": "SELECT concat('f', doc_id) AS path FROM documents WHERE doc_id % 9 <> 0",
    "o_caps": "SELECT concat('f', doc_id) AS path, CASE doc_id % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'C' WHEN 2 THEN 'F' ELSE 'X' END AS capability, CASE doc_id % 6 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'UNSUPPORTED' WHEN 4 THEN 'TARGETED' ELSE 'UNMEASURED' END AS status FROM documents WHERE doc_id % 8 <> 0",
    "o_events": "SELECT user_id AS path, substr(event_type, 1, 2) AS capability, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM events",
    "o_measured": "SELECT n_regionkey AS snapshot_id, CAST(count(*) AS BIGINT) AS discovered_files, CAST(min(n_nationkey) AS BIGINT) AS excluded_count, CAST(2 AS BIGINT) AS excluded_size, CAST(3 AS BIGINT) AS excluded_binary, CAST(4 AS BIGINT) AS excluded_submodule FROM nation GROUP BY n_regionkey",
    "h_commits": "SELECT o_custkey % 20 AS project_id, md5(concat('c', o_orderkey)) AS sha, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS committed_at FROM orders",
    "h_files": "SELECT o_custkey % 20 AS project_id, md5(concat('c', o_orderkey)) AS sha, CASE o_orderkey % 9 WHEN 0 THEN 'pom.xml' WHEN 1 THEN 'web/package.json' WHEN 2 THEN 'infra/main.tf' WHEN 3 THEN 'go.mod' WHEN 4 THEN 'web/go.mod' ELSE concat('src/', o_custkey % 30, '.java') END AS path, CASE o_orderkey % 4 WHEN 0 THEN 'ADD' WHEN 1 THEN 'DELETE' ELSE 'MODIFY' END AS change_type FROM orders",
    "h_pulls": "SELECT o_custkey % 20 AS project_id, o_orderkey AS number, CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Open' ELSE 'Merged' END AS state, md5(concat('c', o_orderkey)) AS head_sha FROM orders",
    "h_findings": "SELECT l_orderkey % 20 AS project_id, l_orderkey * 10 + l_linenumber AS id, CASE CAST(min(l_quantity) AS INT) % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, min(l_returnflag) AS category, concat('Finding ', min(l_partkey) % 40) AS title, CASE WHEN l_orderkey % 3 = 0 THEN 'DISMISSED' ELSE 'OPEN' END AS status FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "h_places": "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS finding_id, l_partkey AS evidence_id, CASE WHEN l_partkey % 4 <> 0 THEN concat('src/', l_suppkey, '.java') END AS path, CASE WHEN l_partkey % 3 <> 0 THEN l_linenumber END AS line FROM lineitem WHERE l_partkey % 9 <> 0 UNION ALL SELECT DISTINCT l_orderkey * 10 + l_linenumber, -l_suppkey, 'again.java', 7 FROM lineitem WHERE l_linenumber = 2",
    "h_lines": "SELECT md5(concat('c', l_orderkey)) AS sha, concat('p', l_partkey) AS path, CASE WHEN l_quantity >= 20 THEN '+' ELSE '-' END AS sign FROM lineitem",
    "h_snapshots": "SELECT o_custkey % 20 AS project_id, o_orderkey AS snapshot_id, CASE WHEN o_orderstatus = 'F' THEN 'READY' ELSE 'FAILED' END AS status, o_orderkey % 2 = 0 AS legacy FROM orders",
    "h_noted": "SELECT o_orderkey AS snapshot_id FROM orders WHERE o_orderkey % 7 = 0",
    "c_now": "SELECT concat('f', doc_id) AS path, sha2(concat(coalesce(text, ''), CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END), 256) AS content_hash, concat('x', doc_id % 4) AS context_hash FROM documents WHERE doc_id % 7 <> 0",
    "c_was": "SELECT concat('f', doc_id) AS path, sha2(coalesce(text, ''), 256) AS content_hash, concat('x', doc_id % 3) AS context_hash FROM documents WHERE doc_id % 6 <> 0",
    "c_want": "SELECT doc_id AS key, quality AS value FROM labels WHERE doc_id % 9 <> 0 UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 40 = 1 AND doc_id % 9 <> 0",
    "c_is": "SELECT doc_id AS key, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS value FROM labels WHERE doc_id % 8 <> 0 UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 15 = 0",
    "c_skip": "SELECT doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN 1 - quality ELSE quality END AS value FROM labels WHERE doc_id % 9 = 0",
    "c_steps": "SELECT o_orderpriority AS kind, concat('flow', o_custkey) AS name, o_orderkey AS seq, CASE WHEN o_orderkey % 5 <> 0 THEN concat('n', o_custkey % 7) END AS node, o_orderstatus AS description FROM orders",
})

FITS = "size <= 3000 AND NOT path LIKE '%.bin' AND NOT submodule"
INVENTORIED = f"""t AS (SELECT *, {FITS} AS fits FROM n_files), b AS (SELECT *, coalesce(sum(fits::INT) OVER (PARTITION BY snapshot_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t),
i AS (SELECT *, CASE WHEN submodule THEN 'EXCLUDED_SUBMODULE' WHEN b >= 200 THEN 'EXCLUDED_COUNT' WHEN size > 3000 THEN 'EXCLUDED_SIZE' WHEN NOT fits THEN 'EXCLUDED_BINARY' ELSE 'ACCEPTED' END AS status FROM b)"""


def _inventory(spark, d):
    return N.inventory(view(spark, d, "n_files"), 3000, 200)


@query(f"""+ {INVENTORIED} SELECT snapshot_id, path, size, CASE WHEN status = 'ACCEPTED' THEN {LANG} END AS language,
 CASE WHEN status = 'ACCEPTED' THEN CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END END::INT AS line_count,
 CASE WHEN status = 'ACCEPTED' THEN sha256(text) END AS content_hash, status FROM i""")
def file_inventory(spark, d):
    """Files under a size and a count cap (the caps are the feature)."""
    return _inventory(spark, d)


@query(f"+ {INVENTORIED} SELECT snapshot_id, count(*) AS discovered_files, " + ", ".join(f"count(*) FILTER (status = 'EXCLUDED_{x.upper()}') AS excluded_{x}" for x in ("count", "size", "binary", "submodule")) + " FROM i GROUP BY snapshot_id")
def inventory_skips(spark, d):
    return N.skip_counts(_inventory(spark, d))


RULES = ["# comment", "*.md", "!F*0.md", "/nowhere/", "es/", "**/test/F*1.py", "de/main/F?.java", "fr/**"]
IGNORED = r"regexp_matches(path, '(^|/)es/') OR path LIKE 'fr/%' OR path LIKE '%.md' AND NOT regexp_matches(path, '(^|/)F[^/]*0\.md$') OR regexp_matches(path, '(^|/)test/F[^/]*1\.py$') OR regexp_matches(path, '^de/main/F[^/]\.java$')"


@query(f"SELECT path, {IGNORED} AS ignored FROM n_given")
def ignored_paths(spark, d):
    return N.ignored(view(spark, d, "n_given").select("path"), RULES)


ADMITTED = f"""sub AS (SELECT DISTINCT root, regexp_extract(path, '^(.*/sub)/.git$', 1) AS pruned FROM n_given WHERE path LIKE '%/.git'),
p AS (SELECT g.*, CASE WHEN path LIKE '%/%' AND split_part(path, '/', 1) NOT IN ('en', 'de') THEN split_part(path, '/', 1) WHEN regexp_matches(path, '/(build|node_modules)/') THEN regexp_extract(path, '^(.*?/(build|node_modules))/', 1) WHEN sub.pruned IS NOT NULL THEN sub.pruned END AS pruned FROM n_given g LEFT JOIN sub ON sub.root = g.root AND starts_with(path, sub.pruned || '/')),
e AS (SELECT root, path, pruned, CASE WHEN regexp_matches(pruned, '/(build|node_modules)$') THEN 'GENERATED_DIRECTORY' WHEN pruned LIKE '%/sub' THEN 'SUBMODULE' WHEN pruned IS NOT NULL THEN 'OUT_OF_SCOPE' WHEN kind = 'symlink' THEN 'SYMLINK' WHEN path LIKE '%/.env%' THEN 'SECRET_PATH' WHEN kind = 'hard_link' THEN 'HARD_LINK' WHEN {IGNORED} THEN 'IGNORED' WHEN size > 3000 THEN 'OVERSIZED'
 WHEN path LIKE '%.bin' THEN 'BINARY' WHEN path NOT LIKE '%/%' THEN 'OUT_OF_SCOPE' END AS r, text LIKE 'password%' AS secret FROM p),
l AS (SELECT *, coalesce(sum((r IS NULL AND NOT secret)::INT) OVER (PARTITION BY root ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e),
a AS (SELECT root, path, pruned, coalesce(r, CASE WHEN b >= 100 THEN 'FILE_LIMIT' WHEN secret THEN 'SECRET_CONTENT' END) AS reason FROM l)"""


def _admitted(spark, d):
    return N.admit(view(spark, d, "n_given"), RULES, ["en", "de"], [], 3000, 100)


@query(f"+ {ADMITTED} SELECT root, path, pruned, reason FROM a")
def admission(spark, d):
    """Why each file of a tree is kept out (size and number are limited: the feature)."""
    return _admitted(spark, d).select("root", "path", "pruned", "reason")


@query(f"+ {ADMITTED} SELECT root, reason, count(*) FILTER (pruned IS NULL) + count(DISTINCT pruned) AS n FROM a WHERE reason IS NOT NULL GROUP BY ALL")
def exclusion_counts(spark, d):
    return N.exclusion_counts(_admitted(spark, d))


@query(f"""+ a AS (SELECT 'LANGUAGE' AS kind, coalesce({LANG}, 'other') AS value, count(*) AS n FROM n_files GROUP BY ALL UNION ALL SELECT 'DIRECTORY', string_split(path, '/')[1], count(*) FROM n_files GROUP BY ALL)
SELECT kind, value, CASE WHEN kind = 'LANGUAGE' THEN CASE value WHEN 'java' THEN 'CALLS' WHEN 'sql' THEN 'CONFIGURATION' ELSE 'INVENTORY_ONLY' END END AS depth, n FROM a""")
def import_preview(spark, d):
    return N.preview_counts(view(spark, d, "n_files"), {"java": "CALLS", "sql": "CONFIGURATION"})


@query("SELECT path, CASE WHEN language = 'kotlin' THEN 'UNSUPPORTED' ELSE 'UNMEASURED' END AS status FROM o_files")
def initial_outcomes(spark, d):
    return view(spark, d, "o_files").select("path", O.initial_status(F.col("language"), F.col("path")).alias("status"))


@query("""+ c AS (SELECT unnest(['S', 'C', 'F', 'X']) AS capability) SELECT path, capability, 'UNSUPPORTED' AS status FROM o_files, c WHERE language IN ('sql', 'python', 'kotlin', 'java', 'typescript')
 AND NOT (language IN ('java', 'typescript') OR language = 'sql' AND capability IN ('S', 'X') OR language = 'python' AND capability = 'S')""")
def unsupported_capabilities(spark, d):
    return O.unsupported_capabilities(view(spark, d, "o_files"))


@query("""+ g AS (SELECT path, count(*) AS n, max(status) AS s, max(reason) AS r FROM o_given GROUP BY path), x AS (SELECT a.path, coalesce(n = 1 AND s IN ('SUCCESS', 'FAILED', 'UNMEASURED'), false) AS ok, s, r FROM o_asked a LEFT JOIN g USING (path)),
y AS (SELECT path, CASE WHEN ok THEN s ELSE 'UNMEASURED' END AS s, CASE WHEN ok THEN CASE WHEN r = 'PARSED' OR r = 'AGAIN' THEN r ELSE 'PARSER_REPORTED' END ELSE 'ANALYZER_OUTCOME_MISSING_OR_INVALID' END AS r FROM x)
SELECT f.path, CASE WHEN y.path IS NULL THEN f.status WHEN f.reason IS NOT NULL AND s <> 'FAILED' THEN 'PARTIAL' ELSE s END AS status, CASE WHEN y.path IS NULL OR f.reason IS NOT NULL AND s <> 'FAILED' THEN f.reason ELSE r END AS reason,
 f.targeted OR coalesce(s <> 'UNMEASURED', false) AS targeted FROM o_files f LEFT JOIN y USING (path)""")
def applied_outcomes(spark, d):
    return O.apply_outcomes(*[view(spark, d, n) for n in ("o_files", "o_asked", "o_given")])


@query("""SELECT path, CASE WHEN status IN ('SUCCESS', 'PARTIAL') THEN 'SUCCESS' WHEN status IN ('FAILED', 'UNSUPPORTED') THEN status ELSE 'UNMEASURED' END AS status, CASE status WHEN 'SUCCESS' THEN 'CROSS_DOMAIN_LINKED' WHEN 'PARTIAL' THEN 'CROSS_DOMAIN_LINKED'
 WHEN 'FAILED' THEN 'SOURCE_NOT_PARSED' WHEN 'UNSUPPORTED' THEN 'SOURCE_LANGUAGE_UNSUPPORTED' ELSE 'SOURCE_NOT_MEASURED' END AS reason FROM o_files WHERE language IN ('java', 'typescript', 'sql')""")
def cross_domain_outcomes(spark, d):
    return O.cross_domain_outcomes(view(spark, d, "o_files"))


@query("SELECT path, capability, arg_max(status, seq) AS status FROM o_events GROUP BY ALL")
def last_capability_outcomes(spark, d):
    return O.last_capability_outcome(view(spark, d, "o_events")).select("path", "capability", "status")


STATES = "count(*) FILTER (s <> 'UNMEASURED') AS targeted, " + ", ".join(f"count(*) FILTER (s = '{x}') AS {'pending' if x == 'TARGETED' else x.lower()}" for x in O.STATES)


@query(f"""+ c AS (SELECT unnest(['S', 'C', 'F', 'X']) AS capability), e AS (SELECT f.snapshot_id, c.capability, coalesce(o.status, 'UNMEASURED') AS s FROM o_files f CROSS JOIN c LEFT JOIN o_caps o ON o.path = f.path AND o.capability = c.capability
 UNION ALL SELECT snapshot_id, 'P', CASE WHEN status = 'LEGACY_UNMEASURED' THEN 'UNMEASURED' ELSE status END FROM o_files) SELECT snapshot_id, capability, {STATES} FROM e GROUP BY ALL""")
def capability_coverage(spark, d):
    return O.capability_coverage(view(spark, d, "o_files"), view(spark, d, "o_caps"))


@query("""+ c AS (SELECT snapshot_id, count(*) FILTER (targeted) AS targeted, count(*) FILTER (status = 'SUCCESS') AS successful, count(*) FILTER (status = 'PARTIAL') AS partial, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'UNSUPPORTED') AS unsupported,
 count(*) FILTER (status LIKE '%UNMEASURED') AS unmeasured, count(*) FILTER (status = 'TARGETED') AS pending FROM o_files GROUP BY 1)
SELECT m.snapshot_id, discovered_files, excluded_count + excluded_size + excluded_binary AS excluded_files, excluded_submodule AS excluded_submodules, coalesce(targeted, 0) AS targeted, coalesce(successful, 0) AS successful, coalesce(partial, 0) AS partial, coalesce(failed, 0) AS failed,
 coalesce(unsupported, 0) AS unsupported, coalesce(unmeasured, 0) AS unmeasured, coalesce(pending, 0) AS pending FROM o_measured m LEFT JOIN c USING (snapshot_id)""")
def outcome_summary(spark, d):
    return O.outcome_summary(view(spark, d, "o_files"), view(spark, d, "o_measured"))


@query("SELECT snapshot_id, coalesce(language, 'unknown') AS language, count(*) AS files, count(*) FILTER (status = 'SUCCESS') AS successful, count(*) FILTER (status = 'FAILED') AS failed FROM o_files GROUP BY ALL")
def language_coverage(spark, d):
    return O.language_coverage(view(spark, d, "o_files"))


@query("""+ g AS (SELECT status, language, count(*) AS files, min(path) AS sample_path FROM o_files WHERE status IN ('UNSUPPORTED', 'FAILED', 'PARTIAL', 'TARGETED', 'UNMEASURED') GROUP BY ALL)
SELECT * FROM g ORDER BY CASE status WHEN 'UNSUPPORTED' THEN 0 WHEN 'FAILED' THEN 1 WHEN 'PARTIAL' THEN 2 WHEN 'TARGETED' THEN 3 ELSE 4 END, files DESC, language NULLS LAST LIMIT 20""")
def outside_areas(spark, d):
    """The first twenty groups of files outside analysis (the limit is the feature)."""
    return O.outside_areas(view(spark, d, "o_files"))


@query("""SELECT o_custkey % 20 AS fixture, o_orderpriority AS cell, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS eligible FROM orders GROUP BY ALL""")
def status_partition(spark, d):
    o = read_table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("fixture"), F.col("o_orderpriority").alias("cell"), F.col("o_orderstatus").alias("status"))
    return O.status_partition(o, ["F", "O", "P"], ["P"])


@query("""WITH j AS (SELECT o_custkey % 50 AS project_id, max(o_orderkey) AS job_id FROM orders GROUP BY 1) SELECT project_id, l_returnflag AS analyzer, arg_max(l_linestatus, (l_linenumber, l_linestatus)) AS status FROM j JOIN lineitem ON l_orderkey = job_id GROUP BY ALL""")
def analyzer_status(spark, d):
    jobs = read_table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("project_id"), F.col("o_orderkey").alias("job_id"))
    steps = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("analyzer"), F.col("l_linestatus").alias("status"), F.struct("l_linenumber", "l_linestatus").alias("seq"))
    return O.analyzer_status(jobs, steps)


@query("""SELECT f.project_id, f.sha, path, CASE change_type WHEN 'ADD' THEN 'Introduced' WHEN 'MODIFY' THEN 'Updated' ELSE change_type END || ' ' || regexp_extract(path, '[^/]*$') AS label, committed_at
FROM h_files f JOIN h_commits USING (project_id, sha) WHERE path IN ('pom.xml', 'go.mod') OR path LIKE '%.tf' OR path LIKE '%/package.json'""")
def technology_eras(spark, d):
    return H.eras(view(spark, d, "h_commits"), view(spark, d, "h_files"))


@query("SELECT project_id, number, state, head_sha FROM h_pulls WHERE lower(state) = 'open'")
def open_pulls(spark, d):
    return H.pulls_of(view(spark, d, "h_pulls"), "OPEN")


@query("SELECT * FROM h_commits WHERE project_id = 3 ORDER BY committed_at DESC NULLS FIRST, sha LIMIT 50 OFFSET 50")
def commits_page(spark, d):
    """The second page of a project's commits (a page is the feature)."""
    return H.commits_page(view(spark, d, "h_commits"), 3, 1, 50)


@query("SELECT project_id, max(number) AS number, arg_max(state, number) AS state FROM h_pulls GROUP BY project_id")
def latest_pulls(spark, d):
    return H.latest_pull(view(spark, d, "h_pulls")).select("project_id", "number", "state")


@query("SELECT sha, count(*) FILTER (sign = '+') AS additions, count(*) FILTER (sign = '-') AS deletions, count(DISTINCT path) AS files FROM h_lines GROUP BY sha")
def commit_churn(spark, d):
    return H.commit_churn(view(spark, d, "h_lines"))


@query("""+ j AS (SELECT DISTINCT project_id, path, sha, committed_at FROM h_files JOIN h_commits USING (project_id, sha)) SELECT project_id, path, sha, row_number() OVER (PARTITION BY project_id, path ORDER BY committed_at DESC NULLS LAST, sha)::INT AS rank FROM j QUALIFY rank <= 5""")
def commits_for_paths(spark, d):
    f = view(spark, d, "h_files")
    return H.commits_for_paths(view(spark, d, "h_commits"), f, f.select("path"))


@query("""+ w AS (SELECT project_id, id, severity, category, title, path, line, row_number() OVER (PARTITION BY project_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, id, evidence_id)::INT AS place FROM h_findings JOIN h_places ON finding_id = id WHERE status <> 'DISMISSED' QUALIFY place <= 30),
c AS (SELECT p.project_id, number, row_number() OVER (PARTITION BY p.project_id, number ORDER BY path, change_type)::INT AS place, path, change_type FROM h_pulls p JOIN h_files f ON f.project_id = p.project_id AND f.sha = head_sha QUALIFY place <= 40)
SELECT project_id, number, 'FILE' AS kind, place, path AS item, change_type AS detail, NULL AS at FROM c UNION ALL SELECT p.project_id, number, 'FINDING', place, w.id::VARCHAR, concat_ws(' ', severity, category, title), path || ':' || coalesce(line, 1) FROM h_pulls p JOIN w USING (project_id)""")
def review_context(spark, d):
    return H.review_context(*[view(spark, d, n) for n in ("h_pulls", "h_files", "h_findings", "h_places")])


@query("""+ o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY snapshot_id DESC) AS k FROM h_snapshots WHERE status = 'READY' AND legacy) SELECT project_id, snapshot_id FROM o WHERE k > 2 AND snapshot_id NOT IN (FROM h_noted)""")
def snapshots_to_delete(spark, d):
    return H.retain_snapshots(view(spark, d, "h_snapshots"), view(spark, d, "h_noted"))


@query("""+ j AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'ADDED' WHEN a.path IS NULL THEN 'REMOVED' WHEN a.content_hash <> b.content_hash THEN 'CHANGED' END AS change FROM c_now a FULL JOIN c_was b ON a.path = b.path) SELECT * FROM j WHERE change IS NOT NULL""")
def source_changes(spark, d):
    return C.source_changes(view(spark, d, "c_now"), view(spark, d, "c_was"))


@query("""+ w AS (SELECT key, min(value) AS want, count(*) AS nw FROM c_want GROUP BY key), g AS (SELECT key, min(value) AS got, count(*) AS ng FROM c_is GROUP BY key), j AS (SELECT coalesce(w.key, g.key) AS key, want, nw, got, ng, ng IS NOT NULL AND NOT EXISTS (FROM c_skip s WHERE s.key = g.key AND s.value = g.got) AS ok FROM w FULL JOIN g ON w.key = g.key),
r AS (SELECT key, 'MISSING' AS problem, want, NULL AS got FROM j WHERE nw > 0 AND NOT ok UNION ALL SELECT key, 'UNEXPECTED', want, got FROM j WHERE nw IS NULL AND ok UNION ALL SELECT key, 'CHANGED', want, got FROM j WHERE nw > 0 AND ok AND want <> got
 UNION ALL SELECT key, 'DUPLICATE_EXPECTED', want, CASE WHEN ok THEN got END FROM j WHERE nw > 1 UNION ALL SELECT key, 'DUPLICATE_ACTUAL', want, CASE WHEN ok THEN got END FROM j WHERE ng > 1) SELECT * FROM r""")
def verified_facts(spark, d):
    return C.verify_facts(*[view(spark, d, n) for n in ("c_want", "c_is", "c_skip")])


@query("SELECT path, EXISTS (SELECT 1 FROM c_was w WHERE w.path = n.path AND w.content_hash = n.content_hash AND w.context_hash = n.context_hash) AS reused FROM c_now n")
def incremental_reuse(spark, d):
    reuse, again = C.split_unchanged(view(spark, d, "c_now"), view(spark, d, "c_was"))
    return reuse.select("path", F.lit(True).alias("reused")).unionByName(again.select("path", F.lit(False).alias("reused")))


@query("SELECT 'FLOW' AS category, concat(kind, ':', name) AS key, sha256(concat_ws('|', kind, string_agg(concat(seq, ':', coalesce(node, ''), ':', description), ',' ORDER BY seq))) AS fingerprint FROM c_steps GROUP BY kind, name")
def flow_fingerprints(spark, d):
    return C.flow_fingerprints(view(spark, d, "c_steps"))


@query("""SELECT event_type AS key, v AS p, w AS worst, n, CASE WHEN v <= 40 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT event_type, min(x) FILTER (k >= ceil(0.95 * n)) AS v, max(x) AS w, max(n) AS n FROM (SELECT event_type, coalesce(value, 'Infinity'::DOUBLE) AS x,
 row_number() OVER (PARTITION BY event_type ORDER BY coalesce(value, 'Infinity'::DOUBLE)) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1)""")
def slo_verdicts(spark, d):
    e = read_table(spark, d, "events").select(F.col("event_type").alias("key"), "value")
    return A.slo_verdict(e, e.select("key").distinct().withColumn("limit", F.lit(40.0)))


@query("SELECT path, CASE WHEN contains(text, 'license') THEN length(split_part(text, 'license', 1)) - length(replace(split_part(text, 'license', 1), chr(10), '')) + 1 END::INT AS line, left(trim(split_part(text, chr(10), 1), ' '), 80) AS excerpt FROM n_files")
def license_lines(spark, d):
    """The first line that names a license, and each file's excerpt."""
    return view(spark, d, "n_files").select("path", T.line_of(F.col("text"), "license").alias("line"), T.excerpt(F.col("text")).alias("excerpt"))
