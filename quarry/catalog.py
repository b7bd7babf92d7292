"""Registered queries of the library, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import graph as G
from quarry.operators import tables as A
from quarry.plans.derived import VIEWS, view, with_views
from quarry.sources.tables import export_json, read_table
from quarry.streaming import jobs

#: Order of line items as drafts; equal ones are equal in what is merged.
DRAFT_SEQ = "(l_orderkey * 10 + l_linenumber) * 10 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END + CASE l_returnflag WHEN 'R' THEN 2 WHEN 'N' THEN 4 ELSE 0 END"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


WALK = """e AS (SELECT source, target, edge_type, CASE confidence WHEN 'CONFIRMED' THEN 3 WHEN 'LIKELY' THEN 2 ELSE 1 END AS s FROM g_edges),
w AS (SELECT 'region:0' AS node, ['region:0'] AS seen, 0 AS d, 3 AS s, NULL::VARCHAR AS t
 UNION ALL SELECT e.source, list_append(seen, e.source), d + 1, least(w.s, e.s), e.edge_type FROM w JOIN e ON e.target = w.node WHERE d < 4 AND NOT list_contains(seen, e.source))"""


@query(f"""+ {WALK}
SELECT 'region:0' AS start, node, min(d) AS min_depth, count(*) AS path_count, max(s) AS strength, arg_min(t, (d, t)) AS first_edge_type,
 CASE WHEN max(s) = 3 THEN 'CONFIRMED_DEPENDENCY' ELSE 'CANDIDATE_IMPACT' END AS impact_group FROM w WHERE d > 0 GROUP BY node""")
def impact(spark, d):
    """Everything that depends on a region, over simple paths of up to four edges."""
    return G.impact(view(spark, d, "g_edges"), spark.sql("SELECT 'region:0' AS start"), 4)


@query(f"""+ {WALK}, n AS (SELECT DISTINCT node FROM w WHERE d > 0), r AS (SELECT sum(CASE node_type WHEN 'API_ENDPOINT' THEN 4 WHEN 'FE_ROUTE' THEN 4 WHEN 'COMPONENT' THEN 2 WHEN 'CLASS' THEN 2 ELSE 1 END)::BIGINT AS score FROM n JOIN g_nodes ON natural_key = node)
SELECT 'region:0' AS start, score, CASE WHEN score >= 20 THEN 'HIGH' WHEN score >= 8 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r""")
def impact_risk(spark, d):
    """The same walk without counting paths, weighed."""
    found = G.impact(view(spark, d, "g_edges"), spark.sql("SELECT 'region:0' AS start"), 4, count_paths=False)
    return G.risk_score(found.select("start", "node"), view(spark, d, "g_nodes"))


@query("""+ e AS (SELECT source, target, edge_type, CASE confidence WHEN 'CONFIRMED' THEN 3 WHEN 'LIKELY' THEN 2 ELSE 1 END AS s FROM g_edges),
st AS (SELECT concat('nation:', n_nationkey) AS start FROM nation), one AS (SELECT start, e.source AS node, e.s, e.edge_type AS t, 1 AS d FROM st JOIN e ON target = start),
two AS (SELECT start, e.source AS node, least(one.s, e.s) AS s, e.edge_type AS t, 2 AS d FROM one JOIN e ON target = node WHERE e.source NOT IN (start, node)), w AS (FROM one UNION ALL FROM two)
SELECT start, node, min(d) AS min_depth, count(*) AS path_count, max(s) AS strength, arg_min(t, (d, t)) AS first_edge_type,
 CASE WHEN max(s) = 3 THEN 'CONFIRMED_DEPENDENCY' ELSE 'CANDIDATE_IMPACT' END AS impact_group FROM w GROUP BY start, node""")
def impact_batch(spark, d):
    """What depends on each nation, over up to two edges."""
    return G.impact(view(spark, d, "g_edges"), read_table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("start")), 2)


@query("""+ ok AS (SELECT natural_key FROM g_nodes WHERE node_type <> 'AMBIGUOUS'), e AS (SELECT * FROM g_edges WHERE source IN (FROM ok) AND target IN (FROM ok)),
one AS (SELECT * FROM e WHERE target = 'nation:3' ORDER BY source, target, edge_type LIMIT 501), two AS (SELECT DISTINCT * FROM e WHERE source <> 'nation:3' AND target IN (SELECT source FROM one) ORDER BY source, target, edge_type LIMIT 501),
w AS (SELECT 1 AS depth, source, target, edge_type, confidence, source AS node FROM one UNION ALL SELECT 2, source, target, edge_type, confidence, source FROM two)
SELECT depth, source, target, edge_type, confidence, node, (SELECT count(*) FROM w) > 500 AS truncated FROM w ORDER BY depth, node, source, target, edge_type LIMIT 500""")
def neighbourhood(spark, d):
    """What leads to a nation in one or two steps, with the cap and its flag (they are the feature)."""
    return G.neighbourhood(view(spark, d, "g_nodes"), view(spark, d, "g_edges"), "nation:3", "in", depth=2)


@query("""+ ok AS (SELECT natural_key FROM g_nodes WHERE node_type <> 'AMBIGUOUS')
SELECT 'node' AS kind, node_type AS type, count(*) AS n FROM g_nodes WHERE node_type <> 'AMBIGUOUS' GROUP BY node_type
UNION ALL SELECT 'edge', edge_type, count(*) FROM g_edges WHERE source IN (FROM ok) AND target IN (FROM ok) GROUP BY edge_type""")
def graph_overview(spark, d):
    return G.overview(view(spark, d, "g_nodes"), view(spark, d, "g_edges"))


@query("""+ c AS (SELECT source FROM g_edges JOIN g_nodes ON target = natural_key WHERE edge_type = 'CONTAINS' AND node_type = 'COMPONENT') SELECT natural_key, name FROM g_nodes WHERE node_type = 'FE_ROUTE' AND natural_key NOT IN (FROM c)""")
def orphan_routes(spark, d):
    return G.orphan_routes(view(spark, d, "g_nodes"), view(spark, d, "g_edges")).select("natural_key", "name")


@query("SELECT l_suppkey AS natural_key, CASE WHEN count(DISTINCT l_shipdate::DATE) > 1 THEN 'AMBIGUOUS' ELSE max_by(l_returnflag, (l_orderkey * 10 + l_linenumber) * 10 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END + CASE l_returnflag WHEN 'R' THEN 2 WHEN 'N' THEN 4 ELSE 0 END) END AS node_type, max_by(l_linestatus, (l_orderkey * 10 + l_linenumber) * 10 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END + CASE l_returnflag WHEN 'R' THEN 2 WHEN 'N' THEN 4 ELSE 0 END) AS name, CASE WHEN count(DISTINCT l_shipdate::DATE) <= 1 THEN max(l_shipdate::DATE::VARCHAR) END AS path FROM lineitem GROUP BY l_suppkey")
def merge_nodes(spark, d):
    """Line items as drafts of their supplier's node; the shipping day stands for the declaring file."""
    drafts = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("natural_key"), F.expr(DRAFT_SEQ).alias("seq"), F.col("l_returnflag").alias("node_type"), F.col("l_linestatus").alias("name"), F.to_date("l_shipdate").cast("string").alias("path"))
    return G.merge_nodes(drafts)


@query("SELECT concat('part:', l_partkey) AS source, concat('supplier:', l_suppkey) AS target, l_returnflag AS edge_type, arg_max(l_linestatus, (l_orderkey * 10 + l_linenumber) * 10 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END + CASE l_returnflag WHEN 'R' THEN 2 WHEN 'N' THEN 4 ELSE 0 END) AS confidence FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1, 2, 3")
def merge_edges(spark, d):
    drafts = read_table(spark, d, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("source"), F.concat(F.lit("supplier:"), "l_suppkey").alias("target"), F.col("l_returnflag").alias("edge_type"), F.expr(DRAFT_SEQ).alias("seq"), F.col("l_linestatus").alias("confidence"))
    nodes = read_table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("natural_key")).unionByName(read_table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("natural_key")))
    return G.merge_edges(nodes, drafts)


@query("""+ s AS (SELECT string_split(path, '/') AS p FROM g_files), i AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM s)
SELECT DISTINCT CASE WHEN i = 1 THEN '.' ELSE array_to_string(p[1:i - 1], '/') END AS parent, array_to_string(p[1:i], '/') AS child FROM i""")
def directory_tree(spark, d):
    return G.directory_tree(view(spark, d, "g_files"))


NORM = "lower(regexp_replace({0}, '\\$?\\{{[^}}/]+\\}}|:[A-Za-z_][A-Za-z0-9_]*', '{{}}', 'g'))"
BARE = "regexp_replace(regexp_replace(trim({0}), '^[^\\n]*?://[^/]*', ''), '\\?.*$', '', 's')"


def _path_sql(c: str) -> str:
    p = f"(CASE WHEN {BARE.format(c)} LIKE '/%' THEN '' ELSE '/' END || {BARE.format(c)})"
    return f"CASE WHEN length({p}) > 1 AND {p} LIKE '%/' THEN {p}[:-2] ELSE {p} END"


@query(f"""+ c1 AS (SELECT DISTINCT caller, method, path, {_path_sql('path')} AS p FROM g_calls), c AS (SELECT *, {NORM.format('p')} AS norm FROM c1),
e1 AS (SELECT concat(method, ':', path) AS endpoint, method AS em, {_path_sql('path')} AS ep FROM g_endpoints), e AS (SELECT *, {NORM.format('ep')} AS en FROM e1),
m AS (SELECT caller, method, path, endpoint, CASE WHEN p = ep THEN 3 WHEN norm = en THEN 2 WHEN norm <> '/' AND en <> '/' AND (ends_with(norm, en) OR ends_with(en, norm)) THEN 1 ELSE 0 END AS grade FROM c JOIN e ON upper(method) = em OR em = 'ANY')
SELECT caller, method, path, arg_min(endpoint, (-grade, endpoint)) AS endpoint, max(grade) AS grade FROM m WHERE grade > 0 GROUP BY ALL""")
def link_calls(spark, d):
    e = view(spark, d, "g_endpoints").select(F.concat("method", F.lit(":"), "path").alias("endpoint"), "method", "path")
    return G.link_calls(view(spark, d, "g_calls"), e)


@query("SELECT project, sha256(text) AS content_hash, max(size) AS size, count(*) AS copies FROM g_files GROUP BY ALL")
def content_manifest(spark, d):
    return A.build_manifest(view(spark, d, "g_files"))


@query("SELECT path, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END::INT AS line_count FROM g_files")
def line_counts(spark, d):
    return view(spark, d, "g_files").select("path", T.count_lines(F.col("text")).alias("line_count"))


#: Paths of many kinds: every ending and folder that tells a language or an area, combined over the documents.
ENDINGS = "java kt kts ts tsx mts cts js jsx mjs cjs py go sql yml yaml tf md xml gradle sh bash json html htm css scss properties toml swift rs rb php cs c h cpp hpp bin vue TXT".split()
NAMES = ["F", "Dockerfile", "dockerfile", "dockerfile-notes", "build.gradle.kts", "pom.xml", "package.json", "docker-compose.yml", "a.test.ts", "b.spec.cjs", "Makefile", "x."]
FOLDERS = ["", "docs/", "x/docs/", "src/main/java/", "src/pages/", "a/frontend/", "a/backend/", "db/migration/", ".github/workflows/", "a/tests/", "__tests__/", "a\\b/"]


def _pick(values: list[str], by: str) -> str:
    quoted = [f"concat('{x.partition(chr(92))[0]}', chr(92), '{x.partition(chr(92))[2]}')" if chr(92) in x else f"'{x}'" for x in values]
    return f"CASE {by} {' '.join(f'WHEN {i} THEN {q}' for i, q in enumerate(quoted))} END"


PATHS = f"concat({_pick(FOLDERS, f'doc_id % {len(FOLDERS)}')}, {_pick(NAMES, f'doc_id % 7 * (doc_id % 3) % {len(NAMES)}')}, CASE WHEN doc_id % 2 = 0 THEN {_pick([f'.{x}' for x in ENDINGS], f'doc_id % {len(ENDINGS)}')} ELSE '' END)"
VIEWS["g_paths"] = f"SELECT doc_id, {PATHS} AS path FROM documents"
LANGUAGE_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {
    "java": "java", "kt": "kotlin", "kts": "kotlin", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "sql": "sql", "yml": "yaml", "yaml": "yaml", "tf": "hcl", "md": "markdown", "xml": "xml", "gradle": "gradle", "sh": "shell", "bash": "shell", "json": "json", "html": "html", "htm": "html",
    "css": "css", "scss": "scss", "properties": "properties", "toml": "toml", "swift": "swift", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp"}.items())


@query(rf"""+ p AS (SELECT doc_id, path, replace(path, chr(92), '/') AS q FROM g_paths), f AS (SELECT *, lower(q) AS low, regexp_extract(q, '[^/]*$') AS file FROM p)
SELECT doc_id, path, CASE WHEN file IN ('Dockerfile', 'dockerfile') THEN 'dockerfile' WHEN file LIKE '%.gradle.kts' THEN 'gradle' ELSE CASE lower(regexp_extract(file, '\.([^.]+)$', 1)) {LANGUAGE_SQL} END END AS language,
 CASE WHEN regexp_matches(low, '(^|/)(test|tests|__tests__)/|\.(test|spec)\.[cm]?[jt]sx?$') THEN 'TESTING' WHEN q LIKE '%src/main/java%' OR low LIKE '%.java' THEN 'BACKEND'
 WHEN regexp_matches(low, '\.[tj]sx$|/frontend/|src/pages/|src/components/') OR regexp_matches(low, '\.(ts|js|mjs)$') AND NOT low LIKE '%/backend/%' THEN 'FRONTEND' WHEN q LIKE '%db/migration%' OR low LIKE '%.sql' THEN 'DATABASE'
 WHEN q LIKE '%.github/workflows%' THEN 'DEVOPS' WHEN low LIKE '%dockerfile%' OR low LIKE '%docker-compose%' OR low LIKE '%.tf' THEN 'INFRASTRUCTURE' WHEN low LIKE '%.md' OR q LIKE 'docs/%' OR q LIKE '%/docs/%' THEN 'DOCUMENTATION'
 WHEN regexp_matches(low, '(\.gradle|\.gradle\.kts|pom\.xml|package\.json)$') THEN 'BUILD_TOOLING' END AS area FROM f""")
def language_and_area(spark, d):
    return view(spark, d, "g_paths").select("doc_id", "path", T.detect_language(F.col("path")).alias("language"), T.tag_area(F.col("path")).alias("area"))


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang")
def language_histogram(spark, d):
    return A.histogram(read_table(spark, d, "documents"), "lang")


@query("SELECT path FROM g_files WHERE regexp_matches(path, '^(.*/)?test/[^/]*\\.java$')")
def glob_files(spark, d):
    return view(spark, d, "g_files").filter(T.glob_match(F.col("path"), "**/test/*.java")).select("path")


@query("""SELECT coalesce(a.category, b.category) AS category, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'ADDED' WHEN b.key IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change
FROM g_base a FULL JOIN g_target b ON a.category = b.category AND a.key = b.key WHERE a.fingerprint IS DISTINCT FROM b.fingerprint""")
def snapshot_diff(spark, d):
    return A.diff(view(spark, d, "g_base"), view(spark, d, "g_target"))


@query("""SELECT a.category, a.key AS old_key, b.key AS new_key FROM r_base a JOIN r_target b ON a.fingerprint = b.fingerprint
WHERE trim(a.fingerprint) <> '' AND a.key NOT IN (SELECT key FROM r_target) AND b.key NOT IN (SELECT key FROM r_base)""")
def rename_candidates(spark, d):
    """Moved files; some fingerprints are blank and match nothing."""
    return A.renames(view(spark, d, "r_base"), view(spark, d, "r_target"))


@query("SELECT project_id, sha, committed_at FROM g_commits QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY committed_at DESC NULLS FIRST, sha) = 1")
def latest_commits(spark, d):
    return A.first_by(view(spark, d, "g_commits"), ["project_id"], [F.desc_nulls_first("committed_at"), F.col("sha")]).select("project_id", "sha", "committed_at")


@query("SELECT c_nationkey AS project, c_mktsegment AS technology, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) <= 3")
def top_technologies(spark, d):
    n = read_table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("technology")).agg(F.count("*").alias("n"))
    return A.first_by(n, ["project"], [F.desc("n"), F.col("technology")], 3).drop("rank")


@query("SELECT n_nationkey % 7 + c_custkey // 4 * 10 AS area, least(1.0, round(sum(CASE WHEN c_custkey % 2 = 0 THEN 0.25 ELSE 0.125 END), 4))::DOUBLE AS score, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS technologies, least(1.0, round(sum(CASE WHEN c_custkey % 2 = 0 THEN 0.25 ELSE 0.125 END), 4)) >= 0.5 AS selected FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def area_scores(spark, d):
    n = read_table(spark, d, "nation").join(read_table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.area_scores(n.select(F.expr("n_nationkey % 7 + c_custkey div 4 * 10").alias("area"), (F.when(F.col("c_custkey") % 2 == 0, 0.25).otherwise(0.125)).alias("weight"), F.col("n_name").alias("technology")))


@query("""WITH r AS (SELECT event_type, coalesce(value, 'Infinity'::DOUBLE) AS v FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM r)
SELECT event_type, min(v) FILTER (k >= ceil(0.95 * n)) AS p, max(v) AS worst, count(*) AS n FROM o GROUP BY event_type""")
def p95(spark, d):
    return A.nearest_rank(read_table(spark, d, "events"), ["event_type"], "value")


@query("""+ g AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY run ORDER BY t_ms, seq) AS gap FROM g_samples)
SELECT run, count(*) AS n, coalesce(max(gap), 0) AS max_gap, max(value) AS peak, coalesce(max(gap), 0) <= 3600000 AS complete FROM g GROUP BY run""")
def sampling_gaps(spark, d):
    return A.sampling_gaps(view(spark, d, "g_samples"), 3_600_000)


@query("SELECT user_id, ts::DATE AS day, sum(tokens)::BIGINT AS tokens, sum(tokens) > 100 AS over_limit FROM g_usage GROUP BY ALL")
def daily_usage(spark, d):
    return A.daily_usage(view(spark, d, "g_usage"), 100)


@query("SELECT user_id, ts::DATE AS day, sum(tokens)::BIGINT AS tokens, sum(tokens) > 100 AS over_limit FROM g_usage GROUP BY ALL")
def stream_daily_usage(spark, d):
    """The streaming job on a bounded input: the same plan, run once."""
    return jobs.usage_by_day(view(spark, d, "g_usage"), 100)


STATES = "CASE event_id % 11 WHEN 0 THEN 'DONE' WHEN 1 THEN 'FAILED' ELSE event_type END"


@query(f"""WITH s AS (SELECT user_id AS job_id, event_id AS seq, {STATES} AS state FROM events), t AS (SELECT job_id, min(seq) AS last FROM s WHERE state IN ('DONE', 'FAILED') GROUP BY 1)
SELECT job_id, arg_max(state, seq) AS state, max(seq) AS seq FROM s LEFT JOIN t USING (job_id) WHERE last IS NULL OR seq <= last GROUP BY job_id""")
def stream_job_state(spark, d):
    return jobs.latest_state(read_table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.expr(STATES).alias("state")))


@query("""+ c AS (SELECT *, CASE WHEN status = 'SETTLED' THEN actual ELSE greatest(floor, reserved, coalesce(actual, 0)) END AS cost FROM g_requests)
SELECT installation, strftime(day, '%Y-%m') AS month, sum(cost)::BIGINT AS liability, sum(CASE WHEN status <> 'SETTLED' THEN cost ELSE 0 END)::BIGINT AS held, count(*) FILTER (status IN ('RESERVED', 'DISPATCHED')) AS open_requests FROM c GROUP BY 1, 2""")
def cost_ledger(spark, d):
    return A.ledger(view(spark, d, "g_requests"))


@query("""WITH g AS (SELECT d.doc_id, lang AS cell, quality::VARCHAR AS target, CASE WHEN n_chars >= 300 THEN '1' ELSE '0' END AS rule FROM documents d JOIN labels USING (doc_id)),
c AS (SELECT cell, count(*) FILTER (target = rule) AS tp, count(*) FILTER (target <> rule) AS fp FROM g GROUP BY cell)
SELECT cell, tp, fp, fp AS fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fp, 0) AS recall FROM c""")
def accuracy(spark, d):
    """A length rule scored against the quality labels, per language."""
    x = read_table(spark, d, "documents").select("doc_id", F.col("lang").alias("cell"), F.when(F.col("n_chars") >= 300, "1").otherwise("0").alias("rule")).join(read_table(spark, d, "labels"), "doc_id")
    return A.accuracy(x.select("cell", F.col("doc_id").alias("case"), F.col("quality").cast("string").alias("target")), x.select("cell", F.col("doc_id").alias("case"), F.col("rule").alias("target")))


@query("""WITH a AS (SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT key, a.n AS base, coalesce(b.n, 0) AS now FROM a LEFT JOIN b USING (key) WHERE a.n >= 3 AND coalesce(b.n, 0) < a.n * 0.7""")
def regression_warnings(spark, d):
    n = lambda s: read_table(spark, d, "orders").filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    return A.regressions(n("F"), n("O"))


@query("""WITH e AS (SELECT conv_id AS subject, concat(role, '|', turn, '|null|', coalesce(text, 'null')) AS line FROM conversations)
SELECT subject, sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS fingerprint FROM e GROUP BY subject""")
def evidence_fingerprints(spark, d):
    e = read_table(spark, d, "conversations").select(F.col("conv_id").alias("subject"), F.col("role").alias("path"), F.col("turn").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.col("text").alias("excerpt"))
    return A.evidence_fingerprint(e)


@query("""WITH RECURSIVE b AS (SELECT conv_id AS ctx, turn AS seq, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS k FROM conversations),
w AS (SELECT ctx, 0::BIGINT AS k, 0::BIGINT AS used, []::BIGINT[] AS kept FROM (SELECT DISTINCT ctx FROM b)
 UNION ALL SELECT b.ctx, b.k, CASE WHEN used + size <= 600 THEN used + size ELSE used END, CASE WHEN used + size <= 600 THEN list_append(kept, seq) ELSE kept END FROM w JOIN b ON b.ctx = w.ctx AND b.k = w.k + 1)
SELECT ctx, arg_max(used, k) AS used, len(arg_max(kept, k)) AS n_kept, array_to_string(arg_max(kept, k), ',') AS kept FROM w GROUP BY ctx""")
def context_packing(spark, d):
    c = read_table(spark, d, "conversations").select(F.col("conv_id").alias("ctx"), F.col("turn").alias("seq"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return A.pack(c, 600)


@query("""+ r AS (SELECT DISTINCT source AS prefix, 'S' AS namespace FROM documents UNION ALL SELECT DISTINCT concat(source, '/', lang), concat('L-', lang) FROM documents WHERE lang <> 'en')
SELECT path, arg_max(namespace, length(prefix)) AS namespace FROM g_files JOIN r ON path = prefix OR starts_with(path, prefix || '/') GROUP BY path""")
def longest_prefix(spark, d):
    x = read_table(spark, d, "documents").select("source", "lang").distinct()
    rules = x.select(F.col("source").alias("prefix"), F.lit("S").alias("namespace")).distinct().unionByName(x.filter("lang <> 'en'").select(F.concat("source", F.lit("/"), "lang").alias("prefix"), F.concat(F.lit("L-"), "lang").alias("namespace")))
    return A.longest_prefix(view(spark, d, "g_files").select("path"), rules)


@query("SELECT doc_id, lang FROM documents WHERE list_contains(string_split_regex(lower(text), '[^a-z0-9_]+'), 'license') AND list_contains(string_split_regex(lower(text), '[^a-z0-9_]+'), 'under')")
def text_search(spark, d):
    return read_table(spark, d, "documents").filter(T.text_match(F.col("text"), "license under")).select("doc_id", "lang")


def _trigrams_sql(c: str) -> str:
    words = f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH t AS (SELECT c_custkey, c_name, {_trigrams_sql('c_name')} AS a, {_trigrams_sql("'Customer#000000012'")} AS b FROM customer), s AS (SELECT c_custkey, c_name, len(list_intersect(a, b)) / len(list_distinct(a || b)) AS similarity FROM t)
SELECT * FROM s WHERE similarity >= 0.75""")
def trigram_search(spark, d):
    """Customers whose name is like the one asked for."""
    c = read_table(spark, d, "customer").select("c_custkey", "c_name", T.trigram_similarity(F.col("c_name"), F.lit("Customer#000000012")).alias("similarity"))
    return c.filter("similarity >= 0.75")


@query("SELECT p_partkey, regexp_replace('/' || regexp_replace(p_name, '[^a-z]+', '/', 'g'), '^//', '/') AS path, lower(regexp_replace(p_brand, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM part")
def route_names(spark, d):
    p = read_table(spark, d, "part")
    return p.select("p_partkey", T.url_path(F.regexp_replace("p_name", "[^a-z]+", "/")).alias("path"), T.to_snake_case(F.col("p_brand")).alias("snake"))


@query(None)
def vector_top_k(spark, d):
    """Five nearest vectors of every vector whose id is divisible by 20."""
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return A.cosine_top_k(v, v.filter("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("q")), 5)


@query("""SELECT to_json({'natural_key': natural_key, 'node_type': node_type, 'name': name})::VARCHAR AS value FROM g_nodes""")
def export_graph(spark, d):
    """Every node as a JSON line."""
    return export_json(view(spark, d, "g_nodes").select("natural_key", "node_type", "name"))
