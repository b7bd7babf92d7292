"""Registered queries over listings, search and derived facts; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.operators import compare as C
from quarry.operators import derive as D
from quarry.operators import listing as L
from quarry.plans.derived import VIEWS, view
from quarry.sources.tables import read_table

VIEWS.update({
    "n_nodes": """SELECT concat('part:', p_partkey) AS natural_key, CASE p_partkey % 5 WHEN 0 THEN 'COMPONENT' WHEN 1 THEN 'API_ENDPOINT' WHEN 2 THEN 'DB_ENTITY' WHEN 3 THEN 'HOOK' ELSE 'AMBIGUOUS' END AS node_type, p_name AS name, CASE WHEN p_partkey % 7 <> 0 THEN concat('src/', p_size, '/f.java') END AS path, p_size AS line_start, CASE WHEN p_partkey % 2 = 0 THEN 'BACKEND' ELSE 'FRONTEND' END AS area_type,
 CASE p_partkey % 5 WHEN 0 THEN concat('{"apiCalls":[1],"path":"/p', p_partkey % 40, '"}') WHEN 1 THEN concat('{"httpMethod":"GET","path":"/Pets', p_partkey % 9, '/{id}"', CASE WHEN p_partkey % 3 <> 0 THEN concat(',"handlerKey":"supplier:', p_partkey % 10 + 1, '"') ELSE '' END, '}') WHEN 2 THEN concat('{"layer":"ENTITY"', CASE WHEN p_partkey % 3 = 0 THEN ',"tableName":"t"' ELSE '' END, '}') ELSE '{}' END AS metadata FROM part
 UNION ALL SELECT concat('supplier:', s_suppkey), 'METHOD', s_name, concat('src/', s_suppkey % 50, '/f.java'), CAST(s_suppkey % 90 AS INT), 'BACKEND', CASE WHEN s_suppkey % 5 = 0 THEN '{"layer":"REPOSITORY"}' ELSE '{}' END FROM supplier
 UNION ALL SELECT concat('nation:', n_nationkey), 'CLASS', n_name, concat('src/', n_nationkey, '/f.java'), 1, 'BACKEND', concat('{"layer":"', CASE n_nationkey % 4 WHEN 0 THEN 'CONTROLLER' WHEN 1 THEN 'SERVICE' WHEN 2 THEN 'REPOSITORY' ELSE 'ENTITY' END, '"', CASE WHEN n_nationkey % 6 = 5 THEN ',"external":"true"' ELSE '' END, '}') FROM nation
 UNION ALL SELECT concat('order:', o_orderkey), 'FE_ROUTE', o_orderpriority, concat('web/', o_custkey % 60, '.tsx'), CAST(o_orderkey % 90 AS INT), 'FRONTEND', CASE o_orderkey % 3 WHEN 0 THEN '{"componentResolution":"UNRESOLVED"}' WHEN 1 THEN concat('{"path":"/r', o_custkey, '","componentKey":"k"}') ELSE '{}' END FROM orders
 UNION ALL SELECT concat('region:', r_regionkey), CASE r_regionkey % 3 WHEN 0 THEN 'CONTAINER' WHEN 1 THEN 'CI_PIPELINE' ELSE 'DB_TABLE' END, r_name, concat('src/', r_regionkey + 1, '/f.java'), 1, 'INFRASTRUCTURE', '{}' FROM region
 UNION ALL SELECT DISTINCT concat('file:src/', p_size, '/f.java'), 'FILE', 'f.java', concat('src/', p_size, '/f.java'), CAST(NULL AS INT), 'BACKEND', '{}' FROM part""",
    "n_edges": """SELECT DISTINCT concat('supplier:', l_suppkey) AS source, concat('supplier:', (l_suppkey * 3 + l_partkey % 2) % 10 + 1) AS target, 'CALLS' AS edge_type, CASE WHEN l_partkey % 2 = 0 THEN 'CONFIRMED' ELSE 'POSSIBLE' END AS confidence FROM lineitem WHERE l_suppkey <> (l_suppkey * 3 + l_partkey % 2) % 10 + 1
 UNION ALL SELECT concat('nation:', s_nationkey), concat('supplier:', s_suppkey), 'DECLARES', 'CONFIRMED' FROM supplier
 UNION ALL SELECT concat('nation:', n_nationkey), concat('supplier:', n_nationkey % 10 + 1), 'DECLARES', 'CONFIRMED' FROM nation
 UNION ALL SELECT concat('nation:', p_partkey % 25), concat('part:', p_partkey), 'EXPOSES', 'CONFIRMED' FROM part WHERE p_partkey % 5 = 1
 UNION ALL SELECT concat('nation:', (p_partkey + 10) % 25), concat('part:', p_partkey), 'EXPOSES', 'LIKELY' FROM part WHERE p_partkey % 10 = 1
 UNION ALL SELECT concat('order:', o_orderkey), concat('part:', o_custkey % 30 * 5 + 5), 'CONTAINS', 'CONFIRMED' FROM orders
 UNION ALL SELECT concat('order:', o_orderkey), concat('part:', o_custkey % 17 * 5 + 5), 'CONTAINS', 'CONFIRMED' FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey % 17 <> o_custkey % 30
 UNION ALL SELECT concat('part:', p_partkey), concat('part:', p_partkey + 1), 'CONSUMES', 'LIKELY' FROM part WHERE p_partkey % 10 = 0
 UNION ALL SELECT concat('part:', p_partkey), 'region:2', 'MAPS_TO', 'CONFIRMED' FROM part WHERE p_partkey % 5 = 2 AND p_partkey % 3 = 0
 UNION ALL SELECT concat('supplier:', s_suppkey), concat('part:', s_suppkey * 5 + 2), 'READS_WRITES', 'CONFIRMED' FROM supplier
 UNION ALL SELECT concat('supplier:', s_suppkey), concat('part:', s_suppkey * 5 + 7), 'USES_TYPE', 'CONFIRMED' FROM supplier""",
    "n_findings": "SELECT l_suppkey % 3 AS snapshot_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, CASE CAST(min(l_quantity) AS INT) % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, min(l_returnflag) AS category, concat('Finding ', min(l_partkey) % 40) AS title, concat('about part ', min(l_partkey)) AS detail FROM lineitem GROUP BY l_suppkey % 3, l_orderkey, l_linenumber",
    "n_tasks": "SELECT o_custkey % 20 AS project_id, o_orderkey AS id, concat('Task ', o_custkey) AS title, concat('fix order ', o_orderkey % 500) AS description, CASE o_orderkey % 5 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'OPEN' WHEN 2 THEN 'DONE' ELSE 'CLOSED' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN 'LEARNING' ELSE 'TODO' END AS type, o_orderdate AS updated_at FROM orders",
    "n_projects": "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS user_id, CAST(n_nationkey % 3 AS BIGINT) AS current_snapshot_id FROM nation WHERE n_nationkey < 20",
    "n_sources": "SELECT doc_id % 3 AS snapshot_id, doc_id AS id, concat(source, '/', lang, '/license-', doc_id % 50, '.java') AS path FROM documents",
    "n_notes": "SELECT conv_id % 20 AS project_id, conv_id * 1000 + turn AS id, concat(role, ' license ', turn) AS title, text AS content_md, turn * 100000 + conv_id AS updated_at FROM conversations",
    "n_evidence": "SELECT event_id % 20 AS project_id, event_id AS id, concat(event_type, '/license.java') AS file_path, props AS excerpt FROM events",
    "n_pulls": "SELECT o_custkey % 20 AS project_id, o_orderkey AS id, o_orderkey AS number, CASE WHEN o_orderkey % 40 = 0 THEN 'Change the License' ELSE 'other' END AS title FROM orders",
    "n_commits": "SELECT o_custkey % 20 AS project_id, o_orderkey AS id, md5(concat('c', o_orderkey)) AS sha, concat('update ', CASE WHEN o_orderkey % 30 = 0 THEN 'LICENSE' ELSE 'x' END) AS message, o_orderdate AS committed_at FROM orders",
    "n_pairs": "SELECT concat('t', c_custkey) AS sub, concat('t', c_custkey div 3) AS super FROM customer",
    "n_calls": "SELECT o_orderkey AS call, concat('declared', o_orderkey) AS declared, concat('t', o_custkey div 9) AS receiver, concat('m', o_custkey % 4) AS name, CASE o_orderkey % 3 WHEN 0 THEN array('int') WHEN 1 THEN array('long') ELSE array('int', 'int') END AS params FROM orders",
    "n_methods": "SELECT concat('method', c_custkey) AS method, concat('t', c_custkey) AS owner, concat('m', c_custkey % 4) AS name, CASE c_custkey % 2 WHEN 0 THEN array('int') ELSE array('char') END AS params FROM customer",
    "n_imports": "SELECT concat('f', doc_id) AS importer, concat('pkg.m', doc_id % 60) AS module FROM documents",
    "n_modules": "SELECT DISTINCT concat('pkg/m', doc_id % 45, CASE WHEN doc_id % 4 = 0 THEN '/__init__.py' ELSE '.py' END) AS path FROM documents",
    "n_steps": "SELECT l_orderkey AS flow, l_linenumber AS seq, concat('n', max(l_suppkey) % 10) AS node, concat('n', l_orderkey % 10) AS entry_node, CASE WHEN max(l_partkey) % 3 = 0 THEN max(l_partkey) END AS edge_id FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "n_relations": "SELECT c_custkey AS edge_id, concat('n', c_custkey % 10) AS source, concat('n', c_custkey div 10 % 10) AS target, CASE c_custkey % 3 WHEN 0 THEN 'CALLS' WHEN 1 THEN 'EXPOSES' ELSE 'IMPORTS' END AS edge_type, CASE c_custkey div 7 % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'LIKELY' ELSE 'POSSIBLE' END AS confidence FROM customer",
    "n_processes": "SELECT o_orderkey div 40 AS sample, CAST(7 AS BIGINT) AS owner, o_orderkey % 40 AS pid, (o_orderkey % 40) div 2 AS ppid, CAST(o_custkey AS BIGINT) AS rss_kib, CASE WHEN o_orderkey % 40 = 33 THEN CAST(7 AS BIGINT) END AS scope_owner FROM orders",
    "n_seen": "SELECT l_returnflag AS cell, l_linestatus AS edge_type, concat('f', l_orderkey % 300) AS path, l_linenumber AS span, concat('t', l_suppkey % 12) AS target, CASE WHEN l_partkey % 3 = 0 THEN 'CONFIRMED' ELSE 'LIKELY' END AS confidence FROM lineitem",
    "n_links": "SELECT event_id AS evidence_id, CASE WHEN event_id % 2 = 0 THEN 'FLOW' ELSE 'NODE' END AS subject_type, user_id AS subject_id FROM events",
    "n_subjects": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'FLOW' ELSE 'NODE' END AS subject_type, c_custkey AS subject_id FROM customer WHERE c_custkey % 3 <> 0",
    "n_held": "SELECT event_id AS evidence_id, event_type AS kind FROM events",
    "n_routes": "SELECT concat('/r', o_custkey) AS route, CASE WHEN o_orderkey % 3 <> 0 THEN concat('c', o_orderkey % 5) END AS component FROM orders",
    "n_seeds": "SELECT c_custkey AS seed, concat('s', c_custkey % 70) AS name, c_custkey % 4 = 0 AS endpoint, c_custkey * 5 AS lo, c_custkey % 3 + 1 AS more FROM customer",
})


@query("""SELECT natural_key, node_type, path FROM n_nodes WHERE node_type IN ('COMPONENT', 'HOOK', 'METHOD', 'CLASS', 'DB_ENTITY') AND area_type = 'BACKEND'
 AND (contains(lower(name), '/4/') OR contains(lower(natural_key), '/4/') OR coalesce(contains(lower(path), '/4/'), false))""")
def node_listing(spark, d):
    return L.list_nodes(view(spark, d, "n_nodes"), area="BACKEND", q="/4/", category="symbols").select("natural_key", "node_type", "path")


@query("SELECT natural_key, name, path FROM n_nodes WHERE node_type <> 'AMBIGUOUS' ORDER BY path NULLS LAST, line_start NULLS LAST, natural_key LIMIT 100 OFFSET 100")
def node_page(spark, d):
    """The second page by path (a page is the feature)."""
    return L.sort_nodes(L.list_nodes(view(spark, d, "n_nodes")), "path", 1).select("natural_key", "name", "path")


@query("""+ x AS (SELECT natural_key, json_extract_string(metadata, '$.httpMethod') AS http_method, json_extract_string(metadata, '$.path') AS path, json_extract_string(metadata, '$.handlerKey') AS handler_key FROM n_nodes WHERE node_type = 'API_ENDPOINT') SELECT * FROM x WHERE handler_key IS NOT NULL""")
def endpoint_projection(spark, d):
    return L.extract_endpoints(view(spark, d, "n_nodes"))


@query("""SELECT natural_key, name AS entity_name, coalesce(json_extract_string(metadata, '$.tableName'), name) AS table_name, 'JPA' AS source FROM n_nodes WHERE node_type = 'DB_ENTITY'""")
def entity_projection(spark, d):
    return L.extract_entities(view(spark, d, "n_nodes"))


@query("""+ x AS (SELECT natural_key, json_extract_string(metadata, '$.path') AS path, json_extract_string(metadata, '$.componentKey') AS component_key FROM n_nodes WHERE node_type = 'FE_ROUTE') SELECT * FROM x WHERE path IS NOT NULL""")
def route_projection(spark, d):
    return L.extract_routes(view(spark, d, "n_nodes"))


@query("SELECT natural_key, CASE node_type WHEN 'CI_PIPELINE' THEN 'CI' ELSE node_type END AS kind, name, path AS source_path FROM n_nodes WHERE node_type IN ('CONTAINER', 'CI_PIPELINE', 'CLOUD_RESOURCE')")
def infra_projection(spark, d):
    return L.extract_infra(view(spark, d, "n_nodes"))


@query("""SELECT natural_key, CASE node_type WHEN 'FE_ROUTE' THEN 'PAGE' WHEN 'HOOK' THEN 'STATE' ELSE CASE WHEN metadata LIKE '%apiCalls%' THEN 'API_CLIENT' ELSE 'COMPONENT' END END AS layer FROM n_nodes WHERE node_type IN ('FE_ROUTE', 'COMPONENT', 'HOOK', 'STORE')""")
def frontend_view(spark, d):
    return view(spark, d, "n_nodes").select("natural_key", L.frontend_layer(F.col("node_type"), F.col("metadata")).alias("layer")).filter("layer is not null")


@query("""SELECT json_extract_string(metadata, '$.layer') AS layer, natural_key, name FROM n_nodes WHERE metadata LIKE '%"layer"%' AND metadata NOT LIKE '%external%'""")
def backend_view(spark, d):
    return L.backend_view(view(spark, d, "n_nodes"))


@query("""+ o AS (SELECT e.target, json_extract_string(n.metadata, '$.layer') AS layer FROM n_edges e JOIN n_nodes n ON n.natural_key = e.source WHERE e.edge_type = 'DECLARES')
SELECT a.layer AS source_group, b.layer AS target_group, count(*) AS n FROM n_edges e JOIN o a ON a.target = e.source JOIN o b ON b.target = e.target WHERE e.edge_type = 'CALLS' GROUP BY ALL""")
def layer_call_matrix(spark, d):
    return L.layer_call_matrix(view(spark, d, "n_nodes"), view(spark, d, "n_edges"))


@query("SELECT snapshot_id, id, severity, category, title FROM n_findings WHERE severity = 'CRITICAL'")
def critical_findings(spark, d):
    return L.list_findings(view(spark, d, "n_findings"), "CRITICAL").select("snapshot_id", "id", "severity", "category", "title")


@query("""SELECT project_id, id, status, row_number() OVER (PARTITION BY project_id ORDER BY CASE status WHEN 'OPEN' THEN 0 WHEN 'DRAFT' THEN 1 WHEN 'DONE' THEN 2 ELSE 3 END, updated_at DESC, id DESC)::INT AS place FROM n_tasks WHERE type <> 'LEARNING' AND status <> 'DRAFT' QUALIFY place <= 10""")
def first_tasks(spark, d):
    """The first ten tasks of each project (the report's limit)."""
    return L.list_tasks(view(spark, d, "n_tasks"), k=10).select("project_id", "id", "status", "place")


@query("""+ j AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'A' WHEN a.path IS NULL THEN 'D' WHEN a.content_hash <> b.content_hash THEN 'M' END AS c FROM c_now a FULL JOIN c_was b ON a.path = b.path), k AS (SELECT length(path) % 3 AS snapshot_id, path, c FROM j WHERE c IS NOT NULL)
SELECT snapshot_id, c || ' ' || path AS line FROM k QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY path) <= 100""")
def visible_changes(spark, d):
    changes = C.source_changes(view(spark, d, "c_now"), view(spark, d, "c_was")).withColumn("snapshot_id", F.length("path") % 3)
    return L.visible_changes(changes)


def _hit(kind: str, table: str, title: str, like: list[str], words: str | None, order: str, snapshot: bool, where: str = "true") -> str:
    tests = [f"coalesce(contains(lower({c}), 'license'), false)" for c in like] + ([f"list_contains(string_split_regex(lower({words}), '[^a-z0-9_]+'), 'license')"] if words else [])
    on = "current_snapshot_id = x.snapshot_id" if snapshot else "p.id = x.project_id"
    return f"(SELECT '{kind}' AS type, p.id AS project_id, x.id, {title} AS title, row_number() OVER (ORDER BY {order})::INT AS place FROM {table} x JOIN n_projects p ON {on} WHERE p.user_id = 2 AND ({' OR '.join(tests)}) AND {where} QUALIFY place <= 8)"


SIMILAR = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(path), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
ASKED = "list_transform(range(1, 9), lambda i: substr('  license ', i, 3))"


@query("+ z AS (SELECT 1) " + " UNION ALL ".join([
    _hit("FILE", "n_sources", "path", ["path"], "path", f"len(list_intersect({SIMILAR}, {ASKED})) / len(list_distinct({SIMILAR} || {ASKED})) DESC, x.id, p.id", True),
    _hit("FINDING", "n_findings", "title", ["title"], "concat_ws(' ', title, detail)", "x.id, p.id", True),
    _hit("COMMIT", "n_commits", "sha", ["sha", "message"], "message", "committed_at DESC NULLS LAST, x.id", False),
    _hit("PR", "n_pulls", "title", ["title"], "title", "number DESC, x.id", False),
    _hit("NOTE", "n_notes", "title", ["title", "content_md"], "concat_ws(' ', title, content_md)", "updated_at DESC, x.id", False),
    _hit("TASK", "n_tasks", "title", ["title", "description"], "concat_ws(' ', title, description)", "updated_at DESC, x.id", False, "status <> 'DRAFT' AND type <> 'LEARNING'"),
    _hit("EVIDENCE", "n_evidence", "file_path", ["file_path", "excerpt"], None, "x.id DESC", False)]))
def global_search(spark, d):
    """The first hits of seven entities in a user's projects (eight of each are the report)."""
    tables = {"FILE": "n_sources", "FINDING": "n_findings", "COMMIT": "n_commits", "PR": "n_pulls", "NOTE": "n_notes", "TASK": "n_tasks", "EVIDENCE": "n_evidence"}
    return L.search({k: view(spark, d, v) for k, v in tables.items()}, view(spark, d, "n_projects"), "License", 2)


@query("SELECT natural_key, name FROM n_nodes WHERE node_type IN ('COMPONENT', 'HOOK') AND metadata LIKE '%apiCalls%' AND natural_key NOT IN (SELECT source FROM n_edges WHERE edge_type = 'CONSUMES')")
def unmatched_api_calls(spark, d):
    return D.unmatched_api_calls(view(spark, d, "n_nodes"), view(spark, d, "n_edges")).select("natural_key", "name")


@query("SELECT natural_key, name FROM n_nodes WHERE node_type = 'DB_ENTITY' AND natural_key NOT IN (SELECT source FROM n_edges WHERE edge_type = 'MAPS_TO')")
def unmapped_entities(spark, d):
    return D.unmapped_entities(view(spark, d, "n_nodes"), view(spark, d, "n_edges")).select("natural_key", "name")


@query("""+ h AS (SELECT r.natural_key AS source, min(c.natural_key) AS component FROM n_nodes r JOIN n_edges e ON e.source = r.natural_key AND e.edge_type = 'CONTAINS' JOIN n_nodes c ON c.natural_key = e.target AND c.node_type = 'COMPONENT'
 WHERE r.node_type = 'FE_ROUTE' AND r.metadata NOT LIKE '%UNRESOLVED%' GROUP BY 1 HAVING count(DISTINCT c.natural_key) = 1) SELECT DISTINCT h.source, e.target, e.confidence FROM h JOIN n_edges e ON e.source = component AND e.edge_type = 'CONSUMES'""")
def route_consumes(spark, d):
    return D.route_consumes(view(spark, d, "n_nodes"), view(spark, d, "n_edges"))


@query("""SELECT f.natural_key AS source, t.natural_key AS target FROM n_nodes f JOIN n_nodes t ON f.path = t.path WHERE f.node_type = 'FILE' AND t.node_type = 'CLASS'""")
def file_contains_types(spark, d):
    return D.file_contains_types(view(spark, d, "n_nodes"), view(spark, d, "n_edges"))


@query("""+ n AS (SELECT route, count(*) AS n FROM n_routes GROUP BY route) SELECT route, component, CASE WHEN n = 1 AND component IS NOT NULL THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution FROM n_routes JOIN n USING (route)""")
def conflicting_routes(spark, d):
    return D.conflicting_routes(view(spark, d, "n_routes"))


CLOSURE = "w AS (SELECT sub, super FROM n_pairs UNION SELECT w.sub, p.super FROM w JOIN n_pairs p ON p.sub = w.super)"


@query(f"+ {CLOSURE} SELECT sub, super FROM w")
def subtype_closure(spark, d):
    return D.transitive_closure(view(spark, d, "n_pairs"))


@query(f"""+ {CLOSURE}, k AS (SELECT sub, super FROM w UNION SELECT owner, owner FROM n_methods), j AS (SELECT call, declared, method, owner, m.params = c.params AS same FROM n_calls c JOIN n_methods m ON m.name = c.name AND len(m.params) = len(c.params) JOIN k ON k.sub = m.owner AND k.super = c.receiver),
f AS (SELECT DISTINCT call, method FROM j WHERE same OR NOT EXISTS (SELECT 1 FROM j x WHERE x.call = j.call AND x.owner = j.owner AND x.same)), n AS (SELECT call, count(*) AS n FROM f GROUP BY call)
SELECT c.call, CASE WHEN coalesce(n, 0) BETWEEN 1 AND 5 THEN method ELSE declared END AS target, coalesce(n, 0) AS candidates FROM n_calls c LEFT JOIN n ON n.call = c.call LEFT JOIN f ON f.call = c.call AND n BETWEEN 1 AND 5""")
def dispatch_candidates(spark, d):
    return D.dispatch_candidates(view(spark, d, "n_calls"), view(spark, d, "n_methods"), view(spark, d, "n_pairs"))


@query("""+ t AS (SELECT importer, module, replace(module, '.', '/') AS b FROM n_imports), c AS (SELECT importer, module, b || '.py' AS path, 0 AS k FROM t UNION ALL SELECT importer, module, b || '/__init__.py', 1 FROM t)
SELECT importer, module, arg_min(path, k) AS path FROM c JOIN n_modules USING (path) GROUP BY ALL""")
def resolved_imports(spark, d):
    return D.resolve_imports(view(spark, d, "n_imports"), view(spark, d, "n_modules"))


@query("SELECT DISTINCT h.evidence_id, kind FROM n_held h JOIN n_links USING (evidence_id) JOIN n_subjects USING (subject_type, subject_id)")
def kept_evidence(spark, d):
    return D.purge_orphans(view(spark, d, "n_links"), view(spark, d, "n_subjects"), view(spark, d, "n_held"))[1]


@query("""+ a AS (SELECT source AS focus, target AS node, edge_type, 'OUT' AS direction FROM n_edges WHERE source LIKE 'nation:%' UNION SELECT target, source, edge_type, 'IN' FROM n_edges WHERE target LIKE 'nation:%')
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY focus ORDER BY node, edge_type, direction) <= 24""")
def focus_neighbours(spark, d):
    """The first 24 neighbours of every nation (the view's limit)."""
    return D.focus_neighbours(view(spark, d, "n_edges"), read_table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("focus")))


SEEDS = """s AS (SELECT DISTINCT CASE node_type WHEN 'FE_ROUTE' THEN 'ROUTE' ELSE 'ENDPOINT' END AS kind, lower(string_split(json_extract_string(metadata, '$.path'), '/')[2]) AS name, natural_key AS node FROM n_nodes WHERE node_type IN ('FE_ROUTE', 'API_ENDPOINT') AND json_extract_string(metadata, '$.path') IS NOT NULL)"""


@query(f"+ {SEEDS} SELECT kind, name, node FROM s UNION ALL SELECT 'PACKAGE', 'shop', concat('java:com.acme.Shop.S', s_suppkey) FROM supplier")
def seeds_by_prefix(spark, d):
    n = view(spark, d, "n_nodes")
    of = lambda t: n.filter(F.col("node_type") == t).select("natural_key", F.get_json_object("metadata", "$.path").alias("path")).dropna(subset=["path"])
    types = read_table(spark, d, "supplier").select(F.concat(F.lit("java:com.acme.Shop.S"), "s_suppkey").alias("natural_key"))
    return D.feature_seeds(of("API_ENDPOINT"), of("FE_ROUTE"), types)


@query(f"""+ {SEEDS}, n AS (SELECT natural_key AS node, node_type AS t, path, json_extract_string(metadata, '$.layer') AS l FROM n_nodes), seed AS (SELECT DISTINCT name AS feature, node FROM s WHERE kind = 'ENDPOINT'),
c AS (SELECT DISTINCT feature, e.source AS node FROM seed JOIN n_edges e ON e.target = node AND edge_type = 'EXPOSES'), m0 AS (SELECT DISTINCT feature, e.target AS node FROM c JOIN n_edges e ON e.source = node AND edge_type = 'DECLARES' JOIN n ON n.node = e.target AND t = 'METHOD'),
m1 AS (SELECT DISTINCT feature, e.target AS node FROM m0 JOIN n_edges e ON e.source = node AND edge_type = 'CALLS'), m2 AS (SELECT DISTINCT feature, e.target AS node FROM m1 JOIN n_edges e ON e.source = node AND edge_type = 'CALLS'), m3 AS (SELECT DISTINCT feature, e.target AS node FROM m2 JOIN n_edges e ON e.source = node AND edge_type = 'CALLS'),
g AS (FROM seed UNION FROM c UNION FROM m0 UNION FROM m1 UNION FROM m2 UNION FROM m3),
g2 AS (FROM g UNION SELECT feature, e.source FROM g JOIN n USING (node) JOIN n_edges e ON e.target = g.node AND edge_type = 'DECLARES' WHERE t = 'METHOD' UNION SELECT feature, e.target FROM g JOIN n_edges e ON e.source = g.node AND edge_type = 'USES_TYPE' JOIN n ON n.node = e.target WHERE t = 'DB_ENTITY' OR l IN ('ENTITY', 'REPOSITORY')),
g3 AS (FROM g2 UNION SELECT feature, x.node FROM g2 JOIN n USING (node) JOIN n x ON x.path = n.path WHERE n.l = 'ENTITY' AND x.t = 'DB_TABLE'), g4 AS (FROM g3 UNION SELECT feature, e.source FROM g3 JOIN n_edges e ON e.target = node AND edge_type = 'CONSUMES'),
r AS (SELECT feature, node, CASE WHEN t = 'API_ENDPOINT' OR l = 'CONTROLLER' THEN 'API' WHEN t IN ('FE_ROUTE', 'COMPONENT', 'HOOK', 'STORE') THEN 'UI' WHEN l = 'SERVICE' THEN 'SERVICE' WHEN l IN ('REPOSITORY', 'ENTITY') OR t = 'DB_ENTITY' THEN 'DATA' END AS role FROM g4 JOIN n USING (node)) SELECT * FROM r WHERE role IS NOT NULL""")
def feature_links(spark, d):
    n = view(spark, d, "n_nodes")
    ends = n.filter("node_type = 'API_ENDPOINT'").select("natural_key", F.get_json_object("metadata", "$.path").alias("path")).dropna(subset=["path"])
    seeds = D.feature_seeds(ends, ends.limit(0), n.limit(0)).select(F.col("name").alias("feature"), "node")
    return D.feature_links(seeds, n, view(spark, d, "n_edges"))


#: Steps of back-end flows, as a chain of expressions over n_nodes and n_edges.
BACKEND = """n AS (SELECT natural_key AS node, node_type AS t, json_extract_string(metadata, '$.layer') AS l, json_extract_string(metadata, '$.handlerKey') AS handler FROM n_nodes), f AS (SELECT node AS flow, handler FROM n WHERE t = 'API_ENDPOINT'),
b AS (SELECT DISTINCT flow, e.source AS controller, handler FROM f JOIN n_edges e ON e.target = flow AND edge_type = 'EXPOSES'), s0 AS (SELECT DISTINCT flow, controller, n.node FROM b JOIN n_edges e ON e.source = controller AND edge_type = 'DECLARES' JOIN n ON n.node = e.target AND t = 'METHOD' WHERE e.target = b.handler),
x AS (SELECT e.source, e.target, e.edge_type FROM n_edges e JOIN n ON n.node = e.source WHERE edge_type IN ('CALLS', 'READS_WRITES') AND t <> 'DB_ENTITY' AND coalesce(l <> 'REPOSITORY', true)),
w AS (SELECT flow, controller, node, 0 AS d, '' AS o FROM s0 UNION ALL SELECT flow, controller, x.target, d + 1, o || chr(1) || edge_type || chr(2) || x.target FROM w JOIN x ON x.source = node WHERE d < 5),
a AS (SELECT flow, controller, node, min(row(d, o)) AS p FROM w GROUP BY ALL UNION ALL SELECT flow, controller, controller, row(-1, '') FROM b), g AS (SELECT flow, node, min(row(controller, p)) AS p FROM a WHERE node IN (SELECT node FROM n) GROUP BY ALL),
k AS (SELECT flow, node, row_number() OVER (PARTITION BY flow ORDER BY p, node) AS seq FROM g),
backend AS (SELECT flow, 1 AS seq, flow AS node FROM f UNION ALL SELECT flow, (seq + 1)::INT, node FROM k WHERE seq <= 25)"""


@query(f"+ {BACKEND} FROM backend")
def backend_flows(spark, d):
    return D.backend_flows(view(spark, d, "n_nodes"), view(spark, d, "n_edges"))


@query("""+ a AS (SELECT flow, min(seq) AS anchor FROM n_steps WHERE node = entry_node AND edge_id IS NULL GROUP BY flow), s AS (SELECT n_steps.*, coalesce(seq = anchor, false) AS entry FROM n_steps LEFT JOIN a USING (flow)),
r AS (SELECT edge_id, source AS f, target AS node, edge_type, confidence FROM n_relations WHERE edge_type = 'CALLS' UNION ALL SELECT edge_id, target, source, edge_type, confidence FROM n_relations WHERE edge_type = 'EXPOSES'),
v AS (SELECT s.flow, s.seq, r.edge_type, r.confidence FROM s JOIN r ON r.node = s.node WHERE NOT entry AND EXISTS (SELECT 1 FROM n_steps e WHERE e.flow = s.flow AND e.node = r.f AND e.seq < s.seq)
 QUALIFY row_number() OVER (PARTITION BY s.flow, s.seq ORDER BY CASE r.confidence WHEN 'CONFIRMED' THEN 0 WHEN 'LIKELY' THEN 1 ELSE 2 END, r.edge_id) = 1)
SELECT s.flow, s.seq, node, entry, CASE WHEN o.edge_id IS NULL THEN v.edge_type ELSE o.edge_type END AS edge_type, CASE WHEN o.edge_id IS NULL THEN v.confidence ELSE o.confidence END AS confidence FROM s LEFT JOIN v USING (flow, seq) LEFT JOIN n_relations o ON o.edge_id = s.edge_id""")
def flow_verdicts(spark, d):
    return D.step_verdicts(view(spark, d, "n_steps"), view(spark, d, "n_relations"))


@query("""+ o AS (SELECT DISTINCT sample, owner FROM n_processes WHERE pid = owner), r AS (SELECT p.* FROM n_processes p JOIN o USING (sample, owner)), w AS (SELECT DISTINCT sample, owner, pid FROM r WHERE pid = owner OR scope_owner = owner UNION SELECT r.sample, r.owner, r.pid FROM w JOIN r ON r.sample = w.sample AND r.ppid = w.pid)
SELECT sample, owner, sum(rss_kib)::BIGINT AS rss_kib FROM r JOIN w USING (sample, owner, pid) GROUP BY ALL""")
def process_tree_rss(spark, d):
    return D.process_tree_rss(view(spark, d, "n_processes"))


@query("""+ a AS (SELECT DISTINCT cell, edge_type AS relation, path, span, 'FACT' AS resolution, target AS targets, false AS oversized FROM n_seen WHERE confidence = 'CONFIRMED')
FROM a UNION ALL SELECT cell, edge_type, path, span, 'CANDIDATES', string_agg(DISTINCT target, ',' ORDER BY target), count(DISTINCT target) > 5 FROM n_seen WHERE confidence <> 'CONFIRMED' GROUP BY ALL""")
def graph_observations(spark, d):
    return D.graph_to_observations(view(spark, d, "n_seen"))
