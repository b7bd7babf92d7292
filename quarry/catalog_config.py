"""Registered queries over migrations, flows and configuration files; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.catalog_graph import BACKEND
from quarry.operators import derive as D
from quarry.operators import config as Y
from quarry.operators import migrations as M
from quarry.plans.derived import VIEWS, view

VIEWS.update({
    "y_files": """SELECT concat('app', c_custkey, '/docker-compose.yml') AS path, concat('# services', chr(10), 'services:', chr(10), '  web', c_custkey, ':', chr(10), '    image: \"web:', c_nationkey, '\"   # now', chr(10), '    ports:', chr(10), '      - \"', c_custkey, ':80\"', chr(10), '      - 9', c_custkey, chr(10),
  CASE WHEN c_custkey % 3 = 0 THEN concat('    environment:', chr(10), '      - A=1', chr(10), '      - B', chr(10)) ELSE concat('    environment:', chr(10), '      KEY', c_custkey, ': a=b', chr(10)) END, CASE WHEN c_custkey % 2 = 0 THEN concat('    depends_on: [db, cache]', chr(10)) ELSE concat('    depends_on:', chr(10), '      db:', chr(10), '        condition: ready', chr(10)) END,
  CASE c_custkey % 4 WHEN 0 THEN concat('    build: ./web', chr(10)) WHEN 1 THEN concat('    build:', chr(10), '      context: ../x', chr(10), '      dockerfile: D', chr(10)) ELSE '' END, '  db:', chr(10), '    image: ', CASE WHEN c_custkey % 10 = 7 THEN '&main ' ELSE '' END, 'postgres # main', chr(10)) AS text FROM customer
 UNION ALL SELECT concat('k8s/', s_suppkey, '.yaml'), concat(CASE WHEN s_suppkey % 3 = 0 THEN concat('kind: List', chr(10), 'items:', chr(10), '- kind: Deployment', chr(10), '  metadata: ', chr(10), '    name: pod', s_suppkey, chr(10), '  spec:', chr(10), '    replicas: ', s_suppkey % 5, chr(10), '    template:', chr(10), '      spec:', chr(10), '        containers:', chr(10), '        - image: i', s_suppkey, chr(10), '        - name: x', chr(10), '          image: side', chr(10), '- kind: Pod', chr(10))
  ELSE concat('---', chr(10), 'kind: StatefulSet', chr(10), 'metadata:', chr(10), '  namespace: ', chr(39), 'ns', s_nationkey, chr(39), chr(10), '  name: pod', s_suppkey, chr(10), '---', chr(10), 'kind: Service', chr(10), 'metadata:', chr(10), '  labels: {}', chr(10), '---', chr(10), '# empty', chr(10)) END) FROM supplier
 UNION ALL SELECT concat('.github/workflows/w', s_suppkey, '.yml'), concat(CASE WHEN s_suppkey % 2 = 0 THEN concat('name: Build ', s_name, chr(10), 'on: push', chr(10)) ELSE concat('on:', chr(10), '  push:', chr(10), '    branches: [main]', chr(10), '  schedule:', chr(10), '    - cron: daily', chr(10)) END, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE concat('jobs:', chr(10), '  test:', chr(10), '    runs-on: ubuntu', chr(10), '    steps:', chr(10), '      - uses: actions/checkout@v4', chr(10), '      - name: Run', chr(10), '        run: |', chr(10), '          make #all', chr(10), '            more: x', chr(10), '  lint:', chr(10), '    needs: test', chr(10)) END) FROM supplier
 UNION ALL SELECT concat('src/application-', c_custkey, '.yml'), concat('server:', chr(10), '  port: 1', chr(10), CASE c_custkey % 5 WHEN 0 THEN concat('spring:', chr(10), '  datasource:', chr(10), '    url: jdbc:postgresql://localhost:5432/x', chr(10)) WHEN 1 THEN concat('datasource:', chr(10), '  url: jdbc:mysql://mysql/x', chr(10), 'redis:', chr(10), '  host: r', c_custkey, chr(10)) WHEN 2 THEN concat('spring:', chr(10), '  datasource:', chr(10), '    url: jdbc:mysql://far/x', chr(10), '  data:', chr(10), '    redis:', chr(10), '      port: 1', chr(10), '  redis:', chr(10), '    host: old', chr(10), '---', chr(10), 'kafka: {}', chr(10)) ELSE '' END) FROM customer""",
    "f_edges": """SELECT concat('order:', o_orderkey) AS source, concat('part:', o_custkey % 40 * 5 + 1) AS target, 'CONSUMES' AS edge_type, 'CONFIRMED' AS confidence FROM orders WHERE o_orderkey % 3 = 0
 UNION ALL SELECT concat('order:', o_orderkey), concat('part:', o_custkey % 23 * 5 + 6), 'CONSUMES', 'LIKELY' FROM orders WHERE o_orderkey % 9 = 0 AND o_custkey % 23 * 5 + 6 <> o_custkey % 40 * 5 + 1
 UNION ALL SELECT concat('order:', o_orderkey), concat('part:', o_custkey % 30 * 5 + 5), 'CONSUMES', 'LIKELY' FROM orders WHERE o_orderkey % 20 = 0 UNION ALL SELECT concat('order:', o_orderkey), concat('order:', o_orderkey), 'CONSUMES', 'LIKELY' FROM orders WHERE o_orderkey % 31 = 0
 UNION ALL SELECT concat('region:', n_regionkey), concat('nation:', n_nationkey), 'DEPLOYED_IN', 'CONFIRMED' FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT concat('pod:', s_suppkey), concat('nation:', s_nationkey), 'DEPLOYED_IN', 'CONFIRMED' FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT concat('pod:', s_suppkey), concat('nation:', (s_nationkey + 9) % 25), 'DEPLOYED_IN', 'CONFIRMED' FROM supplier WHERE s_suppkey % 2 = 0
 UNION ALL SELECT concat('supplier:', s_suppkey), concat('topic:', s_nationkey), CASE WHEN s_suppkey % 2 = 0 THEN 'PUBLISHES' ELSE 'SUBSCRIBES' END, 'CONFIRMED' FROM supplier UNION ALL SELECT concat('supplier:', s_suppkey), concat('topic:', s_nationkey), 'SUBSCRIBES', 'CONFIRMED' FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT 'gone', concat('topic:', n_nationkey), 'PUBLISHES', 'CONFIRMED' FROM nation""",
    "f_nodes": "SELECT concat('pod:', s_suppkey) AS natural_key, 'CONTAINER' AS node_type, concat('Pod ', s_suppkey) AS name, concat('k8s/', s_suppkey, '.yaml') AS path, 1 AS line_start, 'INFRASTRUCTURE' AS area_type, '{}' AS metadata FROM supplier UNION ALL SELECT concat('topic:', n_nationkey), 'QUEUE_TOPIC', concat('Topic ', n_name), concat('src/', n_nationkey, '.java'), 1, 'BACKEND', '{}' FROM nation",
    "m_files": r"""SELECT CAST(c_nationkey AS BIGINT) AS project, concat('db/migration/V1_', c_custkey, '__create.sql') AS path, concat('-- it''s for ', c_name, ';', chr(10), 'create table if not exists app."t', c_custkey, '" (', chr(10), '  id bigint primary key,', chr(10), '  name varchar(20) default ''a;b'',', chr(10), '  seg numeric(10,2) not null,', chr(10), '  constraint k check (id > 0)', chr(10), ');', chr(10), '/* done; */') AS text FROM customer
 UNION ALL SELECT CAST(c_nationkey AS BIGINT), concat('db/migration/V2_', o_orderkey, '__change.sql'), CASE WHEN o_orderkey % 41 = 0 THEN concat('drop table if exists t', c_custkey, ' cascade;') WHEN o_orderkey % 43 = 0 THEN concat('alter table t', c_custkey, ' add column "broken int;')
  WHEN o_orderkey % 5 = 0 THEN concat('ALTER TABLE t', c_custkey, ' DROP COLUMN c', o_orderkey % 3, ' CASCADE;') WHEN o_orderkey % 5 = 1 THEN concat('create index i', o_orderkey, ' on t', c_custkey, ' (id);') WHEN o_orderkey % 5 = 2 THEN concat('insert into t', c_custkey, ' values (1, $x$create table no (id int);$x$);', chr(10), 'alter table t', c_custkey, ' add column C', o_orderkey % 3, ' double precision default 0, alter column name type text;')
  ELSE concat('alter table only t', c_custkey, ' add column c', o_orderkey % 3, ' numeric( ', o_orderkey % 7 + 1, ',1 ) not null;') END FROM orders JOIN customer ON c_custkey = o_custkey
 UNION ALL SELECT CAST(c_nationkey AS BIGINT), concat('db/migration/V3_', c_custkey, '__rename.sql'), concat('alter table t', c_custkey, ' rename to u', c_custkey, ';') FROM customer WHERE c_custkey % 4 = 0
 UNION ALL SELECT CAST(c_nationkey AS BIGINT), concat('db/migration/V4_', c_custkey, '__late.sql'), concat('alter table u', c_custkey, ' add late text;', chr(10), 'alter table u', c_custkey, ' rename to w', c_custkey, ';') FROM customer WHERE c_custkey % 8 = 0
 UNION ALL SELECT CAST(c_nationkey AS BIGINT), concat('src/', c_custkey, '.sql'), 'drop table t1;' FROM customer WHERE c_custkey % 9 = 0""",
})


@query("""WITH v AS (SELECT c_nationkey::BIGINT AS project, c_custkey AS t FROM customer),
o AS (SELECT o_custkey AS t, o_orderkey AS k FROM orders WHERE o_orderkey % 43 <> 0 OR o_orderkey % 41 = 0), dropped AS (SELECT t, max(k) AS gone FROM o WHERE k % 41 = 0 GROUP BY t),
touch AS (SELECT t, 0 AS ver, 0::BIGINT AS k, concat('db/migration/V1_', t, '__create.sql') AS path FROM v UNION ALL SELECT t, 1, k, concat('db/migration/V2_', k, '__change.sql') FROM o WHERE k % 41 <> 0 UNION ALL SELECT t, 2, 0, concat('db/migration/V3_', t, '__rename.sql') FROM v WHERE t % 4 = 0 UNION ALL SELECT t, 3, 0, concat('db/migration/V4_', t, '__late.sql') FROM v WHERE t % 8 = 0),
alive AS (SELECT touch.* FROM touch LEFT JOIN dropped USING (t) WHERE gone IS NULL OR ver > 1 OR ver = 1 AND k > gone), src AS (SELECT t, arg_min(path, (ver, k)) AS path FROM alive GROUP BY t),
named AS (SELECT project, v.t, CASE WHEN v.t % 8 = 0 THEN concat('w', v.t) WHEN v.t % 4 = 0 THEN concat('u', v.t) ELSE concat('t', v.t) END AS tab, path, path LIKE '%/V1_%' AS whole FROM v JOIN src USING (t)),
c AS (SELECT t, 0 AS ver, 0::BIGINT AS k, i, name, type, true AS there, concat('db/migration/V1_', t, '__create.sql') AS path, i + 2 AS line FROM v, (VALUES (1, 'id', 'bigint'), (2, 'name', 'varchar (20)'), (3, 'seg', 'numeric (10, 2)')) x(i, name, type) WHERE t NOT IN (SELECT t FROM dropped)
 UNION ALL SELECT t, 1, k, 1, CASE WHEN k % 5 = 2 THEN concat('C', k % 3) ELSE concat('c', k % 3) END, CASE WHEN k % 5 = 2 THEN 'double precision' ELSE concat('numeric (', k % 7 + 1, ', 1)') END, k % 5 <> 0, NULL, NULL FROM o LEFT JOIN dropped USING (t) WHERE k % 41 <> 0 AND k % 5 <> 1 AND (gone IS NULL OR k > gone)
 UNION ALL SELECT t, 1, k, 2, 'name', 'text', true, NULL, NULL FROM o LEFT JOIN dropped USING (t) WHERE k % 41 <> 0 AND k % 5 = 2 AND (gone IS NULL OR k > gone)
 UNION ALL SELECT t, 3, 0, 1, 'late', 'text', true, NULL, NULL FROM v WHERE t % 8 = 0),
z AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY t, lower(name) ORDER BY ver DESC, k DESC, i DESC) = 1), y AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY ver, k, i)::INT AS position FROM z WHERE there),
x AS (SELECT t, concat('i', k) AS name, row_number() OVER (PARTITION BY t ORDER BY k)::INT AS position FROM o LEFT JOIN dropped USING (t) WHERE k % 41 <> 0 AND k % 5 = 1 AND (gone IS NULL OR k > gone))
SELECT project, tab AS "table", 'TABLE' AS kind, 0 AS position, tab AS name, NULL AS type, path, CASE WHEN whole THEN 2 ELSE 1 END AS line_start, CASE WHEN whole THEN 7 END AS line_end FROM named
UNION ALL SELECT project, tab, 'COLUMN', position, name, type, y.path, line, line FROM y JOIN named USING (t) UNION ALL SELECT project, tab, 'INDEX', position, name, NULL, NULL, NULL, NULL FROM x JOIN named USING (t)""")
def replayed_migrations(spark, d):
    """Migrations of every customer's table: created, changed by the customer's orders, renamed."""
    return M.replay_migrations(view(spark, d, "m_files"))


@query("""+ m AS (SELECT *, path NOT LIKE 'src/%' AS m FROM m_files) SELECT project, path, CASE WHEN text LIKE '%"broken%' THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN text LIKE '%"broken%' THEN 'SQL_PARSE_FAILED' ELSE 'SQL_PARSED' END AS reason FROM m WHERE m""")
def migration_outcomes(spark, d):
    return M.migration_outcomes(view(spark, d, "m_files"))


@query("""+ m AS (SELECT project, path, regexp_extract(text, '[ .]"?([tu][0-9]+)"?[ (]', 1) AS "table" FROM m_files WHERE path NOT LIKE 'src/%' AND text NOT LIKE 'drop%' AND text NOT LIKE '%"broken%') SELECT * FROM m""")
def migration_dependencies(spark, d):
    return M.migration_dependencies(view(spark, d, "m_files"))


ALL = "fn AS (SELECT natural_key AS node, node_type, name FROM n_nodes UNION ALL SELECT natural_key, node_type, name FROM f_nodes), fe AS (SELECT source, target, edge_type FROM n_edges UNION ALL SELECT source, target, edge_type FROM f_edges)"


def _graph(spark, d):
    return view(spark, d, "n_nodes").unionByName(view(spark, d, "f_nodes")), view(spark, d, "n_edges").unionByName(view(spark, d, "f_edges"))


@query(f"""+ {BACKEND}, {ALL}, o AS (SELECT DISTINCT source AS flow, target AS node, edge_type, fn.node_type, fn.name FROM fe JOIN fn ON fn.node = target WHERE source <> target AND edge_type IN ('CONSUMES', 'CONTAINS') AND source IN (SELECT node FROM fn WHERE node_type = 'FE_ROUTE')),
u AS (SELECT flow, node, name FROM o WHERE edge_type = 'CONSUMES'), i AS (SELECT flow, node, name FROM o WHERE edge_type = 'CONTAINS' AND node_type = 'COMPONENT' AND NOT EXISTS (FROM u WHERE u.flow = o.flow AND u.node = o.node)),
s AS (SELECT node AS flow, 0 AS b, '' AS k, 0 AS q, node, NULL::VARCHAR AS edge_type, 'Route ' || name AS description FROM fn WHERE node_type = 'FE_ROUTE' UNION ALL SELECT flow, 1, node, 0, node, 'CONTAINS', name FROM i UNION ALL SELECT flow, 2, node, 0, node, 'CONSUMES', 'CONSUMES ' || name FROM u
 UNION ALL SELECT u.flow, 2, u.node, b.seq, b.node, NULL, fn.name FROM u JOIN backend b ON b.flow = u.node JOIN fn ON fn.node = b.node UNION ALL SELECT flow, 2, node, 1, node, NULL, name FROM u WHERE node NOT IN (SELECT flow FROM backend)),
r AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY b, CASE WHEN b = 1 THEN k END DESC NULLS LAST, k, q)::INT AS seq, count(*) OVER (PARTITION BY flow) AS n FROM s) SELECT 'FE_BE' AS kind, flow, seq, node, edge_type, description FROM r WHERE n > 1""")
def fe_be_flows(spark, d):
    """From front-end routes through what they consume to the back end."""
    return D.fe_be_flows(*_graph(spark, d))


@query(f"""+ {ALL}, s AS (SELECT node AS flow, 0 AS b, node, NULL::VARCHAR AS edge_type, name AS description FROM fn WHERE node_type = 'CONTAINER' UNION ALL SELECT DISTINCT c.node, 1, t.node, edge_type, 'DEPLOYED_IN ' || t.name FROM fe JOIN fn c ON c.node = source AND c.node_type = 'CONTAINER' JOIN fn t ON t.node = target WHERE edge_type = 'DEPLOYED_IN'),
r AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY b, node)::INT AS seq, count(*) OVER (PARTITION BY flow) AS n FROM s) SELECT 'INFRA' AS kind, flow, seq, node, edge_type, description FROM r WHERE n > 1""")
def infra_flows(spark, d):
    return D.infra_flows(*_graph(spark, d))


@query(f"""+ {ALL}, s AS (SELECT node AS flow, 1 AS b, node, NULL::VARCHAR AS edge_type, name AS description FROM fn WHERE node_type = 'QUEUE_TOPIC' UNION ALL SELECT DISTINCT t.node, 0, c.node, edge_type, edge_type || ' ' || c.name FROM fe JOIN fn c ON c.node = source JOIN fn t ON t.node = target AND t.node_type = 'QUEUE_TOPIC' WHERE edge_type IN ('PUBLISHES', 'SUBSCRIBES')),
r AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY b, edge_type, node)::INT AS seq, count(*) OVER (PARTITION BY flow) AS n FROM s) SELECT 'EVENT' AS kind, flow, seq, node, edge_type, description FROM r WHERE n > 1""")
def event_flows(spark, d):
    return D.event_flows(*_graph(spark, d))


def _rows(spark, d):
    return Y.yaml_rows(view(spark, d, "y_files"))


@query("""+ r AS (SELECT path AS file FROM y_files WHERE text LIKE '%&main%') SELECT file, 'anchors and tags are not read' AS reason FROM r""")
def refused_yaml(spark, d):
    """Files that are not read whole, each with the reason."""
    return _rows(spark, d).filter("kind = 'REFUSED'").select("file", F.substring_index("value", ":", 1).alias("reason"))


COMPOSED = """s AS (SELECT concat('app', c_custkey, '/docker-compose.yml') AS file, concat('web', c_custkey) AS service, 3 AS line, concat('web:', c_nationkey) AS image, concat(c_custkey, ':80,9', c_custkey) AS ports, CASE WHEN c_custkey % 3 = 0 THEN 'A,B' ELSE concat('KEY', c_custkey) END AS environment_keys, CASE WHEN c_custkey % 2 = 0 THEN 'db,cache' ELSE 'db' END AS depends_on,
 CASE c_custkey % 4 WHEN 0 THEN './web' WHEN 1 THEN '../x' END AS context, CASE c_custkey % 4 WHEN 0 THEN 'Dockerfile' WHEN 1 THEN 'D' END AS dockerfile FROM customer WHERE c_custkey % 10 <> 7
 UNION ALL SELECT concat('app', c_custkey, '/docker-compose.yml'), 'db', 8 + CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 2 END + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 3 END + CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END, 'postgres', '', '', '', NULL, NULL FROM customer WHERE c_custkey % 10 <> 7)"""


def _joined(df, *columns):
    return df.select(*[F.array_join(c, ",").alias(c) if c in columns else c for c in df.columns])


@query(f"WITH {COMPOSED} FROM s")
def compose_services(spark, d):
    return _joined(Y.compose_services(_rows(spark, d)), "ports", "environment_keys", "depends_on")


@query("""WITH s AS (SELECT concat('k8s/', s_suppkey, '.yaml') AS file, s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT file, 0 AS document, '[0]' AS item, 'CONTAINER' AS node_type, concat('container:pod', k) AS natural_key, 'Deployment' AS kind, concat('pod', k) AS name, '' AS namespace, concat('', k % 5) AS replicas, concat('i', k, ',side') AS images FROM s WHERE k % 3 = 0
UNION ALL SELECT file, 0, '', 'CONTAINER', concat('container:pod', k), 'StatefulSet', concat('pod', k), concat('ns', n), NULL, '' FROM s WHERE k % 3 <> 0 UNION ALL SELECT file, 1, '', 'CLOUD_RESOURCE', 'cloud:kubernetes.service:service', 'Service', 'service', '', NULL, '' FROM s WHERE k % 3 <> 0""")
def cluster_resources(spark, d):
    return _joined(Y.cluster_resources(_rows(spark, d)), "images").drop("line")


@query("""WITH s AS (SELECT concat('.github/workflows/w', s_suppkey, '.yml') AS file, concat('w', s_suppkey, '.yml') AS f, s_suppkey AS k, s_name FROM supplier), j AS (SELECT unnest(['test', 'lint']) AS job),
x AS (SELECT s.*, coalesce(job, 'default') AS job FROM s LEFT JOIN j ON k % 7 <> 0)
SELECT file, 0 AS document, concat('ci:', f, ':', job) AS natural_key, CASE WHEN k % 2 = 0 THEN concat('Build ', s_name) ELSE f END AS workflow, job, CASE WHEN k % 2 = 0 THEN 'push' ELSE 'push,schedule' END AS triggers, CASE WHEN job = 'test' THEN 'ubuntu' END AS runs_on, CASE WHEN job = 'test' THEN 'uses=actions/checkout@v4,name=Run,run=make #all' ELSE '' END AS steps FROM x""")
def ci_jobs(spark, d):
    return _joined(Y.ci_jobs(_rows(spark, d)), "triggers", "steps")


SET = """a AS (SELECT concat('src/application-', c_custkey, '.yml') AS file, c_custkey % 5 AS m, CASE c_custkey % 5 WHEN 0 THEN 'datasource' WHEN 1 THEN 'datasource,redis' WHEN 2 THEN 'datasource,redis,kafka' ELSE '' END AS configured, CASE c_custkey % 5 WHEN 0 THEN 'jdbc:postgresql://localhost:5432/x' WHEN 1 THEN 'jdbc:mysql://mysql/x' WHEN 2 THEN 'jdbc:mysql://far/x' END AS datasource_url, CASE WHEN c_custkey % 5 = 1 THEN concat('r', c_custkey) END AS redis_host FROM customer)"""


@query(f"WITH {SET} SELECT file, concat('config:', file) AS natural_key, configured, datasource_url, redis_host FROM a")
def application_settings(spark, d):
    return _joined(Y.application_settings(_rows(spark, d)), "configured").drop("urls")


@query(f"""WITH {COMPOSED}, {SET} SELECT DISTINCT concat('container:', service) AS source, concat('container:', unnest(string_split(depends_on, ','))) AS target, 'DEPLOYED_IN' AS edge_type, 'CONFIRMED' AS confidence FROM s WHERE depends_on <> ''
UNION ALL SELECT concat('config:', file), 'container:postgres', 'CONFIGURED_BY', 'POSSIBLE' FROM a WHERE m = 0 UNION ALL SELECT concat('config:', file), 'container:mysql', 'CONFIGURED_BY', 'POSSIBLE' FROM a WHERE m = 1 UNION ALL SELECT concat('config:', file), 'container:redis', 'CONFIGURED_BY', 'POSSIBLE' FROM a WHERE m IN (1, 2)""")
def config_edges(spark, d):
    """What configuration says runs on what."""
    r = _rows(spark, d)
    return Y.config_edges(Y.compose_services(r), Y.application_settings(r))
