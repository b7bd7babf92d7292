"""Registered queries over extracted tables, reservations and streams in batch form; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import catalog_graph  # noqa: F401  # its views are used below
from quarry.catalog import query
from quarry.operators import derive as D
from quarry.operators import extract as X
from quarry.operators import tables as A
from quarry.plans.derived import VIEWS, view
from quarry.streaming import jobs

LF = "chr(10)"
VIEWS.update({
    "x_files": f"""SELECT concat('d', doc_id, CASE doc_id % 4 WHEN 0 THEN '/build.gradle' WHEN 1 THEN '/main.tf' WHEN 2 THEN '/Dockerfile' ELSE '/mod.py' END) AS path, CASE doc_id % 4
 WHEN 0 THEN concat('plugins {{ }}', {LF}, '  implementation "org.', lang, ':lib', doc_id % 9, ':1.', doc_id % 5, '"', {LF}, '  testImplementation(''a.b:c'')')
 WHEN 1 THEN concat('resource "aws_', lang, '" "r', doc_id, '" {{', {LF}, '}}', {LF}, '  resource "b" "c" {{ }}', {LF}, '# resource "no" "no" {{')
 WHEN 2 THEN concat('# FROM nothing', {LF}, 'from base:', lang, {LF}, 'RUN a', {LF}, 'EXPOSE ', doc_id % 100, ' ', chr(92), {LF}, '81', {LF}, 'CMD ["run"]')
 ELSE concat('import os, re', {LF}, 'from a.b import c', {LF}, 'class K', doc_id % 5, ':', {LF}, '    def m(self):', {LF}, '        pass', {LF}, CASE WHEN doc_id % 8 = 3 THEN 'def (' ELSE 'def f(): pass' END) END AS text FROM documents""",
    "x_requests": "SELECT o_custkey % 40 AS installation, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 97 = 0 THEN 'RESERVED' ELSE 'SETTLED' END AS status, CAST(o_totalprice AS BIGINT) AS reserved, CAST(floor(o_totalprice / 2) AS BIGINT) AS actual, CAST(5 AS BIGINT) AS floor, o_orderkey % 601 = 0 AS conflict FROM orders",
    "x_gates": "SELECT c_custkey AS installation, CAST(c_custkey % 7 * 90000 AS BIGINT) AS day_limit, CAST(c_custkey % 5 * 400000 AS BIGINT) AS month_limit FROM customer WHERE c_custkey <= 40",
    "x_new": "SELECT o_custkey % 40 AS installation, max(CAST(o_orderdate AS DATE)) AS day, CAST(1000 AS BIGINT) AS micro_usd FROM orders GROUP BY o_custkey % 40",
    "x_deliveries": "SELECT user_id AS subscriber, CAST(CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END AS BIGINT) AS delta, CAST(length(props) AS BIGINT) AS chars FROM events",
    "x_progress": "SELECT user_id AS job_id, event_type AS step, event_id AS seq, CASE event_id % 6 WHEN 0 THEN 'START' WHEN 1 THEN 'DONE' WHEN 2 THEN 'FAILED' ELSE 'PROGRESS' END AS kind, CASE WHEN event_id % 6 > 2 THEN event_id % 100 END AS progress FROM events",
})


@query("""SELECT path, 'implementation' AS scope, regexp_extract(text, 'implementation "([^:]*:[^:]*):', 1) AS dependency, regexp_extract(text, 'implementation "[^:]*:[^:]*:([^"]*)', 1) AS version FROM x_files WHERE path LIKE '%.gradle'
UNION ALL SELECT path, 'testImplementation', 'a.b:c', NULL FROM x_files WHERE path LIKE '%.gradle'""")
def declared_dependencies(spark, d):
    return X.extract_dependencies(view(spark, d, "x_files"))


@query("SELECT path, regexp_extract(text, 'resource \"(aws_[a-z]*)', 1) AS kind, regexp_extract(text, '\" \"(r[0-9]*)', 1) AS name FROM x_files WHERE path LIKE '%.tf' UNION ALL SELECT path, 'b', 'c' FROM x_files WHERE path LIKE '%.tf'")
def terraform_resources(spark, d):
    return X.extract_terraform(view(spark, d, "x_files"))


@query("""+ f AS (SELECT path, string_split(replace(text, chr(92) || chr(10), ' '), chr(10)) AS l FROM x_files WHERE path LIKE '%Dockerfile') SELECT path, 0 AS place, 'FROM' AS instruction, substr(l[2], 6) AS argument FROM f
UNION ALL SELECT path, 2, 'EXPOSE', substr(l[4], 8) FROM f UNION ALL SELECT path, 3, 'CMD', substr(l[5], 5) FROM f""")
def dockerfile_instructions(spark, d):
    return X.extract_dockerfiles(view(spark, d, "x_files"))


@query("""+ p AS (SELECT path, text, regexp_extract(text, 'class (K[0-9])', 1) AS k, text LIKE '%def (%' AS bad FROM x_files WHERE path LIKE '%.py'), f AS (SELECT unnest([('IMPORT', 'os', 1), ('IMPORT', 're', 1), ('IMPORT', 'a.b', 2), ('CLASS', '', 3), ('FUNCTION', '.m', 4), ('FUNCTION', 'f', 6)]) AS r)
SELECT path, r[1] AS kind, CASE WHEN r[3] IN (3, 4) THEN k || r[2] ELSE r[2] END AS name, r[3]::INT AS line FROM p, f WHERE NOT bad UNION ALL SELECT path, 'UNPARSED', '', 0 FROM p WHERE bad""")
def python_symbols(spark, d):
    return X.extract_python(view(spark, d, "x_files"))


@query("""+ c AS (SELECT installation, day AS on_day, conflict, status <> 'SETTLED' AS open, CASE WHEN status = 'SETTLED' THEN actual ELSE greatest(floor, reserved, coalesce(actual, 0)) END AS cost FROM x_requests),
t AS (SELECT n.installation, any_value(micro_usd) AS m, coalesce(any_value(day_limit), 0) AS dl, coalesce(any_value(month_limit), 0) AS ml, count(*) FILTER (open) AS o, bool_or(conflict) AS x, coalesce(sum(cost) FILTER (open), 0) AS held, coalesce(sum(cost) FILTER (NOT open AND on_day = n.day), 0) AS d,
 coalesce(sum(cost) FILTER (NOT open AND date_trunc('month', on_day) = date_trunc('month', n.day)), 0) AS mo FROM x_new n JOIN c USING (installation) LEFT JOIN x_gates USING (installation) GROUP BY n.installation)
SELECT installation, CASE WHEN o >= 2 OR x OR dl = 0 OR ml = 0 OR held + m + d > dl OR held + m + mo > ml THEN 'DENIED' ELSE 'ADMITTED' END AS decision FROM t""")
def reservations(spark, d):
    return A.admit_reservation(*[view(spark, d, n) for n in ("x_requests", "x_gates", "x_new")])


@query("SELECT subscriber, sum(delta)::BIGINT AS pending, sum(delta * chars)::BIGINT AS chars, sum(delta) > 4 OR sum(delta * chars) > 524288 AS closed FROM x_deliveries GROUP BY subscriber")
def subscriber_overflow(spark, d):
    """The streaming job on a bounded input."""
    return jobs.overflow(view(spark, d, "x_deliveries"), 4)


@query("""+ s AS (SELECT *, kind IN ('START', 'DONE', 'FAILED') AS k FROM x_progress) SELECT job_id, step, count(*) FILTER (kind = 'START') AS attempts, arg_max(progress, seq) FILTER (progress IS NOT NULL) AS progress,
 CASE arg_max(kind, seq) FILTER (k) WHEN 'START' THEN 'RUNNING' WHEN 'DONE' THEN 'DONE' WHEN 'FAILED' THEN 'FAILED' ELSE 'PENDING' END AS status FROM s GROUP BY job_id, step""")
def step_status(spark, d):
    """The streaming job on a bounded input."""
    return jobs.step_status(view(spark, d, "x_progress"))


@query(None)
def merged_seeds(spark, d):
    """Seeds of customers with runs of nodes, merged where they are alike; the order of merging matters, so a plain loop checks it in the tests."""
    s = view(spark, d, "n_seeds").withColumn("nodes", F.transform(F.sequence("lo", F.col("lo") + F.col("more") * 2), lambda x: F.concat(F.lit("n"), x.cast("string"))))
    m = D.merge_seeds(s.select("seed", "name", "endpoint", "nodes"))
    return m.select("name", "endpoint", F.array_join("nodes", ",").alias("nodes"))
