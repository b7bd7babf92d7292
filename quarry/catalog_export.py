"""Registered queries of summaries; importing this adds them to the catalog."""

from __future__ import annotations

from quarry.catalog import query
from quarry.operators import export as X
from quarry.plans.derived import VIEWS, view

VIEWS.update({
    "sy_snapshots": """SELECT n_nationkey AS snapshot_id, n_regionkey AS project_id, n_name AS project, CASE WHEN n_nationkey % 2 = 0 THEN 'GIT' ELSE 'LOCAL' END AS source_type, CASE WHEN n_nationkey % 5 <> 0 THEN md5(n_name) END AS commit_sha, CAST('2024-03-05 00:00:00' AS TIMESTAMP) AS analyzed_at FROM nation
 UNION ALL SELECT r_regionkey + 100, r_regionkey, r_name, 'GIT', NULL, NULL FROM region""",
    "sy_areas": "SELECT c_nationkey AS snapshot_id, c_mktsegment AS area_type, max(c_custkey % 100) / 100.0E0 AS confidence FROM customer GROUP BY c_nationkey, c_mktsegment",
    "sy_technologies": "SELECT DISTINCT c_nationkey AS snapshot_id, c_mktsegment AS area_type, concat('tech', c_custkey % 7) AS name FROM customer WHERE c_custkey % 3 = 0",
    "sy_features": "SELECT o_custkey % 25 AS snapshot_id, o_orderkey AS id, concat('Order ', o_orderkey) AS name, o_orderstatus AS detection, CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 101) / 100.0E0 END AS confidence FROM orders",
    "sy_flows": "SELECT p_partkey % 23 AS snapshot_id, p_partkey AS id, p_name AS name, p_brand AS kind FROM part",
    "sy_findings": "SELECT user_id % 25 AS snapshot_id, event_id AS id, event_type AS category, CASE event_id % 9 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, concat('Seen ', event_id) AS title FROM events",
    "sy_files": "SELECT doc_id % 21 AS snapshot_id, doc_id FROM documents",
})

SUMMARY = """t AS (SELECT snapshot_id, area_type, string_agg(name, ', ' ORDER BY name) AS technologies FROM sy_technologies GROUP BY ALL),
a AS (SELECT snapshot_id, list({'areaType': area_type, 'confidence': confidence, 'technologies': technologies} ORDER BY confidence DESC, area_type) AS areas FROM sy_areas LEFT JOIN t USING (snapshot_id, area_type) GROUP BY snapshot_id),
fe AS (SELECT * FROM sy_features QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY confidence DESC NULLS LAST, id) <= 20),
f AS (SELECT snapshot_id, list({'id': id, 'name': name, 'detection': detection, 'confidence': confidence} ORDER BY confidence DESC NULLS LAST, id) AS features FROM fe GROUP BY snapshot_id),
w AS (SELECT snapshot_id, list({'id': id, 'name': name, 'kind': kind} ORDER BY id)[1:10] AS flows FROM sy_flows GROUP BY snapshot_id),
i AS (SELECT snapshot_id, list({'id': id, 'category': category, 'severity': severity, 'title': title} ORDER BY severity, id)[1:20] AS findings FROM sy_findings WHERE severity IN ('HIGH', 'CRITICAL') GROUP BY snapshot_id),
n AS (SELECT snapshot_id, count(*) AS n FROM sy_files GROUP BY snapshot_id),
e AS (SELECT s.*, coalesce(strftime(analyzed_at, '%Y-%m-%d'), 'N/A') AS day, coalesce(areas, []) AS areas, coalesce(features, []) AS features, coalesce(flows, []) AS flows, coalesce(findings, []) AS findings, coalesce(n, 0) AS n
 FROM sy_snapshots s LEFT JOIN a USING (snapshot_id) LEFT JOIN f USING (snapshot_id) LEFT JOIN w USING (snapshot_id) LEFT JOIN i USING (snapshot_id) LEFT JOIN n USING (snapshot_id))"""


def summaries(spark, d):
    return X.export_summary(*(view(spark, d, f"sy_{t}") for t in ("snapshots", "areas", "technologies", "features", "flows", "findings", "files")))


@query(f"""+ {SUMMARY} SELECT snapshot_id, CAST(to_json({{'projectName': project, 'sourceType': source_type, 'commitSha': commit_sha, 'analyzedAt': day, 'projectId': project_id, 'areas': areas, 'features': features, 'flows': flows, 'findings': findings, 'coverage': {{'inventoriedFiles': n}},
 '_links': {{'features': concat('/projects/', project_id, '/features'), 'flows': concat('/projects/', project_id, '/flows'), 'analysis': concat('/projects/', project_id, '/analysis'), 'code': concat('/projects/', project_id, '/code')}}}}) AS VARCHAR) AS document FROM e""")
def export_summary_json(spark, d):
    """Nations as snapshots with their areas, features, flows, findings and files (the limits are the feature)."""
    return X.summary_json(summaries(spark, d))


@query(f"""+ {SUMMARY} SELECT snapshot_id, concat('# ', project, ' — Analysis Summary\n\n**Date:** ', day, '\n**Commit:** `', coalesce(commit_sha, '—'), '`\n**Source:** ', source_type, '\n\n## Areas\n\n',
 array_to_string(list_concat(['| Area | Confidence | Technologies |', '| --- | --- | --- |'], list_transform(areas, lambda x: concat('| ', x.areaType, ' | ', coalesce(CAST(CAST(round(x.confidence * 100) AS INT) AS VARCHAR) || '%', '—'), ' | ', coalesce(x.technologies, '—'), ' |'))), '\n'), '\n\n## Key Features\n\n',
 CASE WHEN len(features) = 0 THEN '_No features detected._' ELSE array_to_string(list_transform(features, lambda x: concat('- **', x.name, '** (', x.detection, ', ', coalesce(CAST(CAST(round(x.confidence * 100) AS INT) AS VARCHAR) || '%', '—'), ') [→ view](/projects/', project_id, '/features/', x.id, ')')), '\n') END, '\n\n## Representative Flows\n\n',
 CASE WHEN len(flows) = 0 THEN '_No flows detected._' ELSE array_to_string(list_transform(flows, lambda x: concat('- **', x.name, '** (', x.kind, ') [→ view](/projects/', project_id, '/flows/', x.id, ')')), '\n') END, '\n\n## Risk Findings\n\n',
 CASE WHEN len(findings) = 0 THEN '_No high/critical findings._' ELSE array_to_string(list_concat(['| Severity | Category | Title |', '| --- | --- | --- |'], list_transform(findings, lambda x: concat('| ', x.severity, ' | ', x.category, ' | ', x.title, ' |'))), '\n') END,
 '\n\n## Coverage\n\n- Inventoried files: ', n, '\n') AS document FROM e""")
def export_summary_markdown(spark, d):
    return X.summary_markdown(summaries(spark, d))
