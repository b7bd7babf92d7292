"""Literal cases of the summary export."""

import datetime
import json

from quarry.operators.export import export_summary, summary_json, summary_markdown


def tables(spark, features=None, findings=None):
    day = datetime.datetime(2024, 3, 5, 10)
    table = spark.createDataFrame
    return (
        table([(1, 7, "Shop", "GIT", "abc", day), (2, 8, "Bare | one", "LOCAL", None, None)], "snapshot_id long, project_id long, project string, source_type string, commit_sha string, analyzed_at timestamp"),
        table([(1, "BACKEND", 0.9), (1, "API", 0.9), (1, "WEB", None)], "snapshot_id long, area_type string, confidence double"),
        table([(1, "API", "z"), (1, "API", "b"), (3, "API", "lost")], "snapshot_id long, area_type string, name string"),
        table(features or [(1, 5, "Pay", "ROUTE", 0.5), (1, 4, 'Pay password = "hunter22xyz!"', "ROUTE", 0.555), (1, 6, "Idle", "ROUTE", None)], "snapshot_id long, id long, name string, detection string, confidence double"),
        table([(1, 9, "checkout", "HTTP"), (1, 8, None, "HTTP")], "snapshot_id long, id long, name string, kind string"),
        table(findings or [(1, 1, "RISK", "HIGH", "b"), (1, 2, "RISK", "LOW", "never"), (1, 3, "RISK", "CRITICAL", "a|b")], "snapshot_id long, id long, category string, severity string, title string"),
        table([(1, "p"), (1, "q")], "snapshot_id long, path string"),
    )


def documents(df):
    return {r.snapshot_id: r.document for r in df.collect()}


def test_json(spark):
    got = {k: json.loads(v) for k, v in documents(summary_json(export_summary(*tables(spark)))).items()}
    one, bare = got[1], got[2]
    assert [(a["areaType"], a["confidence"], a["technologies"]) for a in one["areas"]] == [("API", 0.9, "b, z"), ("BACKEND", 0.9, None), ("WEB", None, None)]
    assert [f["id"] for f in one["features"]] == [4, 5, 6] and "hunter22" not in one["features"][0]["name"]
    assert [f["id"] for f in one["flows"]] == [8, 9] and [f["title"] for f in one["findings"]] == ["a|b", "b"]
    assert one["coverage"] == {"inventoriedFiles": 2} and one["_links"]["code"] == "/projects/7/code" and one["analyzedAt"] == "2024-03-05"
    assert [bare[k] for k in ("areas", "features", "flows", "findings", "commitSha", "analyzedAt")] == [[], [], [], [], None, "N/A"] and bare["coverage"]["inventoriedFiles"] == 0


def test_markdown(spark):
    got = documents(summary_markdown(export_summary(*tables(spark))))
    lines = got[1].split("\n")
    assert lines[:4] == ["# Shop — Analysis Summary", "", "**Date:** 2024-03-05", "**Commit:** `abc`"]
    assert "| API | 90% | b, z |" in lines and "| WEB | — | — |" in lines
    assert "- **Pay** (ROUTE, 50%) [→ view](/projects/7/features/5)" in lines and "- **—** (HTTP) [→ view](/projects/7/flows/8)" in lines
    assert lines.index("| CRITICAL | RISK | a\\|b |") + 1 == lines.index("| HIGH | RISK | b |") and lines[-2] == "- Inventoried files: 2"
    assert got[2] == (
        "# Bare \\| one — Analysis Summary\n\n**Date:** N/A\n**Commit:** `—`\n**Source:** LOCAL\n\n## Areas\n\n| Area | Confidence | Technologies |\n| --- | --- | --- |\n\n## Key Features\n\n_No features detected._\n\n"
        "## Representative Flows\n\n_No flows detected._\n\n## Risk Findings\n\n_No high/critical findings._\n\n## Coverage\n\n- Inventoried files: 0\n"
    )


def test_limits_before_gathering(spark):
    """The most confident twenty and the first twenty by severity; each task drops the rest before the shuffle."""
    features = [(1, i, f"f{i}", "D", (i % 50) / 50) for i in range(500)]
    findings = [(1, i, "C", "CRITICAL" if i >= 490 else "HIGH", f"t{i}") for i in range(500)]
    summary = export_summary(*tables(spark, features, findings))
    row = summary.filter("snapshot_id = 1").first()
    assert [f.id for f in row.features] == [f[1] for f in sorted(features, key=lambda f: (-f[4], f[1]))[:20]]
    assert [f.id for f in row.findings] == [*range(490, 500), *range(10)]
    assert "WindowGroupLimit" in summary._jdf.queryExecution().executedPlan().toString()
