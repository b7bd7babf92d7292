"""The summary of each snapshot as one nested document: areas, first features, flows and findings, files; as JSON and as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.privacy import redact_secrets
from quarry.operators.tables import first_by

#: How many of a snapshot are told, and which findings.
FEATURES, FLOWS, FINDINGS = 20, 10, 20
SEVERITIES = ("CRITICAL", "HIGH")
PAGES = ("features", "flows", "analysis", "code")


def _listed(rows: DataFrame, order: list[Column], fields: list[str], name: str, secret: str, k: int | None = None) -> DataFrame:
    """snapshot_id, `name`: the rows of each snapshot as an array in this order, at most k. With k, every task passes on k rows of a snapshot at most."""
    rows = first_by(rows, ["snapshot_id"], order, k) if k else rows.withColumn("rank", F.struct(*order))
    rows = rows.select("snapshot_id", "rank", *[redact_secrets(F.col(f)).alias(f) if f == secret else f for f in fields])
    told = F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("told"))))
    return rows.groupBy("snapshot_id").agg(F.transform(told, lambda s: s["told"]).alias(name))


def export_summary(snapshots: DataFrame, areas: DataFrame, technologies: DataFrame, features: DataFrame, flows: DataFrame, findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row per snapshot (snapshot_id, project_id, project, source_type, commit_sha, analyzed_at): its fields and the arrays areas, features, flows, findings and
    the count inventoried_files. Names, technologies and titles are redacted; what a snapshot lacks is an empty array or 0.

    Areas of a snapshot and technologies of an area are as many as there are kinds of them; all else is limited before it is gathered, so nothing that
    grows with a snapshot is held in one task."""
    tech = technologies.groupBy("snapshot_id", "area_type").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("technologies"))
    joined = areas.select("snapshot_id", "area_type", "confidence").join(tech, ["snapshot_id", "area_type"], "left")
    by_confidence = -F.coalesce(F.col("confidence"), F.lit(float("-inf")))
    parts = {
        "areas": _listed(joined, [by_confidence.alias("c"), F.col("area_type")], ["area_type", "confidence", "technologies"], "areas", "technologies"),
        "features": _listed(features, [F.desc_nulls_last("confidence"), F.col("id")], ["id", "name", "detection", "confidence"], "features", "name", FEATURES),
        "flows": _listed(flows, [F.col("id")], ["id", "name", "kind"], "flows", "name", FLOWS),
        "findings": _listed(findings.filter(F.col("severity").isin(*SEVERITIES)), [F.col("severity") != SEVERITIES[0], F.col("id")], ["id", "category", "severity", "title"], "findings", "title", FINDINGS),
    }
    out = snapshots.select("snapshot_id", "project_id", redact_secrets(F.col("project")).alias("project"), "source_type", "commit_sha", "analyzed_at")
    for name, part in parts.items():
        empty = F.array().cast(part.schema[name].dataType)
        out = out.join(part, "snapshot_id", "left").withColumn(name, F.coalesce(name, empty))
    counted = files.groupBy("snapshot_id").agg(F.count("*").alias("inventoried_files"))
    return out.join(counted, "snapshot_id", "left").withColumn("inventoried_files", F.coalesce("inventoried_files", F.lit(0)))


def _date() -> Column:
    return F.coalesce(F.date_format("analyzed_at", "yyyy-MM-dd"), F.lit("N/A"))


def summary_json(summary: DataFrame) -> DataFrame:
    """snapshot_id, document: the summary as JSON, with links to the project's pages. Null fields are written."""
    at = F.concat(F.lit("/projects/"), F.col("project_id").cast("string"), F.lit("/"))
    links = F.struct(*[F.concat(at, F.lit(p)).alias(p) for p in PAGES])
    fields = F.struct(
        F.col("project").alias("projectName"), F.col("source_type").alias("sourceType"), F.col("commit_sha").alias("commitSha"), _date().alias("analyzedAt"), F.col("project_id").alias("projectId"),
        F.transform("areas", lambda a: F.struct(a["area_type"].alias("areaType"), a["confidence"].alias("confidence"), a["technologies"].alias("technologies"))).alias("areas"),
        "features", "flows", "findings", F.struct(F.col("inventoried_files").alias("inventoriedFiles")).alias("coverage"), links.alias("_links"),
    )
    return summary.select("snapshot_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("document"))


def summary_markdown(summary: DataFrame) -> DataFrame:
    """snapshot_id, document: the summary as a Markdown page. Nulls are written as a dash, bars inside cells are escaped."""
    cell = lambda c: F.coalesce(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("—"))
    share = lambda c: F.when(c.isNull(), "—").otherwise(F.format_string("%.0f%%", c * 100))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    link = lambda page, x: line("[→ view](/projects/", F.col("project_id").cast("string"), f"/{page}/", x["id"].cast("string"), ")")

    def part(name: str, f, head: list[str], none: str | None) -> Column:
        """The lines of a list below its heading, or what is said where there are none."""
        lines = F.concat(F.array(*map(F.lit, head)).cast("array<string>"), F.transform(name, f))
        if none:
            lines = F.when(F.size(name) == 0, F.array(F.lit(none))).otherwise(lines)
        return F.array_join(lines, "\n")

    told = [
        line("# ", cell(F.col("project")), " — Analysis Summary\n\n**Date:** ", _date(), "\n**Commit:** `", cell(F.col("commit_sha")), "`\n**Source:** ", cell(F.col("source_type"))),
        F.lit("## Areas"),
        part("areas", lambda a: line("| ", cell(a["area_type"]), " | ", share(a["confidence"]), " | ", cell(a["technologies"]), " |"), ["| Area | Confidence | Technologies |", "| --- | --- | --- |"], None),
        F.lit("## Key Features"),
        part("features", lambda x: line("- **", cell(x["name"]), "** (", cell(x["detection"]), ", ", share(x["confidence"]), ") ", link("features", x)), [], "_No features detected._"),
        F.lit("## Representative Flows"),
        part("flows", lambda x: line("- **", cell(x["name"]), "** (", cell(x["kind"]), ") ", link("flows", x)), [], "_No flows detected._"),
        F.lit("## Risk Findings"),
        part("findings", lambda x: line("| ", cell(x["severity"]), " | ", cell(x["category"]), " | ", cell(x["title"]), " |"), ["| Severity | Category | Title |", "| --- | --- | --- |"], "_No high/critical findings._"),
        line("## Coverage\n\n- Inventoried files: ", F.col("inventoried_files").cast("string")),
    ]
    return summary.select("snapshot_id", F.concat(F.concat_ws("\n\n", *told), F.lit("\n")).alias("document"))
