"""Commits, pull requests and snapshots over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import base_name
from quarry.operators.listing import severity_rank

#: Manifests whose changes mark an era of technology.
MANIFESTS = ("pom.xml", "package.json", "docker-compose.yml", "docker-compose.yaml", "build.gradle", "build.gradle.kts", "settings.gradle", "go.mod", "requirements.txt", "pyproject.toml")
NESTED = ("package.json", "pom.xml", "docker-compose.yml", "build.gradle")
VERBS = {"ADD": "Introduced", "MODIFY": "Updated"}


def eras(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """project_id, sha, committed_at, path, label of every change of a manifest."""
    p = F.col("path")
    manifest = p.isin(*MANIFESTS) | p.endswith(".tf") | p.rlike("/(" + "|".join(n.replace(".", "\\.") for n in NESTED) + ")$")
    verb = F.col("change_type")
    for k, v in VERBS.items():
        verb = F.when(F.col("change_type") == k, v).otherwise(verb)
    files = commit_files.filter(manifest).select("project_id", "sha", "path", F.concat(verb, F.lit(" "), base_name(p)).alias("label"))
    return files.join(commits.select("project_id", "sha", "committed_at"), ["project_id", "sha"])


def commits_page(commits: DataFrame, project: int, page: int, size: int) -> DataFrame:
    """A page of a project's commits, newest first (unknown times first), then by hash."""
    mine = commits.filter(F.col("project_id") == project)
    return mine.orderBy(F.desc_nulls_first("committed_at"), "sha").offset(page * size).limit(size)


def pulls_of(pulls: DataFrame, state: str | None = None) -> DataFrame:
    """Pull requests in a state (any case), or all."""
    return pulls if state is None else pulls.filter(F.lower("state") == state.lower())


def latest_pull(pulls: DataFrame) -> DataFrame:
    """The pull request of the highest number of each project."""
    rest = [c for c in pulls.columns if c != "project_id"]
    best = pulls.groupBy("project_id").agg(F.max_by(F.struct(*rest), "number").alias("r"))
    return best.select("project_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def commit_churn(diff_lines: DataFrame) -> DataFrame:
    """sha, additions, deletions, files of a table of changed lines (sha, path, sign)."""
    n = lambda s: F.count_if(F.col("sign") == s)
    return diff_lines.groupBy("sha").agg(n("+").alias("additions"), n("-").alias("deletions"), F.count_distinct("path").alias("files"))


def commits_for_paths(commits: DataFrame, commit_files: DataFrame, paths: DataFrame, k: int = 5) -> DataFrame:
    """project_id, path, sha, rank of the newest k commits of a project that touch each path; those without a time come last."""
    j = commit_files.join(paths.select("path").distinct(), "path", "left_semi").select("project_id", "sha", "path").distinct().join(commits.select("project_id", "sha", "committed_at"), ["project_id", "sha"])
    rank = F.row_number().over(W.partitionBy("project_id", "path").orderBy(F.desc_nulls_last("committed_at"), "sha"))
    return j.withColumn("rank", rank).filter(F.col("rank") <= k).select("project_id", "path", "sha", "rank")


def review_context(pulls: DataFrame, commit_files: DataFrame, findings: DataFrame, evidence: DataFrame, files: int = 40, most: int = 30) -> DataFrame:
    """project_id, number, kind, place, item, detail, at: the first changed files of each pull request's head commit by path, with their change; and the first
    findings of its project that are not dismissed, by severity and id, once for each place of their evidence (finding_id, evidence_id, path,
    line). Findings without evidence are left out; a line that is not known is the first."""
    changed = pulls.select("project_id", "number", F.col("head_sha").alias("sha")).join(commit_files.select("project_id", "sha", "path", "change_type"), ["project_id", "sha"])
    first = lambda df, k, keys, *order: df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k)
    changed = first(changed, files, ["project_id", "number"], "path", "change_type").select("project_id", "number", F.lit("FILE").alias("kind"), "place", F.col("path").alias("item"), F.col("change_type").alias("detail"), F.lit(None).cast("string").alias("at"))
    # A project's findings are cut before they meet its pull requests.
    worst = findings.filter("status <> 'DISMISSED'").join(evidence.withColumnRenamed("finding_id", "id"), "id")
    worst = first(worst, most, ["project_id"], severity_rank(F.col("severity")), "id", "evidence_id")
    at = F.concat("path", F.lit(":"), F.coalesce("line", F.lit(1)).cast("string"))
    worst = worst.select("project_id", F.lit("FINDING").alias("kind"), "place", F.col("id").cast("string").alias("item"), F.concat_ws(" ", "severity", "category", "title").alias("detail"), at.alias("at"))
    return changed.unionByName(pulls.select("project_id", "number").join(worst, "project_id").select(changed.columns))


def retain_snapshots(snapshots: DataFrame, note_refs: DataFrame, keep: int = 2) -> DataFrame:
    """snapshot_id of the READY legacy snapshots to delete: all but the newest `keep` of their project, none that a note refers to."""
    old = snapshots.filter("status = 'READY' and legacy").withColumn("rank", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("snapshot_id"))))
    return old.filter(F.col("rank") > keep).select("project_id", "snapshot_id").join(note_refs.select("snapshot_id").distinct(), "snapshot_id", "left_anti").select("project_id", "snapshot_id")
