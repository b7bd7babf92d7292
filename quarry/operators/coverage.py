"""Outcomes of analysing files, and what they add up to. Unknown is not zero: what was not measured is UNMEASURED."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import last_wins

#: Languages with a parser, languages known but not analysed, and the capabilities each language has.
PARSED = ("java", "typescript", "javascript", "python", "go")
NOT_ANALYSED = ("kotlin", "swift", "rust", "ruby", "php", "csharp", "c", "cpp")
CAPABILITIES = ("S", "C", "F", "X")
OWNED = {"java": "SCFX", "typescript": "SCFX", "javascript": "SCFX", "sql": "SX", "python": "S", "go": "S"}
TERMINAL = ("SUCCESS", "PARTIAL", "FAILED", "UNSUPPORTED", "UNMEASURED")
STATES = ("SUCCESS", "PARTIAL", "FAILED", "UNSUPPORTED", "TARGETED", "UNMEASURED")
SAME_NAME = "AMBIGUOUS_SYMBOL_IDENTITY"


def initial_status(language: Column, path: Column) -> Column:
    """UNSUPPORTED for known languages that are not analysed; all others are not measured yet."""
    parsed = F.lower(F.coalesce(language, F.lit(""))).isin(*PARSED) | F.lower(path).rlike(r"\.(vue|svelte)$")
    return F.when(~parsed & F.lower(F.coalesce(language, F.lit(""))).isin(*NOT_ANALYSED), "UNSUPPORTED").otherwise("UNMEASURED")


def owned_capabilities(language: Column) -> Column:
    """Array of the capabilities that the language's analyzer has."""
    table = F.create_map(*[x for k, v in OWNED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, F.lower(F.coalesce(language, F.lit("")))), F.array().cast("array<string>"))


def unsupported_capabilities(files: DataFrame) -> DataFrame:
    """path, capability, status of what no analyzer does for a measured language."""
    lacks = F.array_except(F.array(*map(F.lit, CAPABILITIES)), owned_capabilities(F.col("language")))
    measured = F.lower("language").isin(*NOT_ANALYSED, *OWNED)
    return files.filter(measured).select("path", F.explode(lacks).alias("capability"), F.lit("UNSUPPORTED").alias("status"))


def apply_outcomes(files: DataFrame, submitted: DataFrame, outcomes: DataFrame) -> DataFrame:
    """files (path, status, reason, targeted) after a response to the submitted paths: just one terminal outcome (path, status, reason) is
    believed, otherwise the file is UNMEASURED. A file of an ambiguous name stays PARTIAL unless it FAILED; targeted stays once set; reasons
    are codes of up to 128 capitals, else PARSER_REPORTED."""
    one = outcomes.filter("path is not null").groupBy("path").agg(F.count("*").alias("n"), F.first("status").alias("s"), F.first("reason").alias("r"))
    x = submitted.select("path").distinct().join(one, "path", "left")
    ok = (F.col("n") == 1) & F.coalesce(F.col("s").isin(*TERMINAL), F.lit(False))
    code = F.when(F.col("r").rlike("^[A-Z_]{1,128}$"), F.col("r")).otherwise("PARSER_REPORTED")
    x = x.select("path", F.lit(True).alias("asked"), F.when(ok, F.col("s")).otherwise("UNMEASURED").alias("s"), F.when(ok, code).otherwise("ANALYZER_OUTCOME_MISSING_OR_INVALID").alias("r"))
    keep = F.col("reason").eqNullSafe(F.lit(SAME_NAME)) & (F.col("s") != "FAILED")
    new = lambda old, held, got: F.when(F.col("asked").isNull(), F.col(old)).when(keep, held).otherwise(got)
    return files.join(x, "path", "left").select("path", new("status", F.lit("PARTIAL"), F.col("s")).alias("status"), new("reason", F.col("reason"), F.col("r")).alias("reason"), (F.col("targeted") | F.coalesce(F.col("s") != "UNMEASURED", F.lit(False))).alias("targeted"))


def cross_domain_outcomes(files: DataFrame) -> DataFrame:
    """path, status, reason of the linking capability of each file (path, language, status) whose language has it."""
    s = F.col("status")
    status = F.when(s.isin("SUCCESS", "PARTIAL"), "SUCCESS").when(s.isin("FAILED", "UNSUPPORTED"), s).otherwise("UNMEASURED")
    reason = F.when(s.isin("SUCCESS", "PARTIAL"), "CROSS_DOMAIN_LINKED").when(s == "FAILED", "SOURCE_NOT_PARSED").when(s == "UNSUPPORTED", "SOURCE_LANGUAGE_UNSUPPORTED").otherwise("SOURCE_NOT_MEASURED")
    return files.filter(F.array_contains(owned_capabilities(F.col("language")), "X")).select("path", status.alias("status"), reason.alias("reason"))


def last_capability_outcome(outcomes: DataFrame) -> DataFrame:
    """The last outcome (by seq) of each path and capability."""
    return last_wins(outcomes, ["path", "capability"], "seq")


def _states(status: Column) -> list[Column]:
    s = F.coalesce(status, F.lit("UNMEASURED"))
    counts = [F.count_if(s == x) for x in STATES]
    return [reduce(lambda a, b: a + b, counts[:5]).alias("targeted"), *[c.alias("pending" if x == "TARGETED" else x.lower()) for c, x in zip(counts, STATES)]]


def capability_coverage(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """snapshot_id, capability, targeted and the number of files in each state, for every file and capability; P is parsing, from the file's own
    status. A missing outcome is unmeasured; targeted are the files in one of the five recorded states."""
    every = files.select("snapshot_id", "path", F.explode(F.array(*map(F.lit, CAPABILITIES))).alias("capability"))
    j = every.join(outcomes.select("path", "capability", F.col("status").alias("s")), ["path", "capability"], "left")
    parsed = files.select("snapshot_id", F.lit("P").alias("capability"), F.when(F.col("status") == "LEGACY_UNMEASURED", "UNMEASURED").otherwise(F.col("status")).alias("s"))
    both = j.select("snapshot_id", "capability", "s").unionByName(parsed)
    return both.groupBy("snapshot_id", "capability").agg(*_states(F.col("s")))


def outcome_summary(files: DataFrame, measurements: DataFrame) -> DataFrame:
    """snapshot_id, discovered_files, excluded_files, excluded_submodules and the files in each state, for every measured snapshot."""
    s = F.col("status")
    counts = files.groupBy("snapshot_id").agg(F.count_if("targeted").alias("targeted"), *[F.count_if(s.isin(*x)).alias(n) for n, x in (("successful", ["SUCCESS"]), ("partial", ["PARTIAL"]), ("failed", ["FAILED"]), ("unsupported", ["UNSUPPORTED"]), ("unmeasured", ["UNMEASURED", "LEGACY_UNMEASURED"]), ("pending", ["TARGETED"]))])
    m = measurements.select("snapshot_id", "discovered_files", (F.col("excluded_count") + F.col("excluded_size") + F.col("excluded_binary")).alias("excluded_files"), F.col("excluded_submodule").alias("excluded_submodules"))
    return m.join(counts, "snapshot_id", "left").fillna(0, [c for c in counts.columns if c != "snapshot_id"])


def language_coverage(files: DataFrame) -> DataFrame:
    """snapshot_id, language, files, successful, failed."""
    n = lambda x: F.count_if(F.col("status") == x)
    return files.groupBy("snapshot_id", F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"), n("SUCCESS").alias("successful"), n("FAILED").alias("failed"))


OUTSIDE = ("UNSUPPORTED", "FAILED", "PARTIAL", "TARGETED", "UNMEASURED")


def outside_areas(files: DataFrame, k: int = 20) -> DataFrame:
    """status, language, files, sample_path of what analysis does not cover, worst first, the first k groups."""
    g = files.filter(F.col("status").isin(*OUTSIDE)).groupBy("status", "language").agg(F.count("*").alias("files"), F.min("path").alias("sample_path"))
    return g.orderBy(F.array_position(F.array(*map(F.lit, OUTSIDE)), F.col("status")), F.desc("files"), F.asc_nulls_last("language")).limit(k)


def status_partition(outcomes: DataFrame, statuses: list[str], excluded: list[str]) -> DataFrame:
    """fixture, cell, a column for each status, total and eligible (all but the excluded)."""
    g = outcomes.groupBy("fixture", "cell").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses], F.count("*").alias("total"), F.count_if(~F.col("status").isin(*excluded)).alias("eligible"))
    return g


def analyzer_status(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """project_id, analyzer, status of each analyzer's last step in the newest job of a project."""
    newest = jobs.groupBy("project_id").agg(F.max("job_id").alias("job_id"))
    s = steps.join(newest, "job_id").groupBy("project_id", "analyzer").agg(F.max_by("status", "seq").alias("status"))
    return s
