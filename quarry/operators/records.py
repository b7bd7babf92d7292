"""Operators over evidence, judgments, summaries, candidates, commits and annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.graph import last_wins
from quarry.operators.ordered import running_before

#: The forms of references in notes, by the kind of their subject.
NOTE_REFS = {
    "FILE": r"@file(?::|\s+)(\S+)",
    "NODE": r"@class(?:#|:|\s+)([A-Za-z0-9_#]+)",
    "COMMIT": r"@commit(?::|\s+)([a-fA-F0-9]{7,40})",
    "TASK": r"@task(?::|\s+)([0-9]+)",
    "NOTE": r"\[\[([^\]]+)\]\]",
}


def note_refs(text: Column) -> Column:
    """Array of (kind, target) of the references in a text, blank targets left out; null text has none."""

    def of(kind: str) -> Column:
        targets = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NOTE_REFS[kind]), F.lit(1))
        return F.transform(targets, lambda t: F.struct(F.lit(kind).alias("kind"), F.trim(t).alias("target")))

    found = [of(kind) for kind in NOTE_REFS]
    return F.filter(F.concat(*found), lambda r: r["target"] != "")


def link_maps_to(entities: DataFrame, tables: DataFrame) -> DataFrame:
    """entity, target, how: the table of the same name in any case (of several, the last key), else of the same key."""
    by_name = tables.groupBy(F.lower("name").alias("k")).agg(F.max("table_key").alias("by_name"))
    by_key = tables.select(F.col("table_key").alias("by_key")).distinct()
    j = entities.join(by_name, F.lower(entities["name"]) == F.col("k"), "left").join(by_key, entities["table_key"] == F.col("by_key"), "left")
    how = F.when(F.col("by_name").isNotNull(), "NAME").otherwise("KEY")
    return j.select("entity", F.coalesce("by_name", "by_key").alias("target"), how.alias("how")).filter("target is not null")


def link_reads_writes(repos: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo, table_name) where the repository's stem is an entity's simple name or its name contains the table's.

    Containment is an equi-join on the substrings of the repository's name that have the length of some table name; an
    empty table name matches nothing."""
    name, simple = F.lower("name"), F.lower(F.element_at(F.split("entity", r"\."), -1))
    stems = repos.select("repo", F.lower(F.regexp_replace("name", "Repository$", "")).alias("k"))
    by_stem = stems.join(entities.select(simple.alias("k"), "table_name"), "k").select("repo", "table_name")
    tables = entities.select("table_name", F.lower("table_name").alias("k"), F.length("table_name").alias("n")).filter("n > 0").distinct()
    cut = repos.join(F.broadcast(tables.select("n").distinct()), F.length("name") >= F.col("n"))
    parts = cut.select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - F.col("n") + 1), lambda i: F.substring(name, i, F.col("n")))).alias("k")).distinct()
    return by_stem.unionByName(parts.join(tables, "k").select("repo", "table_name")).distinct()


def call_candidates(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """call, method, outcome: every method of an unresolved call's name is POSSIBLE; without one, EXTERNAL_TARGET."""
    outcome = F.when(F.col("method").isNull(), "EXTERNAL_TARGET").otherwise("POSSIBLE")
    return calls.join(methods, "name", "left").select("call", "method", outcome.alias("outcome"))


def validate_claims(claims: DataFrame, files: DataFrame, commits: DataFrame, pulls: DataFrame) -> DataFrame:
    """claim, kept, confidence from (claim, confidence, ref): references that exist, sorted; without any, confidence is UNKNOWN.

    `file:path:line` needs the file, and the line where its count is known; `commit:sha` a commit that begins so; `pr:n` its number.
    Commits join on their first seven digits."""
    ref = F.trim("ref")
    got = lambda p, i: F.nullif(F.regexp_extract(ref, p, i), F.lit(""))
    c = claims.select("claim", ref.alias("ref"), got("^file:([^:]+):([0-9]+)$", 1).alias("path"), got("^file:([^:]+):([0-9]+)$", 2).cast("decimal(38,0)").alias("line"), F.lower(got("^commit:([a-fA-F0-9]{7,40})$", 1)).alias("prefix"), got("^pr:([0-9]+)$", 1).cast("decimal(38,0)").alias("pr"))
    f, s, n = files.select(F.col("path").alias("f_path"), "line_count"), commits.select(F.lower("sha").alias("sha")), pulls.select("number")
    good = [
        c.join(f, (F.col("path") == F.col("f_path")) & (F.col("line_count").isNull() | (F.col("line_count") >= F.col("line"))), "left_semi"),
        c.join(s, (F.substring("prefix", 1, 7) == F.substring("sha", 1, 7)) & F.startswith("sha", "prefix"), "left_semi"),
        c.join(n, F.col("pr") == F.col("number"), "left_semi"),
    ]
    kept = reduce(DataFrame.unionByName, good).groupBy("claim").agg(F.array_join(F.array_sort(F.collect_list("ref")), ",").alias("kept"))
    j = claims.groupBy("claim").agg(F.max(F.upper("confidence")).alias("c")).join(kept, "claim", "left")
    return j.select("claim", F.coalesce("kept", F.lit("")).alias("kept"), F.when(F.col("kept").isNull(), "UNKNOWN").otherwise(F.coalesce("c", F.lit("UNKNOWN"))).alias("confidence"))


def overlay_judgments(findings: DataFrame, judgments: DataFrame, include_hidden: bool = False) -> DataFrame:
    """stable_key, status, hidden: a finding's stored judgment unless its rule version or evidence has changed since; then, or
    without one, NEEDS_REVIEW. False positives are hidden."""
    j = judgments.select("stable_key", F.col("status").alias("stored"), F.col("rule_version").alias("v"), F.col("fingerprint").alias("fp"))
    fresh = F.col("rule_version").eqNullSafe(F.col("v")) & F.col("fingerprint").eqNullSafe(F.col("fp"))
    out = findings.join(j, "stable_key", "left").select("stable_key", F.when(fresh & F.col("stored").isNotNull(), F.col("stored")).otherwise("NEEDS_REVIEW").alias("status"))
    out = out.withColumn("hidden", F.col("status") == "FALSE_POSITIVE")
    return out if include_hidden else out.filter("not hidden")


def valid_summaries(files: DataFrame, summaries: DataFrame, strict: bool = False) -> DataFrame:
    """file, content of summaries whose hash is the file's, or unknown unless `strict`."""
    j = files.join(summaries.withColumnRenamed("content_hash", "of"), "file")
    same = F.col("of") == F.col("content_hash")
    return j.filter(same if strict else same | F.col("of").isNull()).select("file", "content")


def merge_commits(existing: DataFrame, incoming: DataFrame, max_commits: int = 10_000) -> DataFrame:
    """project_id, sha, committed_at, message: incoming rows replace those of their key; the newest `max_commits` of a project
    are kept, and `omitted` counts the others. Ranks are running counts over ranges of the order, so no task holds a project."""
    both = existing.withColumn("load", F.lit(0)).unionByName(incoming.withColumn("load", F.lit(1)))
    one = last_wins(both, ["project_id", "sha"], "load").select("project_id", "sha", "committed_at", "message")
    one = one.withColumns({"_none": F.col("committed_at").isNull(), "_back": -F.unix_micros(F.col("committed_at").cast("timestamp")), "_one": F.lit(1).cast("long")})
    ranked = running_before(one, ["project_id"], ["_none", "_back", "sha"], "_one", "_before")
    n = one.groupBy("project_id").agg(F.greatest(F.count("*") - max_commits, F.lit(0)).alias("omitted"))
    return ranked.filter(F.col("_before") < max_commits).join(n, "project_id").select("project_id", "sha", "committed_at", "message", "omitted")


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """The children of the incoming parents are those in `new`, also where these are none; other parents keep theirs. Children without a parent in
    `parents` (keys, incoming) are gone with it."""
    p = parents.select(*keys, "incoming").groupBy(*keys).agg(F.max("incoming").alias("incoming"))
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    return both.join(p, keys).filter(F.col("_new") == F.col("incoming")).select(*old.columns).distinct()


def replace_history(commits: DataFrame, files: DataFrame, refs: DataFrame, new_commits: DataFrame, new_files: DataFrame, new_refs: DataFrame, scanned: DataFrame, max_commits: int = 10_000) -> DataFrame:
    """kind (COMMIT, FILE, BRANCH, TAG), project_id, key, child, detail: a project's history after a scan, in one table, so that one write replaces it whole.

    Commits (project_id, sha, committed_at, message) are replaced by key and capped; the files (project_id, sha, path, change_type) of a scanned commit are replaced as
    a whole; the refs (project_id, kind, name, head_sha) of a scanned project (project_id) too. What belongs to a commit that is not kept goes with it."""
    kept = merge_commits(commits, new_commits, max_commits)
    fresh = new_commits.select("project_id", "sha").distinct().withColumn("incoming", F.lit(True))
    parents = kept.select("project_id", "sha", "message").join(fresh, ["project_id", "sha"], "left").withColumn("incoming", F.coalesce("incoming", F.lit(False)))
    own = replace_children(files, new_files, parents, ["project_id", "sha"])
    refs = refs.join(scanned.select("project_id").distinct(), "project_id", "left_anti").unionByName(new_refs.join(scanned.select("project_id").distinct(), "project_id", "left_semi"))
    none = F.lit(None).cast("string")
    out = parents.select(F.lit("COMMIT").alias("kind"), "project_id", F.col("sha").alias("key"), none.alias("child"), F.col("message").alias("detail"))
    out = out.unionByName(own.select(F.lit("FILE").alias("kind"), "project_id", F.col("sha").alias("key"), F.col("path").alias("child"), F.col("change_type").alias("detail")))
    return out.unionByName(refs.select("kind", "project_id", F.col("name").alias("key"), none.alias("child"), F.col("head_sha").alias("detail")))


def merge_pulls(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pull requests by (project_id, number): an incoming row replaces the stored one whole, other rows stay."""
    both = existing.withColumn("_load", F.lit(0)).unionByName(incoming.withColumn("_load", F.lit(1)))
    return last_wins(both, ["project_id", "number"], "_load").select(*existing.columns)


def replace_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """The evidence of the subjects in `new` is replaced as a whole; that of other subjects stays."""
    return old.join(new.select("subject").distinct(), "subject", "left_anti").unionByName(new)


def annotator_differences(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """case, kind, fields: cases in one set only, and those whose fields differ (in the given order)."""
    x = a.select("case", F.struct(*fields).alias("a"))
    j = x.join(b.select("case", F.struct(*fields).alias("b")), "case", "full")
    unequal = F.concat_ws(",", *[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields])
    kind = F.when(F.col("b").isNull(), "ONLY_A").when(F.col("a").isNull(), "ONLY_B").when(unequal != "", "DIFFERENT").otherwise("AGREED")
    return j.select("case", kind.alias("kind"), F.when(kind == "DIFFERENT", unequal).alias("fields"))


def annotator_agreement(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """agreed, cases, agreement; null without cases."""
    d = annotator_differences(a, b, fields).agg(F.count_if(F.col("kind") == "AGREED").alias("agreed"), F.count("*").alias("cases"))
    return d.withColumn("agreement", F.col("agreed") / F.nullif(F.col("cases"), F.lit(0)))


def compare_dumps(left: DataFrame, right: DataFrame) -> DataFrame:
    """only_left, only_right, equal: rows of either side, with repeats, that the other lacks; one shuffle that combines first."""
    cols = sorted(left.columns)
    both = left.select(*cols, F.lit(1).alias("_n")).unionByName(right.select(*cols, F.lit(-1).alias("_n")))
    d = both.groupBy(*cols).agg(F.sum("_n").alias("d")).agg(*[F.coalesce(F.sum(F.greatest(F.col("d") * s, F.lit(0))), F.lit(0)).alias(n) for s, n in ((1, "only_left"), (-1, "only_right"))])
    return d.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
