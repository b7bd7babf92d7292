"""Identities of graph nodes, seeds of features, and what notes and evidence refer to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.sources.tables import staged

TYPES = ("CLASS", "INTERFACE", "ENUM", "ANNOTATION")


def blocked_keys(nodes: DataFrame) -> DataFrame:
    """natural_key of nodes (natural_key, node_type, path, line_start) whose identity is ambiguous: declared in several files,
    marked AMBIGUOUS, or a member of such a Java type. Packages and nodes without a file or line declare nothing."""
    declares = (F.col("node_type") != "PACKAGE") & F.col("path").isNotNull() & F.col("line_start").isNotNull()
    g = nodes.groupBy("natural_key").agg(
        F.count_distinct(F.when(declares, F.col("path"))).alias("files"),
        F.bool_or(F.col("node_type") == "AMBIGUOUS").alias("marked"),
        F.bool_or(F.col("node_type").isin(*TYPES)).alias("type"),
    )
    own = g.filter("files > 1 OR marked").select("natural_key", "type")
    types = own.filter(F.col("type") & F.startswith("natural_key", F.lit("java:"))).select(F.col("natural_key").alias("owner"))
    # A member's key goes on after its owner's with # or a dot, so each key names all its possible owners.
    key = F.col("natural_key")
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda i: F.substring(key, i, F.lit(1)).isin("#", "."))
    owners = g.select("natural_key", F.explode(F.transform(ends, lambda i: F.substring(key, F.lit(1), i - 1))).alias("owner"))
    return own.select("natural_key").unionByName(owners.join(types, "owner", "left_semi").select("natural_key")).distinct()


def guard_identities(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with ambiguous ones merged into one AMBIGUOUS row without a place, and the edges that touch none of them."""
    blocked = blocked_keys(nodes)
    merged = nodes.join(blocked, "natural_key", "left_semi").select("natural_key", F.lit("AMBIGUOUS").alias("node_type"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line_start")).distinct()
    clear = nodes.join(blocked, "natural_key", "left_anti").select("natural_key", "node_type", "path", F.col("line_start").cast("int").alias("line_start"))
    for end in ("source", "target"):
        edges = edges.join(blocked.withColumnRenamed("natural_key", end), end, "left_anti")
    return clear.unionByName(merged), edges


def drop_package_seeds(seeds: DataFrame) -> DataFrame:
    """(name, node) of seeds (name, endpoint, node): those that no endpoint backs go where any has one; same names are one seed."""
    some = seeds.filter("endpoint").head(1)
    return (seeds.filter("endpoint") if some else seeds).select("name", "node").distinct()


def resolve_note_refs(refs: DataFrame, files: DataFrame, nodes: DataFrame, commits: DataFrame, tasks: DataFrame, notes: DataFrame) -> DataFrame:
    """note, kind, target, subject of refs (note, kind, target): the least id that a reference means, else null.

    The other tables are (key, id): a file's path, a node's name (or what follows a # in it, in any case), the start of a commit's
    hash, a task's number, the title of another note. All kinds are one equi-join, of which the other side is first brought down to the keys that references
    have, and to the two least ids of each: the second is for a note that has its own title in mind. It runs jobs while it is built (references and their keys are written)."""
    lower = lambda c: F.lower(F.col(c))

    def as_keys(df: DataFrame, kind: str, key: Column) -> DataFrame:
        whole = F.col("key").cast("string") if kind == "COMMIT" else F.lit("")
        return df.select(F.lit(kind).alias("kind"), key.cast("string").alias("k"), whole.alias("whole"), F.col("id").cast("string").alias("id"))

    parts = F.split(lower("key"), "#")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "#"))
    known = [
        as_keys(files, "FILE", F.col("key")),
        as_keys(nodes, "NODE", F.col("key")),
        as_keys(nodes.filter(F.contains("key", F.lit("#"))).withColumn("tail", F.explode(tails)), "NODE", F.concat(F.lit("#"), F.col("tail"))),
        as_keys(commits, "COMMIT", F.substring(lower("key"), 1, 7)),
        as_keys(tasks, "TASK", F.col("key")),
        as_keys(notes, "NOTE", F.col("key")),
    ]
    wanted = F.when(F.col("kind") == "COMMIT", F.array(F.substring(lower("target"), 1, 7))).when(F.col("kind") == "NODE", F.array("target", F.concat(F.lit("#"), lower("target")))).otherwise(F.array("target"))
    r = staged(refs.select("note", "kind", "target").distinct())
    r_keys = r.withColumn("k", F.explode(wanted))
    table = reduce(DataFrame.unionByName, known).join(staged(r_keys.select("kind", "k").distinct()), ["kind", "k"], "left_semi").filter("id is not null").distinct()
    place = F.row_number().over(W.partitionBy("kind", "k", "whole").orderBy("id"))
    j = r_keys.join(table.withColumn("place", place).filter("place <= 2").drop("place"), ["kind", "k"])
    j = j.filter((F.col("kind") != "COMMIT") | F.startswith(lower("whole"), lower("target"))).filter((F.col("kind") != "NOTE") | (F.col("id") != F.col("note").cast("string")))
    return r.join(j.groupBy("note", "kind", "target").agg(F.min("id").alias("subject")), ["note", "kind", "target"], "left")


def evidence_of(subjects: DataFrame, links: DataFrame, evidences: DataFrame, subject_type: str) -> DataFrame:
    """subject_id and evidence columns of the subjects of one type."""
    mine = links.filter(F.col("subject_type") == subject_type).join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    return mine.select("subject_id", "evidence_id").join(evidences, "evidence_id")


def evidence_snapshots(links: DataFrame, subjects: DataFrame) -> DataFrame:
    """(evidence_id, snapshot_id): the snapshots of all subjects (subject_type, subject_id, snapshot_id) that an evidence supports."""
    return links.join(subjects, ["subject_type", "subject_id"]).select("evidence_id", "snapshot_id").distinct()
