"""Differences between snapshots, fact sets and inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_changes(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """path, change (ADDED, REMOVED, CHANGED) of two tables (path, content_hash), in one shuffle."""
    both = current.select("path", F.col("content_hash").alias("new"), F.lit(None).cast("string").alias("old")).unionByName(snapshot.select("path", F.lit(None).cast("string").alias("new"), F.col("content_hash").alias("old")))
    g = both.groupBy("path").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("new") != F.col("old"), "CHANGED")
    return g.select("path", change.alias("change")).filter("change is not null")


def verify_facts(expected: DataFrame, actual: DataFrame, allowed: DataFrame) -> DataFrame:
    """key, problem, want, got of two tables (key, value): MISSING, UNEXPECTED, CHANGED, and beside these DUPLICATE_EXPECTED and DUPLICATE_ACTUAL for a key
    that a side has more than once (its least value then counts).

    An actual fact is passed over only if exactly it, key and value, is in `allowed`. A key that is both expected and allowed is an error: that check
    runs a job while the result is built."""
    clash = allowed.join(expected.select("key"), "key", "left_semi").head(1)
    if clash:
        raise ValueError(f"expected and allowed: {clash[0].key}")
    side = lambda df, value, n: df.groupBy("key").agg(F.min("value").alias(value), F.count("*").alias(n))
    got = side(actual, "got", "n_got").withColumn("ok", F.lit(True))
    passed = allowed.select("key", F.col("value").alias("got")).distinct().withColumn("passed", F.lit(True))
    got = got.join(passed, ["key", "got"], "left").withColumn("ok", F.col("passed").isNull()).drop("passed")
    j = side(expected, "want", "n_want").join(got, "key", "full")
    has = F.coalesce("ok", F.lit(False))
    differs = F.when(F.col("n_want").isNotNull() & ~has, "MISSING").when(F.col("n_want").isNull() & has, "UNEXPECTED").when(F.col("n_want").isNotNull() & (F.col("want") != F.col("got")), "CHANGED")
    problems = F.array_compact(F.array(differs, F.when(F.col("n_want") > 1, "DUPLICATE_EXPECTED"), F.when(F.col("n_got") > 1, "DUPLICATE_ACTUAL")))
    return j.select("key", F.explode(problems).alias("problem"), "want", F.when(has, F.col("got")).alias("got"))


def split_unchanged(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reuse, reanalyse): files (path, content_hash, context_hash) whose stored result has the same hashes, and the others."""
    key = ["path", "content_hash", "context_hash"]
    known = cached.select(*key).distinct()
    return files.join(known, key, "left_semi"), files.join(known, key, "left_anti")


def block_id(kind: Column, content: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(content, 256), 1, 12))


def exclude_blocks(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """Blocks (kind, content) without those whose id is listed. An id that no block has is an error."""
    b = blocks.withColumn("block_id", block_id(F.col("kind"), F.col("content")))
    unknown = ids.select("block_id").join(b.select("block_id"), "block_id", "left_anti").head(1)
    if unknown:
        raise ValueError(f"unknown block {unknown[0].block_id}")
    return b.join(ids.select("block_id").distinct(), "block_id", "left_anti")


def _canonical(metadata: Column) -> Column:
    """JSON with its keys in order."""
    entries = F.map_entries(F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>")))
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def node_fingerprints(nodes: DataFrame) -> DataFrame:
    """category, key, fingerprint of nodes: what two snapshots are compared by."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return nodes.select(F.lit("NODE").alias("category"), F.col("natural_key").alias("key"), F.concat_ws("|", "node_type", "name", text("path"), text("line_start"), text("area_type"), _canonical(F.col("metadata"))).alias("fingerprint"))


def edge_fingerprints(edges: DataFrame) -> DataFrame:
    return edges.select(F.lit("EDGE").alias("category"), F.concat_ws("|", "source", "edge_type", "target").alias("key"), F.col("confidence").alias("fingerprint"))


def flow_fingerprints(steps: DataFrame) -> DataFrame:
    """Of flows (kind, name, seq, node, description): their steps in order, in one digest. A flow has at most some dozens."""
    line = F.concat(F.col("seq").cast("string"), F.lit(":"), F.coalesce("node", F.lit("")), F.lit(":"), F.coalesce("description", F.lit("")))
    g = steps.groupBy("kind", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda s: s["l"]), ",").alias("s"))
    return g.select(F.lit("FLOW").alias("category"), F.concat("kind", F.lit(":"), "name").alias("key"), F.sha2(F.concat_ws("|", "kind", "s"), 256).alias("fingerprint"))


def feature_fingerprints(features: DataFrame, links: DataFrame) -> DataFrame:
    """category, key, fingerprint, members of features (name, detection): their links (name, role, node) in order, hashed one by one, so that
    a feature of many members stays small."""
    each = links.select("name", F.sha2(F.concat("role", F.lit(":"), "node"), 256).alias("h"), F.sha2("node", 256).alias("m"))
    g = each.groupBy("name").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("f"), F.sha2(F.array_join(F.array_sort(F.collect_list("m")), ","), 256).alias("members"))
    j = features.join(g, "name", "left")
    return j.select(F.lit("FEATURE").alias("category"), F.col("name").alias("key"), F.concat_ws("|", "detection", F.coalesce("f", F.lit(""))).alias("fingerprint"), F.coalesce("members", F.lit("")).alias("members"))
