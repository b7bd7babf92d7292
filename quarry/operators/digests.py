"""Digests of ordered tables, the same for every partitioning: a tree of hashes over ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import running_before
from quarry.sources.tables import staged

#: Rows or nodes under one node of the tree; levels of the trees of manifests and environments, whatever their size.
FAN, LEVELS = 256, 2
#: Sources whose content belongs to another analysis than that of Java.
FOREIGN = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".py")


def field(*columns: Column) -> Column:
    """Values as one text that no other values give: each with its length before it; null is told from empty."""
    return F.concat(*[F.when(c.isNull(), F.lit("-;")).otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"), F.lit(";"))) for c in columns])


def _in_stream(level: DataFrame, keys: list[str]) -> DataFrame:
    """keys, digest, n: the nodes (at, h) of each key hashed in their order into one; a node alone is kept. Sorted rows pass by one at a time, so that none are held."""
    kinds = ", ".join(f"`{k}` {level.schema[k].dataType.simpleString()}" for k in keys)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, only, whole, n = None, None, hashlib.sha256(), 0
        for b in batches:
            made = []
            for *key, h, size in b.itertuples(index=False):
                if key != now:
                    made += [] if now is None else [(*now, only or whole.hexdigest(), n)]
                    now, only, whole, n = key, h, hashlib.sha256(h.encode()), size
                else:
                    only = None
                    whole.update(f",{h}".encode())
            yield pd.DataFrame(made, columns=[*keys, "digest", "n"], dtype=object)
        if now is not None:
            yield pd.DataFrame([(*now, only or whole.hexdigest(), n)], columns=[*keys, "digest", "n"], dtype=object)

    return level.repartition(*keys).sortWithinPartitions(*keys, "at").select(*keys, "h", "n").mapInPandas(ends, f"{kinds}, digest string, n long")


def tree_digest(rows: DataFrame, keys: list[str], order: str, leaf: Column, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """keys, digest, n of the rows of each key in the order of a column (which tells them apart).

    A row's rank is a running count over ranges of the order; `fan` rows are hashed to a node, `fan` nodes to one above, and so on until each key has one
    node; a key that has it early keeps it. So no task holds more than `fan` hashes of a node, and the result does not depend on how the rows lie or on
    other keys. `levels` (two or more): the tree grows no higher, its last level hashes however many nodes are left of a key. It runs jobs while it is built."""
    level = rows.select(*keys, order, F.sha2(leaf, 256).alias("h"), F.lit(1).cast("long").alias("_one"))
    level = staged(running_before(level, keys, [order], "_one", "at").select(*keys, "at", "h"))
    n = staged(level.groupBy(*keys).agg(F.count("*").alias("n")))
    most, width = n.agg(F.max("n")).first()[0] or 0, F.col("n")
    level, first, height = level.join(n, keys), True, 0
    while True:
        node = level.groupBy(*keys, F.floor(F.col("at") / fan).alias("node")).agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("below"), F.max("n").alias("n"))
        whole = F.sha2(F.array_join(F.transform("below", lambda b: b["h"]), ","), 256)
        done = F.lit(False) if first else width <= 1
        level = node.select(*keys, F.col("node").alias("at"), F.when(done, F.get("below", F.lit(0))["h"]).otherwise(whole).alias("h"), "n")
        most, width, first, height = -(-most // fan), F.ceil(width / fan), False, height + 1
        if most <= 1:
            return level.select(*keys, F.col("h").alias("digest"), "n")
        if levels is not None and height >= levels - 1:
            return _in_stream(level, keys)
        level = staged(level)


def manifest_digest(files: DataFrame, policy: str = "", limits: str = "") -> DataFrame:
    """snapshot_id, digest, files, bytes of accepted files (snapshot_id, path, size, content_hash): their paths in order with sizes and contents, number and sum, and the
    policy and limits by which they were taken in."""
    out = tree_digest(files, ["snapshot_id"], "path", field(F.col("path"), F.lit("REGULAR_FILE"), F.col("size"), F.col("content_hash")), levels=LEVELS)
    out = out.join(files.groupBy("snapshot_id").agg(F.sum("size").alias("bytes")), "snapshot_id")
    return out.select("snapshot_id", F.sha2(field(F.lit(policy), F.lit(limits), F.col("digest"), F.col("n"), F.col("bytes")), 256).alias("digest"), F.col("n").alias("files"), "bytes")


def verify_seal(files: DataFrame, seals: DataFrame, policy: str = "", limits: str = "") -> DataFrame:
    """snapshot_id, verdict of each seal (snapshot_id, digest, files, bytes): VALID, CHANGED where number and sum still hold, COUNT where they do not, MISSING without files;
    UNSEALED for a snapshot without a seal."""
    now = manifest_digest(files, policy, limits).withColumnsRenamed({"digest": "is", "files": "n", "bytes": "b"})
    same = (F.col("n") == F.col("files")) & (F.col("b") == F.col("bytes"))
    verdict = F.when(F.col("digest").isNull(), "UNSEALED").when(F.col("is").isNull(), "MISSING").when(F.col("is") == F.col("digest"), "VALID").when(same, "CHANGED").otherwise("COUNT")
    return seals.join(now, "snapshot_id", "full").select("snapshot_id", verdict.alias("verdict"))


def environment_hash(files: DataFrame, by: str = "project_id") -> DataFrame:
    """project_id, complete, environment, java_complete of all files (project_id, path, directory, content_hash, inventoried): the digests over path order of everything, and
    of what one Java file's analysis can depend on: all names, and the contents of files that are neither inventoried Java nor of another language. A Java file
    that is not inventoried makes java_complete false."""
    java = F.lower("path").endswith(".java")
    foreign = F.lit(False)
    for end in FOREIGN:
        foreign = foreign | F.lower("path").endswith(end)
    kind = F.when(F.col("directory"), "directory").otherwise("file")
    content = F.when(~F.col("directory"), F.col("content_hash"))
    seen = F.when(~(java & F.col("inventoried")) & ~foreign, content)
    one = tree_digest(files, [by], "path", field(kind, F.col("path"), content), levels=LEVELS).select(by, F.col("digest").alias("complete"))
    two = tree_digest(files, [by], "path", field(kind, F.col("path"), seen), levels=LEVELS).select(by, F.col("digest").alias("environment"))
    full = files.groupBy(by).agg(F.bool_and(~(java & ~F.col("directory")) | F.col("inventoried")).alias("java_complete"))
    return one.join(two, by).join(full, by)
