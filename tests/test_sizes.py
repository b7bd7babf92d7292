"""What only shows beyond the sizes of the smallest tables."""

import hashlib

from pyspark.sql import functions as F

#: More rows than two full levels of a digest's tree hold.
MANY = 256 * 256 + 300


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def two_levels(leaves):
    nodes = [sha(",".join(sha(x) for x in leaves[i : i + 256])) for i in range(0, len(leaves), 256)]
    return nodes[0] if len(nodes) == 1 else sha(",".join(nodes))


def field(*values):
    return "".join("-;" if v is None else f"{len(str(v))}:{v};" for v in values)


def test_manifests_have_two_levels_whatever_their_size(spark):
    from quarry.operators import digests as G

    sizes = {1: MANY, 2: 256, 3: 257}
    df = spark.range(MANY).crossJoin(spark.createDataFrame([(k, n) for k, n in sizes.items()], "snapshot_id int, n int")).filter("id < n")
    df = df.select("snapshot_id", F.format_string("p%08d", "id").alias("path"), F.col("id").alias("size"), F.lit("h").alias("content_hash"))
    want = {}
    for k, n in sizes.items():
        top = two_levels([field(f"p{i:08d}", "REGULAR_FILE", i, "h") for i in range(n)])
        want[k] = (sha(field("p", "", top, n, n * (n - 1) // 2)), n)
    assert {r.snapshot_id: (r.digest, r.files) for r in G.manifest_digest(df, "p").collect()} == want


def test_environments_have_two_levels_whatever_their_size(spark):
    from quarry.operators import digests as G

    df = spark.range(MANY).select(F.lit(1).alias("project_id"), F.format_string("p%08d.txt", "id").alias("path"), F.lit(False).alias("directory"), F.col("id").cast("string").alias("content_hash"), F.lit(True).alias("inventoried"))
    top = two_levels([field("file", f"p{i:08d}.txt", i) for i in range(MANY)])
    assert [(r.complete, r.environment, r.java_complete) for r in G.environment_hash(df).collect()] == [(top, top, True)]
