"""Typed graphs as two tables: nodes (natural_key, ...) and edges (source, target, edge_type, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.sources.tables import staged


def rank(confidence: Column) -> Column:
    return F.when(confidence == "CONFIRMED", 3).when(confidence == "LIKELY", 2).otherwise(1)


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of the highest sequence number of each key; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def merge_nodes(drafts: DataFrame) -> DataFrame:
    """Drafts (natural_key, seq, node_type, name, path) of one node merged: the last type and name, the last known path.

    A node declared in several files is AMBIGUOUS and has no path."""
    return (
        drafts.groupBy("natural_key")
        .agg(
            F.max_by("node_type", "seq").alias("node_type"),
            F.max_by("name", "seq").alias("name"),
            F.max_by("path", F.when(F.col("path").isNotNull(), F.col("seq"))).alias("path"),
            F.count_distinct("path").alias("files"),
        )
        .select("natural_key", F.when(F.col("files") > 1, "AMBIGUOUS").otherwise(F.col("node_type")).alias("node_type"), "name", F.when(F.col("files") <= 1, F.col("path")).alias("path"))
    )


def merge_edges(nodes: DataFrame, drafts: DataFrame) -> DataFrame:
    """Edge drafts (source, target, edge_type, seq, confidence) with both ends known, no loops, the last of each kept."""
    keys = nodes.select("natural_key")
    e = drafts.filter("source <> target").join(keys.withColumnRenamed("natural_key", "source"), "source", "left_semi")
    e = e.join(keys.withColumnRenamed("natural_key", "target"), "target", "left_semi")
    return last_wins(e, ["source", "target", "edge_type"], "seq").select("source", "target", "edge_type", "confidence")


def impact(edges: DataFrame, starts: DataFrame, depth: int = 5, count_paths: bool = True) -> DataFrame:
    """All simple paths that lead to each start (column `start`), up to `depth` edges, summed per dependent node:
    least depth, number of paths, the strongest path's weakest confidence, and the first edge type by (depth, type). Only a confirmed path
    makes a confirmed dependency.

    Counting paths is exponential in dense graphs; without the count a level keeps one row for each node, its strongest path. With it, paths over the same nodes
    (in another order, or by parallel edges) are one row with their number. A level feeds the next and the result, so it is written: jobs run while the result is
    built."""
    e = edges.select("source", "target", "edge_type", rank(F.col("confidence")).alias("strength"))
    level = starts.select("start", F.col("start").alias("node"), F.array("start").alias("seen"), F.lit(3).alias("weakest"), F.lit(1).cast("long").alias("n"))
    out = None
    for d in range(1, depth + 1):
        fresh = ~F.array_contains("seen", F.col("source")) if count_paths else F.col("source") != F.col("start")
        level = level.join(e, level["node"] == e["target"]).filter(fresh)
        seen = F.array_sort(F.concat("seen", F.array("source"))) if count_paths else F.lit(None).cast("array<string>")
        level = level.select("start", F.col("source").alias("node"), seen.alias("seen"), F.least("weakest", "strength").alias("weakest"), "edge_type", "n")
        if d < depth:
            level = staged(level.groupBy("start", "node", "seen").agg(F.max("weakest").alias("weakest"), F.min("edge_type").alias("edge_type"), F.sum("n").alias("n")))
        part = level.groupBy("start", "node").agg(F.lit(d).alias("depth"), F.sum("n").alias("paths"), F.max("weakest").alias("weakest"), F.min("edge_type").alias("edge_type"))
        out = part if out is None else out.unionByName(part)
        level = level.drop("edge_type")
    paths = F.sum("paths") if count_paths else F.lit(None).cast("long")
    best = out.groupBy("start", "node").agg(F.min("depth").alias("min_depth"), paths.alias("path_count"), F.max("weakest").alias("strength"), F.min_by("edge_type", F.struct("depth", "edge_type")).alias("first_edge_type"))
    group = F.when(F.col("strength") == 3, "CONFIRMED_DEPENDENCY").otherwise("CANDIDATE_IMPACT")
    return best.select("start", "node", "min_depth", "path_count", "strength", "first_edge_type", group.alias("impact_group"))


#: Weights of dependents by node type (others 1), and least scores of the levels.
RISK_WEIGHTS = {"API_ENDPOINT": 4, "FE_ROUTE": 4, "COMPONENT": 2, "CLASS": 2}
RISK_LEVELS = (("HIGH", 20), ("MEDIUM", 8))


def risk_score(dependents: DataFrame, nodes: DataFrame) -> DataFrame:
    """start, score, level: the summed weights of all dependents (start, node) of a start."""
    weight = F.lit(1)
    for t, w in RISK_WEIGHTS.items():
        weight = F.when(F.upper("node_type") == t, w).otherwise(weight)
    s = dependents.join(nodes.select(F.col("natural_key").alias("node"), "node_type"), "node").groupBy("start").agg(F.sum(weight).alias("score"))
    level = F.when(F.col("score") >= RISK_LEVELS[0][1], RISK_LEVELS[0][0]).when(F.col("score") >= RISK_LEVELS[1][1], RISK_LEVELS[1][0]).otherwise("LOW")
    return s.withColumn("level", level)


def neighbourhood(nodes: DataFrame, edges: DataFrame, start: str, direction: str = "out", edge_type: str | None = None, depth: int = 1, cap: int = 500) -> DataFrame:
    """Edges one or two steps from start (depth, source, target, edge_type, confidence, node, truncated), none that touches an ambiguous node;
    the second step never comes back to start. The first `cap` of them in the order of hop, node, source, target, type; `truncated` tells
    whether there are more. Hop by hop, one edge more than the cap is read."""
    ahead, behind = ("source", "target") if direction == "out" else ("target", "source")
    ok = nodes.filter("node_type <> 'AMBIGUOUS'").select("natural_key")
    e = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    for end in ("source", "target"):
        e = e.join(ok.withColumnRenamed("natural_key", end), end, "left_semi")
    e = e.select("source", "target", "edge_type", "confidence")
    order = ["source", "target", "edge_type"]
    walk = one = e.filter(F.col(ahead) == start).orderBy(*order).limit(cap + 1).withColumn("depth", F.lit(1))
    if depth == 2:
        reached = one.select(F.col(behind).alias(ahead)).distinct()
        two = e.filter(F.col(behind) != start).join(reached, ahead, "left_semi").distinct().orderBy(*order).limit(cap + 1)
        walk = one.unionByName(two.withColumn("depth", F.lit(2)))
    walk = walk.withColumn("node", F.col(behind)).orderBy("depth", "node", *order).limit(cap + 1)
    # At most cap + 1 rows are left to number.
    walk = walk.withColumn("place", F.row_number().over(W.orderBy("depth", "node", *order))).withColumn("truncated", F.count("*").over(W.partitionBy(F.lit(1))) > cap)
    return walk.filter(F.col("place") <= cap).drop("place")


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of node types and edge types; ambiguous nodes and their edges do not count."""
    ok = nodes.filter("node_type <> 'AMBIGUOUS'")
    keys = ok.select("natural_key")
    e = edges.join(keys.withColumnRenamed("natural_key", "source"), "source", "left_semi").join(keys.withColumnRenamed("natural_key", "target"), "target", "left_semi")
    count = lambda df, kind, c: df.groupBy(F.col(c).alias("type")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(ok, "node", "node_type").unionByName(count(e, "edge", "edge_type"))


def without_edge(nodes: DataFrame, edges: DataFrame, node_type: str, edge_type: str) -> DataFrame:
    """Nodes of a type that no edge of a type leaves."""
    return nodes.filter(F.col("node_type") == node_type).join(edges.filter(F.col("edge_type") == edge_type).select(F.col("source").alias("natural_key")), "natural_key", "left_anti")


def orphan_routes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes that no CONTAINS edge leads to a component from."""
    components = nodes.filter("node_type = 'COMPONENT'").select(F.col("natural_key").alias("target"))
    held = edges.filter("edge_type = 'CONTAINS'").join(components, "target", "left_semi").select(F.col("source").alias("natural_key"))
    return nodes.filter("node_type = 'FE_ROUTE'").join(held, "natural_key", "left_anti")


def directory_tree(files: DataFrame) -> DataFrame:
    """(parent, child) of every directory and file below the root `.`."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.when(i == 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(i - 1, F.lit(1))), "/")).alias("parent"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("child")))
    return files.select(F.explode(steps).alias("s")).select("s.parent", "s.child").distinct()


def link_calls(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """The best endpoint of each call (caller, method, path): exact path (3), equal up to templates (2), or one a suffix of the
    other (1), of the URLs' paths; methods agree in any case, an endpoint's ANY with all; ties go to the first key. Three equi-joins in place of
    calls times endpoints."""
    from quarry.functions.text import normalize_template, url_path

    def suffixes(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(2), F.greatest(F.length(p), F.lit(2))), lambda i: F.substring(p, i, F.length(p)))

    def tails(p: Column) -> Column:  # those that begin with a slash, as every path does
        return F.filter(suffixes(p), lambda s: F.startswith(s, F.lit("/")) & (s != "/"))

    c = calls.select("caller", "method", "path").distinct().select("*", F.upper(F.trim("method")).alias("m"), url_path(F.col("path")).alias("p")).withColumn("norm", normalize_template(F.col("p")))
    e = endpoints.select("endpoint", F.upper(F.trim("method")).alias("em"), url_path(F.col("path")).alias("ep")).withColumn("en", normalize_template(F.col("ep")))
    fits = (F.col("em") == "ANY") | (F.col("m") == F.col("em"))
    out = ["caller", "method", "path", "endpoint"]
    exact = c.join(e, (F.col("p") == F.col("ep")) & fits).select(*out, F.lit(3).alias("grade"))
    norm = c.join(e, (F.col("norm") == F.col("en")) & fits).select(*out, F.lit(2).alias("grade"))
    some = (F.col("norm") != F.col("en")) & (F.col("norm") != "/") & (F.col("en") != "/")
    long_call = c.withColumn("k", F.explode(tails(F.col("norm")))).join(e, (F.col("k") == F.col("en")) & fits & some).select(*out, F.lit(1).alias("grade"))
    long_end = e.withColumn("k", F.explode(tails(F.col("en")))).join(c, (F.col("k") == F.col("norm")) & fits & some).select(*out, F.lit(1).alias("grade"))
    every = exact.unionByName(norm).unionByName(long_call).unionByName(long_end)
    return every.groupBy("caller", "method", "path").agg(F.min_by(F.struct("endpoint", "grade"), F.struct(-F.col("grade"), "endpoint")).alias("b")).select("caller", "method", "path", "b.endpoint", "b.grade")
