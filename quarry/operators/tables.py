"""Operators over files, snapshots, commits, samples, usage and gold data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.ordered import running_before


def build_manifest(files: DataFrame) -> DataFrame:
    """project, content_hash, size, copies: a row for each different content of a project."""
    return files.groupBy("project", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash")).agg(F.max("size").alias("size"), F.count("*").alias("copies"))


def diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """category, key, change of two fingerprint tables (category, key, fingerprint), in one shuffle."""
    both = base.withColumn("b", F.lit(True)).unionByName(target.withColumn("b", F.lit(False)))
    g = both.groupBy("category", "key").agg(F.max(F.when(F.col("b"), F.col("fingerprint"))).alias("old"), F.max(F.when(~F.col("b"), F.col("fingerprint"))).alias("new"))
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old") != F.col("new"), "CHANGED")
    return g.select("category", "key", change.alias("change")).filter("change is not null")


def renames(base: DataFrame, target: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """(category, old_key, new_key): removed and added keys of a category with one fingerprint, the members' for features. A blank one is none."""
    known = F.trim(fingerprint) != ""
    side = lambda a, b, key: a.filter(known).join(b, ["category", "key"], "left_anti").select("category", F.col(fingerprint).alias("f"), F.col("key").alias(key))
    return side(base, target, "old_key").join(side(target, base, "new_key"), ["category", "f"]).select("category", "old_key", "new_key")


def first_by(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key, numbered in `rank`."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def histogram(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.coalesce(col, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def area_scores(signals: DataFrame, threshold: float = 0.5) -> DataFrame:
    """area, score (sum of weights, at most 1, four decimals), technologies, selected."""
    s = signals.groupBy("area").agg(F.least(F.lit(1.0), F.round(F.sum("weight"), 4)).alias("score"), F.array_join(F.array_sort(F.collect_set("technology")), ",").alias("technologies"))
    return s.withColumn("selected", F.col("score") >= threshold)


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """keys, p (the value at rank ceil(share * n)), worst, n; a null value is a failed sample and counts as infinite.

    Equal values are counted first; the ranks are running sums over ranges of values, so no task holds all of a key."""
    v = df.select(*keys, F.coalesce(F.col(value), F.lit(float("inf"))).alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("c"))
    n = v.groupBy(*keys).agg(F.sum("c").alias("n"), F.max("v").alias("worst"))
    r = running_before(v, keys, ["v"], "c", "before").join(n, keys)
    at = F.when(F.col("before") + F.col("c") >= F.ceil(F.lit(share) * F.col("n")), F.col("v"))
    return r.groupBy(*keys).agg(F.min(at).alias("p"), F.max("worst").alias("worst"), F.max("n").alias("n"))


def slo_verdict(samples: DataFrame, limits: DataFrame) -> DataFrame:
    """key, p, worst, n, verdict of samples (key, value): PASS if the 95th percentile is within the key's limit, UNMEASURED without samples."""
    r = limits.join(nearest_rank(samples, ["key"], "value"), "key", "left")
    return r.select("key", "p", "worst", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "UNMEASURED").when(F.col("p") <= F.col("limit"), "PASS").otherwise("FAIL").alias("verdict"))


def sampling_gaps(samples: DataFrame, max_gap_ms: int) -> DataFrame:
    """run, n, largest gap between samples in ms, peak, complete."""
    gap = F.col("t_ms") - F.lag("t_ms").over(W.partitionBy("run").orderBy("t_ms", "seq"))
    g = samples.withColumn("gap", gap).groupBy("run").agg(F.count("*").alias("n"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"), F.max("value").alias("peak"))
    return g.withColumn("complete", F.col("max_gap") <= max_gap_ms)


def daily_usage(usage: DataFrame, limit: int) -> DataFrame:
    d = usage.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("tokens").alias("tokens"))
    return d.withColumn("over_limit", F.col("tokens") > limit)


def ledger(requests: DataFrame) -> DataFrame:
    """Liability per installation and month: the actual cost of settled requests, of others the highest of floor, reserved and actual."""
    cost = F.when(F.col("status") == "SETTLED", F.col("actual")).otherwise(F.greatest("floor", "reserved", F.coalesce("actual", F.lit(0))))
    held = F.when(F.col("status") != "SETTLED", cost).otherwise(0)
    return requests.groupBy("installation", F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum(cost).alias("liability"), F.sum(held).alias("held"), F.count_if(F.col("status").isin("RESERVED", "DISPATCHED")).alias("open_requests"))


def admit_reservation(requests: DataFrame, gates: DataFrame, new: DataFrame) -> DataFrame:
    """installation, decision of new reservations (installation, day, micro_usd) against gates (installation, day_limit, month_limit): DENIED with two
    requests open, any conflict, a zero limit, or if what is held, new and settled would pass the limit of the day or the month; else ADMITTED."""
    settled = F.col("status") == "SETTLED"
    cost = F.when(settled, F.col("actual")).otherwise(F.greatest("floor", "reserved", F.coalesce("actual", F.lit(0))))
    r = new.join(gates, "installation", "left").join(requests.select("installation", F.col("day").alias("on"), "conflict", F.col("status").isin("RESERVED", "DISPATCHED").alias("open"), settled.alias("settled"), cost.alias("cost")), "installation", "left")
    held = F.coalesce(F.sum(F.when(~F.col("settled"), F.col("cost"))), F.lit(0))
    within = lambda same: F.coalesce(F.sum(F.when(F.col("settled") & same, F.col("cost"))), F.lit(0))
    g = r.groupBy("installation", "day", "micro_usd", "day_limit", "month_limit").agg(
        F.count_if("open").alias("open"), F.coalesce(F.bool_or("conflict"), F.lit(False)).alias("conflict"), held.alias("held"),
        within(F.col("on") == F.col("day")).alias("today"), within(F.trunc("on", "month") == F.trunc("day", "month")).alias("month"),
    )
    limit = lambda c: F.coalesce(F.col(c), F.lit(0))
    full = (F.col("held") + F.col("micro_usd") + F.col("today") > limit("day_limit")) | (F.col("held") + F.col("micro_usd") + F.col("month") > limit("month_limit"))
    denied = (F.col("open") >= 2) | F.col("conflict") | (limit("day_limit") == 0) | (limit("month_limit") == 0) | full
    return g.select("installation", F.when(denied, "DENIED").otherwise("ADMITTED").alias("decision"))


def accuracy(gold: DataFrame, observed: DataFrame) -> DataFrame:
    """cell, tp, fp, fn, precision, recall of two tables (cell, case, target); no cases give null, not zero."""
    g, o = gold.distinct().withColumn("g", F.lit(1)), observed.distinct().withColumn("o", F.lit(1))
    both = g.unionByName(o, allowMissingColumns=True).groupBy("cell", "case", "target").agg(F.max("g").alias("g"), F.max("o").alias("o"))
    c = both.groupBy("cell").agg(F.count_if(F.col("g").isNotNull() & F.col("o").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("o").isNull()).alias("fn"))
    return c.withColumn("precision", F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).withColumn("recall", F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)))


def regressions(a: DataFrame, b: DataFrame, drop: float = 0.3, least: int = 3) -> DataFrame:
    """Keys (key, n) whose count fell by more than `drop` where it was `least` or more."""
    j = a.select("key", F.col("n").alias("base")).join(b.select("key", F.col("n").alias("now")), "key", "left").withColumn("now", F.coalesce("now", F.lit(0)))
    return j.filter((F.col("base") >= least) & (F.col("now") < F.col("base") * (1 - drop)))


def evidence_fingerprint(evidence: DataFrame) -> DataFrame:
    """subject, SHA-256 over its evidence lines `path|start|end|excerpt`, ordered, each ended by a line feed."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    line = F.concat(text("path"), F.lit("|"), text("line_start"), F.lit("|"), text("line_end"), F.lit("|"), text("excerpt"))
    g = evidence.groupBy("subject").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return g.select("subject", F.sha2(F.concat(F.array_join("lines", "\n"), F.lit("\n")), 256).alias("fingerprint"))


def pack(blocks: DataFrame, budget: int) -> DataFrame:
    """Blocks (ctx, seq, size) that fit a budget, taken in order; one that is too big is skipped and later smaller ones may fit.

    A fold over the ordered sizes of a context; it needs no user function."""
    ordered = blocks.groupBy("ctx").agg(F.sort_array(F.collect_list(F.struct("seq", "size"))).alias("b"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))
    step = lambda a, x: F.when(a["used"] + x["size"] <= budget, F.struct((a["used"] + x["size"]).cast("long").alias("used"), F.concat(a["kept"], F.array(x["seq"].cast("long"))).alias("kept"))).otherwise(a)
    r = ordered.select("ctx", F.aggregate("b", empty, step).alias("r"))
    return r.select("ctx", F.col("r.used").alias("used"), F.size("r.kept").alias("n_kept"), F.array_join("r.kept", ",").alias("kept"))


def longest_prefix(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, namespace of the longest rule prefix: an equi-join on every folder above a path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    j = paths.select("path", F.explode(above).alias("prefix")).join(rules, "prefix")
    return j.groupBy("path").agg(F.max_by("namespace", F.length("prefix")).alias("namespace"))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The k nearest vectors (id, v) of each query (query, q) by cosine, exact; ties go to the lesser id, a query is not its own answer.

    Both sides are dealt into blocks of about `block` rows; each pair of a query block and a vector block is one matrix product
    in a task, and only the k best of each query leave it. Neither side passes through the driver or one task."""
    import numpy as np
    import pandas as pd

    def blocks(df: DataFrame, key: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // block))
        return df.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n

    (q, nq), (v, nv) = blocks(queries.select("query", "q"), "query"), blocks(vectors.select("id", "v"), "id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("query", "q", F.col("_own").alias("qb"), every(nv).alias("vb"))
    v = v.select("id", "v", every(nq).alias("qb"), F.col("_own").alias("vb"))

    def unit(rows: pd.Series) -> np.ndarray:
        x = np.array(rows.tolist(), float)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "id": [], "cosine": []})
        b = b.sort_values("id")
        s = unit(a["q"]) @ unit(b["v"]).T
        top = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
        return pd.DataFrame({"query": np.repeat(a["query"].to_numpy(), top.shape[1]), "id": b["id"].to_numpy()[top].ravel(), "cosine": np.take_along_axis(s, top, 1).ravel()})

    got = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(best, "query long, id long, cosine double")
    return first_by(got.filter("query <> id"), ["query"], [F.desc("cosine"), F.col("id")], k)
