"""Streaming forms of the job-state, usage and sampling jobs. Each takes a streaming or a batch frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("DONE", "FAILED", "CANCELLED")


def latest_state(events: DataFrame) -> DataFrame:
    """job_id, state, seq: the first terminal state of a job, else its latest; nothing counts after a terminal state."""
    terminal = F.col("state").isin(*TERMINAL)
    g = events.groupBy("job_id").agg(F.min_by(F.struct("state", "seq"), F.when(terminal, F.col("seq"))).alias("t"), F.max_by(F.struct("state", "seq"), "seq").alias("l"))
    return g.select("job_id", F.coalesce("t.state", "l.state").alias("state"), F.coalesce("t.seq", "l.seq").alias("seq"))


def usage_by_day(events: DataFrame, limit: int, late: str = "1 day") -> DataFrame:
    """user_id, day, tokens, over_limit in daily windows behind a watermark."""
    d = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.sum("tokens").alias("tokens"))
    return d.select("user_id", F.to_date("w.start").alias("day"), "tokens", (F.col("tokens") > limit).alias("over_limit"))


def idle_sessions(events: DataFrame, gap: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """job_id, start, end, n of the runs of events without an idle gap."""
    s = events.withWatermark("ts", late).groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def overflow(events: DataFrame, max_events: int = 64, max_chars: int = 512 * 1024) -> DataFrame:
    """subscriber, pending, chars, closed of a log of deliveries (subscriber, delta: 1 put in, -1 taken out, chars): a subscriber with too much
    pending is closed. Counts add up, so it runs on a stream in update mode."""
    g = events.groupBy("subscriber").agg(F.sum("delta").alias("pending"), F.sum(F.col("delta") * F.col("chars")).alias("chars"))
    return g.withColumn("closed", (F.col("pending") > max_events) | (F.col("chars") > max_chars))


def step_status(events: DataFrame) -> DataFrame:
    """job_id, step, attempts, progress, status of step events (job_id, step, seq, kind: START, PROGRESS, DONE or FAILED, progress): starts are
    attempts, the last progress counts, and the last of start and end tells the status."""
    state = F.col("kind").isin("START", "DONE", "FAILED")
    g = events.groupBy("job_id", "step").agg(F.count_if(F.col("kind") == "START").alias("attempts"), F.max_by("progress", F.when(F.col("progress").isNotNull(), F.col("seq"))).alias("progress"), F.max_by("kind", F.when(state, F.col("seq"))).alias("last"))
    return g.select("job_id", "step", "attempts", "progress", F.when(F.col("last") == "START", "RUNNING").otherwise(F.coalesce("last", F.lit("PENDING"))).alias("status"))


def sampling(samples: DataFrame, max_gap_ms: int = 250) -> DataFrame:
    """run, phase, n, max_gap, peak, complete of a stream of samples (run, phase, t_ms, value) in the order of arrival: what is known of a phase
    after each batch. A phase's state is its last time, widest gap, peak and number; late samples count, but open no gap."""
    import pandas as pd

    def fold(key, batches, state):
        last, gap, peak, n = state.get if state.exists else (None, 0, float("-inf"), 0)
        for b in batches:
            for t, v in b.sort_values("t_ms")[["t_ms", "value"]].itertuples(index=False):
                gap = gap if last is None else max(gap, int(t) - last)
                last = int(t) if last is None else max(last, int(t))
                peak, n = (peak if pd.isna(v) else max(peak, float(v))), n + 1
        state.update((last, gap, peak, n))
        yield pd.DataFrame({"run": [key[0]], "phase": [key[1]], "n": [n], "max_gap": [gap], "peak": [peak], "complete": [gap <= max_gap_ms]})

    out, state = "run long, phase string, n long, max_gap long, peak double, complete boolean", "last long, gap long, peak double, n long"
    return samples.groupBy("run", "phase").applyInPandasWithState(fold, out, state, "update", "NoTimeout")
