"""Which texts hold which patterns, for many of both: no text meets a pattern with which it shares no rare piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.sources.tables import staged

#: What parts the tokens of a lower-cased text, and the length of pieces of tokens.
BREAK, PIECE = "[^a-z0-9]+", 3


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), BREAK), ""))


def _pieces(token: Column, size: Column) -> Column:
    """The parts of a token of this length; the token must not be shorter."""
    return F.transform(F.sequence(F.lit(1), F.length(token) - size + 1), lambda i: F.substring(token, i, size))


def contained(texts: DataFrame, patterns: DataFrame, scope: str) -> DataFrame:
    """scope, id, pattern of all texts (scope, id, text) and patterns (scope, pattern) of one scope where the text holds the pattern, in any case.

    Each pattern is looked up by one key: the rarest token inside it that others enclose, for a text that holds the pattern has that whole token; else, for
    patterns of one or two tokens, the rarest piece of three characters of its longest token; else, for those without a token, nothing parts the texts but the scope and
    each is compared. Texts and patterns of equal keys are then compared. An empty pattern is in no text."""
    p = patterns.select(scope, "pattern").filter("pattern <> ''").distinct().withColumn("low", F.lower("pattern"))
    split = F.split("low", BREAK)
    inner = F.array_distinct(F.array_remove(F.slice(split, F.lit(2), F.greatest(F.size(split) - 2, F.lit(0))), ""))
    longest = F.array_max(F.transform(split, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    p = p.withColumn("inner", inner).withColumn("longest", longest)
    t = texts.select(scope, "id", "text")
    tokens = t.select(scope, "id", F.explode(_tokens(F.col("text"))).alias("token"))

    def met(wanted: DataFrame, held: DataFrame) -> DataFrame:
        """(scope, id, pattern) by the rarest wanted key (scope, pattern, key) of each pattern; held: (scope, id, key) of the texts."""
        held = staged(held.join(wanted.select(scope, "key").distinct(), [scope, "key"], "left_semi").distinct())
        often = held.groupBy(scope, "key").agg(F.count("*").alias("n"))
        # A key that no text has decides: its pattern is in no text.
        best = wanted.join(often, [scope, "key"], "left").groupBy(scope, "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("b"))
        return held.join(best.filter("b.n > 0").select(scope, "pattern", F.col("b.key").alias("key")), [scope, "key"]).select(scope, "id", "pattern")

    whole = met(p.filter(F.size("inner") > 0).select(scope, "pattern", F.explode("inner").alias("key")), tokens.withColumnRenamed("token", "key"))
    short = p.filter((F.size("inner") == 0) & (F.col("longest") != "")).withColumn("size", F.least(F.length("longest"), F.lit(PIECE)))
    wanted = short.select(scope, "pattern", "size", F.explode(F.array_distinct(_pieces(F.col("longest"), F.col("size")))).alias("key"))
    sizes = F.array(*[F.lit(i) for i in range(1, PIECE + 1)])
    pieces = tokens.select(scope, "id", F.explode(F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda s: s <= F.length("token")), lambda s: _pieces(F.col("token"), s))))).alias("key"))
    parts = met(wanted.select(scope, "pattern", "key"), pieces)
    bare = p.filter("longest = ''").select(scope, "pattern").join(t.select(scope, "id"), scope).select(scope, "id", "pattern")
    pairs = whole.unionByName(parts).unionByName(bare)
    return pairs.join(t, [scope, "id"]).filter(F.contains(F.lower("text"), F.lower("pattern"))).select(scope, "id", "pattern")


def notes_for_paths(notes: DataFrame, references: DataFrame, paths: DataFrame, k: int = 5) -> DataFrame:
    """project_id, path, id, title, place: the newest k notes (project_id, id, title, content_md, updated_at) of each path (project_id, path) that hold it or refer to it
    as a file (note_id, subject_type, raw_target)."""
    texts = notes.select("project_id", "id", F.col("content_md").alias("text"))
    p = paths.select("project_id", "path").distinct()
    held = contained(texts, p.select("project_id", F.col("path").alias("pattern")), "project_id").select("project_id", "id", F.col("pattern").alias("path"))
    named = references.filter("subject_type = 'FILE'").select(F.col("note_id").alias("id"), F.col("raw_target").alias("path")).distinct()
    named = named.join(notes.select("project_id", "id"), "id").join(p, ["project_id", "path"], "left_semi").select("project_id", "id", "path")
    both = held.unionByName(named).distinct().join(notes.select("project_id", "id", "title", "updated_at"), ["project_id", "id"])
    place = F.row_number().over(W.partitionBy("project_id", "path").orderBy(F.desc_nulls_first("updated_at"), F.desc("id")))
    return both.withColumn("place", place).filter(F.col("place") <= k).select("project_id", "path", "id", "title", "place")
