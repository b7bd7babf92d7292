"""What each of five document filters removes, over every order in which they can be applied.

A document's part in this is its mask: which filters it fails. Documents are added up to cells (part, mask) with weights (documents, of them
good, of them toxic): at most 32 cells a part, whatever the input. Each cell folds over the array of all 120 orders with `transform` and
`aggregate` into 600 weighted structs, and the cells of a part are merged by element-wise sums.

Only filter E looks beyond its own document. Copies are told by the SHA-256 of the text, and rows are added up by (text, part, mask, labels)
before the least id of a text is looked for, so a text that fills a third of the table is a few rows by then.

Defined cases: a null text is the empty text, a null source the empty string; a null doc_id has no smaller id and is smaller than none, so
it neither fails E nor makes others fail it, and has no label; rows of equal id and text don't fail E by each other; a document with several label
rows is good (toxic) if one of them says so; null labels say nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of

FILTERS = "ABCDE"
#: All orders, as strings of the filters' letters.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 200
#: What is counted of a step; `shapley` is added once the cells are merged.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(text: Column) -> Column:
    """The filters A to D that a text fails, as the low four bits of a mask."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    distinct = F.size(F.array_distinct(words))
    fails = (F.size(words) < MIN_WORDS, 100 * distinct < 50 * F.size(words), 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]"))
    return reduce(add, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)])


def _labels(labels: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part that fail exactly the filters of the mask."""
    text = text_of()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"),
        own_failures(text).cast("int").alias("mask"),
    )
    rows = rows.join(_labels(labels), "doc_id", "left").na.fill(0, ["quality", "toxic"])
    kind = ["content", "part", "mask", "quality", "toxic"]
    each = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    each = each.groupBy(*kind).agg(F.sum("n").alias("n"), least, F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    first = each.groupBy("content").agg(F.min("least.doc_id").alias("first"))
    of_first = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    each = each.join(first, "content").withColumn("unique", F.col("n_null") + of_first)
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("unique").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("unique")).alias("n"))))
    each = each.select("part", "quality", "toxic", split.alias("c")).filter("c.n > 0")
    weight = F.col("c.n")
    return each.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum(weight).alias("n"), F.sum(weight * F.col("quality")).alias("good"), F.sum(weight * F.col("toxic")).alias("toxic")
    )


def fold(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """The 600 structs of a cell: for each order, its five steps, each with the cell's weight where it counts."""
    orders = F.array(*[F.array(*[F.lit(FILTERS.index(f)) for f in o]) for o in ORDERS])
    zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")

    def step(state: Column, f: Column) -> Column:
        fails, gone = F.getbit(mask, f) == 1, state["gone"]
        here = fails & ~gone
        of = lambda test, w: F.when(test, w).otherwise(zero)
        made = F.struct(
            of(~gone & ~fails, n).alias("kept"),
            of(here, n).alias("removed"),
            of(fails & gone, n).alias("redundant"),
            of(fails & (F.bit_count(mask) == 1), n).alias("unique_fails"),
            of(here, good).alias("good_lost"),
            of(here, toxic).alias("toxic_lost"),
        )
        return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(made)).alias("steps"))

    start = F.struct(F.lit(False).alias("gone"), none.alias("steps"))
    return F.flatten(F.transform(orders, lambda o: F.aggregate(o, start, step, lambda s: s["steps"])))


def merged(folded: Column) -> Column:
    """The element-wise sums of several cells' structs."""
    both = lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS])
    return F.aggregate(F.slice(folded, 2, 32), F.get(folded, F.lit(0)), lambda acc, cell: F.zip_with(acc, cell, both))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order and step: filter_order, step, filter, the counts and shapley (long)."""
    parts = cells(docs, labels).select("part", fold(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic")).alias("steps"))
    parts = parts.groupBy("part").agg(F.collect_list("steps").alias("cells"))  # 32 cells at most
    parts = parts.select("part", merged(F.col("cells")).alias("steps"))
    out = parts.select("part", F.posexplode("steps").alias("at", "s"))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (F.floor(F.col("at") / 5) + 1).cast("int"))
    out = out.select("part", order.alias("filter_order"), (F.col("at") % 5 + 1).cast("int").alias("step"), *[F.col(f"s.{c}").alias(c) for c in COUNTS])
    out = out.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))  # 120 rows, where they are already


def sql() -> str:
    """The same for DuckDB over documents and labels."""
    fails = " + ".join(f"CASE WHEN {t} THEN {1 << i} ELSE 0 END" for i, t in enumerate((f"n < {MIN_WORDS}", "100 * u < 50 * n", "100 * c > 2 * length(text)", "regexp_matches(text, '[#$%&*|]')", "coalesce(doc_id > first, false)")))
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS t FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
m AS (SELECT *, len(words) AS n, len(list_distinct(words)) AS u, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS c FROM w),
k AS (SELECT part, {fails} AS mask, count(*) AS n, sum(coalesce(q, 0)) AS good, sum(coalesce(t, 0)) AS tox FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, s AS step, filter_order[s] AS filter, bits[s] AS bit, list_sum(bits[:s - 1])::BIGINT AS before FROM o, range(1, 6) r(s)),
x AS (SELECT part, filter_order, step, filter, k.n, good, tox, (mask & bit) <> 0 AS fails, (mask & coalesce(before, 0)) <> 0 AS gone, mask = bit AS sole FROM k, s),
g AS (SELECT part, filter_order, step::INTEGER AS step, filter, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN sole THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone THEN tox ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM g"""
