"""Spelling variants: the words of a corpus that are one edit apart, each with the frequent form it stands for.

Candidates come from an index of variable-length grams. A word is read between two end marks; from every position a gram of two characters is
taken and made longer as long as the gram so far is frequent (it starts at more than a threshold of positions of all words) and shorter than six
characters. A gram so ends by itself: which gram starts at a position depends only on its own characters. One inserted, deleted or replaced
character therefore affects only grams that cover its place; the largest number of grams over one place is the word's bound of affected grams.
A word of six or more characters has seven or more grams, at most six of them over one place, so near words always share grams: at least the
number of grams less the bound, on either side. Of each word's grams, sorted by their number in the corpus, the bound plus one rarest must
include one that the near word has among its own (of the grams that both keep, the first in this order is the same one in both): those are the lists that are merged, for words of equal or next length and places at most
one apart. Candidates are held against the bounds with all their grams, then verified by their edit distance. No pair is lost.

The threshold grows with the vocabulary so that at most FREQUENT grams of each length are frequent: that dictionary is broadcast.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty text where it enters a hash; repeated rows count each; a run that the
hash shortens below six code points or to nothing is no word; ties of forms go to the least word in code-point order; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
CAPITALS, SMALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run loses a character if this divides the hash of its document and itself.
EVERY = 199
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
SHORTEST, LONGEST = 2, 6
#: Most frequent grams of one length, and the least threshold.
FREQUENT, LEAST = 50_000, 16
#: End marks: no run holds them.
BEGIN, END = "^", "$"


def word_counts(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """word, n of the words that occur often enough. Tasks add up their own words first."""
    text = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_of().alias("text"))
    runs = text.select("id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("raw"))
    runs = runs.select("id", F.when(F.col("raw").rlike("[A-Z]"), F.translate("raw", CAPITALS, SMALLS)).otherwise(F.col("raw")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def frequent_grams(words: DataFrame) -> set[str]:
    """The grams that are made longer. Each length has at most FREQUENT of them, as each starts at more than the threshold of all positions."""
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    threshold = max(LEAST, total // FREQUENT)
    marked = words.select(F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("m"))
    marked = marked.select("m", F.explode(F.sequence(F.lit(1), F.length("m") - 1)).alias("at"))
    grams = marked.select(F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST - 1)), lambda q: F.substring("m", F.col("at"), q))).alias("gram"))
    grams = grams.filter(~F.col("gram").endswith(END)).groupBy("gram").agg(F.count("*").alias("n"))
    return {r.gram for r in grams.filter(F.col("n") > threshold).collect()}


def decompose(word: str, frequent: set[str]) -> tuple[list[str], int]:
    """The gram at each position of the marked word, and the largest number of grams over one place of the word."""
    m = f"{BEGIN}{word}{END}"
    grams, over = [], [0] * len(m)
    for p in range(len(m) - 1):
        size = SHORTEST
        while size < LONGEST and p + size < len(m) and m[p : p + size] in frequent:
            size += 1
        grams.append(m[p : p + size])
        for i in range(p, min(p + size, len(m) - 1)):
            over[i] += 1
    return grams, max(over[1:])


def decomposed(words: DataFrame, frequent: set[str]) -> DataFrame:
    """word, n, size, grams (gram, its place, and its name, which also tells repeated ones apart), affected (the bound)."""
    known = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, affected = [], []
            for w in b.column(0).to_pylist():
                g, a = decompose(w, known.value)
                seen: dict[str, int] = {}
                out = []
                for at, x in enumerate(g):
                    seen[x] = k = seen.get(x, 0) + 1
                    out.append({"gram": x, "at": at, "name": x if k == 1 else f"{x}{END}{k}"})
                grams.append(out)
                affected.append(a)
            kind = pa.list_(pa.struct([("gram", pa.string()), ("at", pa.int32()), ("name", pa.string())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(grams, kind), pa.array(affected, pa.int32())], names=["word", "n", "grams", "affected"])

    return words.mapInArrow(run, "word string, n long, grams array<struct<gram:string,at:int,name:string>>, affected int").withColumn("size", F.length("word"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of all words (word, n) at edit distance one, each pair once."""
    split = cut(decomposed(words, frequent_grams(words)))
    entries = split.select("word", "size", "affected", F.explode("grams").alias("g")).select("word", "size", "affected", "g.gram", "g.at")
    lists = entries.groupBy("gram").agg(F.count("*").alias("df"))
    # The rarest grams of each word, one more than an edit can affect.
    ranked = entries.join(lists, "gram").groupBy("word", "size", "affected").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "at"))).alias("g"))
    short = cut(ranked.select("word", "size", F.explode(F.slice("g", F.lit(1), F.col("affected") + 1)).alias("g")).select("word", "size", "g.gram", "g.at"))
    x = short.select(F.col("word").alias("a"), "gram", "size", F.col("at").alias("at_a"))
    y = short.select(F.col("word").alias("b"), "gram", F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("size"), F.col("at").alias("at_b"), F.col("size").alias("size_b"))
    met = x.join(y, ["gram", "size"]).filter((F.abs(F.col("at_a") - F.col("at_b")) <= 1) & ((F.col("size") < F.col("size_b")) | (F.col("a") < F.col("b"))))
    pairs = met.select("a", "b").distinct()
    body = lambda c: split.select(F.col("word").alias(c), F.transform("grams", lambda g: g["name"]).alias(f"g{c}"), (F.size("grams") - F.col("affected")).alias(f"t{c}"))
    held = pairs.join(body("a"), "a").join(body("b"), "b").filter(F.size(F.array_intersect("ga", "gb")) >= F.greatest("ta", "tb"))
    return held.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form (word, form): by doubling the steps that each link takes. A step multiplies n by RATIO or more, so there are
    at most some thirty of them, and five doublings at most."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if not new.filter("moved").head(1):
            return now


def spelling_variants(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = cut(word_counts(docs, every))
    pairs = cut(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = words.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    best = both.join(counts, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("k"), "b")).alias("best"))
    found = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    formed = -F.col("best.k") >= RATIO * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.b")).alias("form"), F.when(formed, -F.col("best.k")).alias("form_n")))
    out = found.join(roots(found.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
