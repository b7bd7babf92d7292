"""Rule-based quality filter: a threshold table compiled into Spark expressions, without user functions.

Every rule bounds an integer ratio, `lo * den <= 1000 * num <= hi * den`, so the verdict is exact in any SQL engine.

Defined cases: a null text is the empty text (no words, base_failed, not kept); repeated rows and ties give one result
per input row; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Frequent function words of the languages the corpus is written in.
STOP_WORDS = (
    "the of and to in a is that it for on was as be with by this at from are not or have an "
    "der die das und zu den von ist ein mit des dem auf nicht eine im sich für als auch er es an "
    "le la les de des et un une en du est que dans qui pour sur pas par au il se ce "
    "el los las y del se un una por con para su al lo como más no"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    num: str
    den: str
    lo: int | None = None  # thousandths
    hi: int | None = None


#: The threshold table. Ratios in thousandths.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 3000, 10000),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 100),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 60, None),
    Rule("capital_ratio", "n_capitals", "word_chars", None, 300),
    Rule("exclamation_ratio", "n_exclamations", "n_words", None, 300),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 400),
)


def passes(rules=RULES) -> Column:
    """The rule table as one boolean expression."""
    tests = []
    for r in rules:
        num, den = F.lit(1000) * F.col(r.num), F.col(r.den)
        tests += [num >= F.lit(r.lo) * den] if r.lo is not None else []
        tests += [num <= F.lit(r.hi) * den] if r.hi is not None else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def passes_sql(rules=RULES) -> str:
    tests = []
    for r in rules:
        tests += [f"1000 * {r.num} >= {r.lo} * {r.den}"] if r.lo is not None else []
        tests += [f"1000 * {r.num} <= {r.hi} * {r.den}"] if r.hi is not None else []
    return " AND ".join(tests) or "true"


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def features(df: DataFrame) -> DataFrame:
    """doc_id and the counts the rules use. Three plain projections: words, sorted word windows, counts."""
    text, words, grams = F.col("text"), F.col("words"), F.col("grams")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = df.select(F.col("doc_id"), text_of().alias("text"))
    base = base.select("doc_id", "text", F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "").alias("words"))
    window = F.transform(
        words, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i"))
    )
    base = base.select(
        "doc_id", "text", "words", F.sort_array(F.slice(window, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))).alias("grams"), lines.alias("lines")
    )
    same = lambda x, y: x["g"] == y["g"]
    twice = F.filter(grams, lambda x, i: F.coalesce(same(x, F.get(grams, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(grams, i - 1)), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _without(text, SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        _without(text, CAPITALS).cast("long").alias("n_capitals"),
        _without(text, "!").cast("long").alias("n_exclamations"),
    )


def quality_rules(df: DataFrame, rules=RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per input row: the counts, base_failed and kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return features(df).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(rules))


def sql(rules=RULES) -> str:
    """The same for DuckDB over the view documents, with rows told apart by their number."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS w FROM w),
g AS (SELECT r, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY r),
f AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
        length(text) - length(replace(text, '!', '')) AS n_exclamations FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND {passes_sql(rules)} AS kept FROM b"""
