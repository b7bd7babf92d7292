"""Toxic passages by maximum-scoring segments.

Each word scores the log-odds of its most telling unit (the word or a prefix of it) between toxic and other labelled text, with
an informative Dirichlet prior from the unit's frequency in the whole corpus; units without significant odds share one negative
background score. Words recur within a text, so significance counts texts, not occurrences; and as toxic texts may have more of one language or subject
than others, which lifts all its words a little, a unit must also be LEAST times as likely in toxic text. One linear scan finds all maximal segments, each a passage that no extension improves. A segment of score s
in a text of n words is expected K n exp(-lambda s) times by chance; the logarithms of that, for the best and for all significant
passages, are calibrated to a probability.

A word that recurs says less each time: its k-th occurrence in a text scores a k-th of the first.

Units are learned from a bounded sample of labelled rows (`PER_CLASS` of each label, one of near copies); prior counts cover all documents.

Defined cases: null and empty texts have no passage; without labels (an empty table, null labels or ids) no unit is significant and all
scores are equal; a repeated label counts once, of contradicting ones the higher; every input row gives one row, repeated rows too; very long texts
are scanned whole, in linear time; ids pass through unchanged, null included; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import fit_logistic, probability
from .common import SHINGLE_WORDS, cut, text_of, with_python
from .hashing import GOLDEN, ascii_words, grams, mix
from .labelled import fold, sample

PER_CLASS = 4000
#: Prior strength in words; least z-score and least number of toxic sample texts of a unit.
PRIOR, MIN_Z, MIN_TEXTS = 1000.0, 3.0, 4
#: A language or subject that toxic texts favour by less than this makes no unit.
LEAST = 4.0
#: Occurrences of a unit that count in a sample text: one text that repeats a word is no evidence against the word.
PER_TEXT = 2
#: Min-hashes in a band, and bands: texts are near copies if they share a band.
BAND, BANDS = 2, 4
PREFIXES = (3, 4, 5, 6, 7, 8)
MEMORY_WORDS = 600_000
#: Count vectors that one task adds up, and vectors that the driver adds at last.
FAN_IN, LAST = 64, 16
#: Chance expectation below which a passage is significant.
SIGNIFICANT = 0.05


def words_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def units_of(word: str) -> list[str]:
    """The word and, marked, its proper prefixes."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if k < len(word))]


def segments(hits: list[tuple[int, float]], n: int, background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) of n words: hits have positive scores, all others `background` < 0.

    A run of words between hits counts as one item, which changes no maximal segment; the scan is linear in the hits."""
    found: list[list[float]] = []  # start, end, cumulative before, cumulative after, index of the last earlier one that begins lower
    total, at = 0.0, 0
    for i, s in hits:
        total += background * (i - at)
        before, total, at = total, total + s, i + 1
        start, j = i, len(found) - 1
        while j >= 0 and found[j][2] >= before:
            j = found[j][4]
        while j >= 0 and found[j][3] < total:
            start, before, lower = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = lower
        found.append([start, at, before, total, j])
    return [(int(a), int(b), d - c) for a, b, c, d, _ in found]


@dataclass
class Model:
    units: dict[str, float] = field(default_factory=dict)
    background: float = -0.02
    lam: float = 1.0
    k: float = 0.1
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))
    _known: dict[str, float] = field(default_factory=dict)

    def word(self, w: str) -> float:
        """The unit of highest odds speaks for the word."""
        return max((self.units[u] for u in units_of(w) if u in self.units), default=0.0)

    def scored(self, text: str) -> tuple[int, list[tuple[int, float]]]:
        """The number of words, and (place, score) of those with significant odds."""
        words, known = words_of(text), self._known
        try:
            s = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > MEMORY_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.word(w)
            s = list(map(known.__getitem__, words))
        hits, times = [], Counter()
        for i, x in enumerate(s):
            if x:
                times[words[i]] += 1
                hits.append((i, x / times[words[i]]))
        return len(words), hits

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        n, hits = self.scored(text)
        return n, segments(hits, n, self.background)

    def evidence(self, text: str) -> tuple[float, float, int, int]:
        """(-log expectation of the best passage, sum over significant passages, their number, words in them)."""
        n, found = self.passages(text)
        rare = [(self.lam * s - math.log(self.k * max(n, 1)), b - a) for a, b, s in found]
        good = [x for x in rare if x[0] >= -math.log(SIGNIFICANT)]
        best = max((x[0] for x in rare), default=-5.0)
        return max(-5.0, min(best, 30.0)), min(sum(x[0] for x in good), 60.0), len(good), sum(x[1] for x in good)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}


def _originals(rows: DataFrame) -> DataFrame:
    """rows (id, text, y, half) without near copies of other texts of their label, which would make their own words seem telling: such as share all
    min-hashes of five-word shingles in one of BANDS bands with a row of lower id. The sample is bounded, and so are its copies."""

    def bands(text):
        sets = [grams(w, SHINGLE_WORDS) for w in ascii_words(text)]
        salts = np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * GOLDEN
        low = [np.array([mix(s ^ x).min() for x in salts]) if len(s) else np.zeros(0, np.uint64) for s in sets]
        return None, [[[int(grams(m[b * BAND :][:BAND], BAND).view(np.int64)[0]) ^ b for b in range(BANDS) if len(m)] for m in low]]

    keys = with_python(rows, [F.col("id"), F.col("y")], [F.col("text")], "keys array<long>", bands).select(F.col("k0").alias("id"), F.col("k1").alias("y"), F.explode("keys").alias("key"))
    keys = cut(keys)
    first = keys.groupBy("y", "key").agg(F.min("id").alias("first"))
    copies = keys.join(first, ["y", "key"]).filter("id <> first").select("id").distinct()
    return rows.join(F.broadcast(copies), "id", "left_anti")


def _sample_counts(rows: DataFrame) -> pd.DataFrame:
    """By unit (index) and half of the sample (columns): other, tox, clean, texts: occurrences in other and in toxic texts, number of other and of
    toxic texts; of the units in MIN_TEXTS toxic texts."""

    def run(text, y, half):
        n = {}
        for t, y, h in zip(text.to_pylist(), y.to_pylist(), half.to_pylist()):
            c = Counter(words_of(t))
            u = Counter()
            for w, k in c.items():
                for x in units_of(w):
                    u[x] += k
            u[""] = sum(min(k, PER_TEXT) for k in u.values())
            for x, k in u.items():
                at = n.setdefault((x, h), [0, 0, 0, 0])
                at[y] += min(k, PER_TEXT) if x else k
                at[2 + y] += 1
        return np.zeros(len(n), np.int64), [[x for x, _ in n], [h for _, h in n], *([v[i] for v in n.values()] for i in range(4))]

    c = with_python(rows, [], [F.col("text"), F.col("y"), F.col("half")], "unit string, half int, other long, tox long, clean long, texts long", run)
    one = lambda name, h: F.sum(F.when(F.col("half") == h, F.col(name)).otherwise(0)).alias(f"{name}{h}")
    c = c.groupBy("unit").agg(*[one(x, h) for x in ("other", "tox", "clean", "texts") for h in (0, 1)])
    return c.filter(F.col("texts0") + F.col("texts1") >= MIN_TEXTS).toPandas().set_index("unit")


def _significant(counts: pd.DataFrame, size: pd.Series, corpus: np.ndarray, total: int) -> dict[str, float]:
    """Log-odds of the units that are LEAST times as likely in toxic text, significantly so. counts and size (of all units): other, tox, clean, texts.

    The z-score of the odds leaves out words too rare in the corpus to be told; the root of the likelihood ratio
    of the unit's texts, which also holds for units that no clean text has, those that stand out by chance among so many."""
    a = PRIOR * (corpus + 0.5) / max(1, total)
    t, o = counts.tox.to_numpy() + a, counts.other.to_numpy() + a
    odds = np.log(t / (size.tox + PRIOR - t)) - np.log(o / (max(1, size.other) + PRIOR - o))
    texts, clean = counts.texts.to_numpy(float), counts.clean.to_numpy(float)
    share = size.texts / max(1, size.texts + size.clean)
    part = lambda x, p: x * np.log(np.maximum(x, 1) / np.maximum((texts + clean) * p, 1e-9))
    ratio = np.maximum(0, 2 * (part(texts, share) + part(clean, 1 - share)))
    z = odds / np.sqrt(1 / (texts + a) + 1 / (clean + a))
    ok = (texts >= MIN_TEXTS) & (odds >= math.log(LEAST)) & (z >= MIN_Z) & (ratio >= 2 * math.log(max(1, len(counts))))
    return dict(zip(counts.index[ok], odds[ok].tolist()))


def _corpus_counts(docs: DataFrame, units: list[str]) -> tuple[np.ndarray, int]:
    """Occurrences of each candidate unit in all documents, and the number of all words.

    A task adds up one vector over its documents and hands on that one row; the vectors are as long as the list of candidates,
    which the label sample bounds. They are added up in a tree, FAN_IN in a task, until LAST are left for the driver."""
    index = {u: i for i, u in enumerate(units)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, known = np.zeros(len(index) + 1, "int64"), {}
        for b in batches:
            for t in b["text"]:
                words = words_of(t)
                total[-1] += len(words)
                for w, k in Counter(words).items():
                    at = known.get(w)
                    if at is None:
                        if len(known) > MEMORY_WORDS:
                            known.clear()
                        at = known[w] = [index[x] for x in units_of(w) if x in index]
                    for i in at:
                        total[i] += k
        if total[-1]:
            yield pd.DataFrame({"n": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(index) + 1, "int64")
        for b in batches:
            for n in b["n"]:
                total += np.frombuffer(n, "int64")
        if total[-1]:
            yield pd.DataFrame({"n": [total.tobytes()]})

    texts = docs.select(text_of().alias("text"))
    parts, n = texts.mapInPandas(count, "n binary"), texts.rdd.getNumPartitions()
    while n > LAST:
        n = max(LAST, -(-n // FAN_IN))
        parts = parts.repartition(n).mapInPandas(add, "n binary")
    total = np.zeros(len(index) + 1, "int64")
    for r in parts.collect():
        total += np.frombuffer(r.n, "int64")
    return total[:-1], int(total[-1])


def _fitted(rows: DataFrame, units: dict[str, float]) -> Model:
    """A model of these units, with its background and the distribution of chance scores in the clean texts of `rows`."""
    model = Model(units)

    def hits(text):
        got = [model.scored(t) for t in text.to_pylist()]
        return None, [[n for n, _ in got], [[s for _, s in h] for _, h in got]]

    seen = with_python(rows, [F.col("y")], [F.col("text")], "n long, hits array<double>", hits).withColumnRenamed("k0", "y").toPandas()
    size = {y: max(1, seen.n[seen.y == y].sum()) for y in (0, 1)}
    share = {y: (sum(map(len, seen.hits[seen.y == y])) + 0.5) / (size[y] + 1) for y in (0, 1)}
    model.background = min(-1e-3, math.log((1 - share[1]) / (1 - share[0])))
    null = Counter(round(s, 2) for h in seen.hits[seen.y == 0] for s in h) or Counter({round(max(model.units.values()), 2): 0.5})
    model.lam, model.k = extreme_value(null, size[0], model.background)
    return model


def _features(rows: DataFrame, model: Model) -> pd.DataFrame:
    def run(text):
        e = [model.evidence(t) for t in text.to_pylist()]
        return None, [[x[0] for x in e], [x[1] for x in e]]

    return with_python(rows, [F.col("y")], [F.col("text")], "best double, total double", run).withColumnRenamed("k0", "y").toPandas()


def train(docs: DataFrame, labels: DataFrame, n: int = 3, held: int = 1, per_class: int = PER_CLASS) -> Model:
    """Units of the whole sample. The calibration sees texts as new ones are seen: each half is scored by the units of the other half."""
    half = (F.crc32(F.col("text").cast("binary")) % 2).cast("int").alias("half")
    rows = cut(_originals(cut(sample(docs, labels, "toxic", n, held, per_class).select(F.monotonically_increasing_id().alias("id"), "text", "y", half))))
    counts = _sample_counts(rows)
    if "" not in counts.index:
        return Model()
    size, counts = counts.loc[""], counts.drop("")
    corpus, total = _corpus_counts(docs, list(counts.index))

    def units(*halves: int) -> dict[str, float]:
        of = lambda c: pd.concat([sum(c[f"{x}{h}"] for h in halves).rename(x) for x in ("other", "tox", "clean", "texts")], axis=1)
        return _significant(of(counts), of(size.to_frame().T).iloc[0], corpus, total)

    if not (whole := units(0, 1)):
        return Model()
    model = _fitted(rows, whole)
    seen = []
    for h in (0, 1):
        if some := units(1 - h):
            seen.append(_features(rows.filter(F.col("half") == h), _fitted(rows.filter(F.col("half") != h), some)))
    seen = pd.concat(seen) if len(seen) == 2 else _features(rows, model)  # too few labels for halves
    if seen.y.nunique() > 1:
        model.weights = fit_logistic(seen[["best", "total"]].to_numpy(), seen.y.to_numpy())
    return model


def extreme_value(null: Counter, n: int, background: float) -> tuple[float, float]:
    """lambda, the positive root of E[exp(lambda s)] = 1 over the words of clean text, and K by its usual bound lambda * E|s|."""
    p = {s: c / n for s, c in null.items()}
    rest = 1 - sum(p.values())
    f = lambda x: rest * math.exp(x * background) + sum(q * math.exp(x * s) for s, q in p.items()) - 1
    lo, hi = 1e-6, 4.0
    if f(lo) >= 0:  # the mean score of clean text is not negative: chance alone gives long passages
        return 0.05, 1.0
    while f(hi) > 0 and hi - lo > 1e-6 or hi - lo > 1e-6:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    mean = -(rest * background + sum(q * s for s, q in p.items()))
    return lo, min(1.0, max(1e-3, lo * mean))


def toxicity_scores(docs: DataFrame, labels: DataFrame, n: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, passage_words for every document."""
    model = train(docs, labels, n, held)

    def run(text):
        e = np.array([model.evidence(t) for t in text.to_pylist()], float).reshape(-1, 4)
        return None, [probability(e[:, :2], model.weights), e[:, 2].astype("int64"), e[:, 3].astype("int64")]

    out = with_python(docs, [F.col("doc_id").cast("long"), fold(n) == held], [text_of()], "score double, n_passages long, passage_words long", run)
    return out.select(F.col("k0").alias("doc_id"), F.col("k1").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "passage_words")
