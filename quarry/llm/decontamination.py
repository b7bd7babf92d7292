"""Benchmark decontamination: windows of documents within a small edit distance of benchmark items.

Windows of the items' sizes are embedded by random walks that turn edit distance into Hamming distance (each step copies the
word under the cursor and moves on by a random bit of that word). Sampled positions of the walk are hashed, WALKS walks with BANDS
samples of BITS positions each; windows that meet an item in one of the hashes are verified by exact word edit distance. Walks
fall out of step as edits gather, so items of over SPLIT_WORDS words are embedded in parts of PART_WORDS words: of a copy within the edit
limit at least one part is within the limit of its size, and often many are. A hash that a window shares with a part names
the place of the whole item, which is then verified. Recall at the edit limit is 0.99 or more at every size (tests measure it);
an exact copy is always found.

A window within d edits of a part keeps at least (words - q + 1) - q d of its q-word sequences, so windows with fewer
of the benchmark's sequences are not embedded: that loses none. q is 3, of items of under eight words 2, of one word 1. Documents are read
once and never shuffled. The items travel to the tasks in blocks of at most BLOCK_WORDS words, each block one pass, whatever the size
of the benchmark.

Words are runs of letters and digits in lower case. Defined cases: null and empty texts match nothing; items without a word
or without an id are ignored; items of one to four words are found only as they are; repeated documents give repeated rows, items with
equal words are reported each; very long texts are searched whole, in time proportional to their length and to what they hold of the
benchmark; ids pass through unchanged, null included; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SIMILARITY, columns_of, longs, renamed, text_of, with_python
from .hashing import GOLDEN, grams, mix

#: Walks of a window, samples of a walk, positions of a sample.
WALKS, BANDS, BITS = 16, 4, 3
#: Steps of a walk for each word of the window.
STEPS = 1.5
PART_WORDS, SPLIT_WORDS = 24, 36
BLOCK_WORDS = 500_000
#: Item sizes within this ratio share a window size, from SHORT_WORDS words on.
CLASS_RATIO, SHORT_WORDS = 1.1, 8
TABLE_BITS = 22
#: Windows that are embedded at once.
CHUNK = 4096


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def max_edits(n: int, similarity: float = SIMILARITY) -> int:
    """Edits allowed to an item of n words: similarity is 1 - edits / n."""
    return int((1 - similarity) * n + 1e-9)


def edits_from(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each start in `words`: least word edits that turn the item into the words from there up to some end."""
    item, words = item[::-1], words[::-1]  # backwards: the end is free, the start is the column
    row = np.zeros(len(words) + 1, np.int64)
    steps = np.arange(len(words) + 1)
    for i, w in enumerate(item, 1):
        cost = np.empty_like(row)
        cost[0] = i
        np.minimum(row[:-1] + (words != w), row[1:] + 1, out=cost[1:])
        row = np.minimum.accumulate(cost - steps) + steps  # insertions run along the row
    return row[::-1]


class SizeClass:
    """Parts of nearly one size, in one table of the hashes of their walks."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray]], edits: int, q: int, rng: np.random.Generator):
        sizes = [len(w) for _, _, w in parts]
        self.small, self.large, self.q = min(sizes), max(sizes), q
        self.need = max(1, self.small - q + 1 - q * edits)
        self.span = self.large + edits - q + 1
        steps = max(3, int(STEPS * self.small))
        self.odd = rng.integers(0, 2**63, (steps, WALKS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.sampled = np.stack([np.sort(rng.choice(steps, min(BITS, steps), replace=False)) for _ in range(WALKS * BANDS)])
        flat = np.concatenate([np.concatenate([w, np.zeros(self.large, np.uint64)]) for _, _, w in parts])
        starts = np.cumsum([0, *(n + self.large for n in sizes[:-1])])
        keys = np.concatenate([self.embed(flat, starts[i : i + CHUNK]) for i in range(0, len(starts), CHUNK)], axis=1)
        order = np.argsort(keys, axis=None, kind="stable")
        self.keys = keys.ravel()[order]
        part = np.tile(np.arange(len(parts)), len(keys))[order]
        self.item, self.offset = np.array([p[0] for p in parts])[part], np.array([p[1] for p in parts])[part]

    def embed(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A key for each walk and sample (rows) of each start (columns). `words` ends with `large` paddings."""
        mixed, cursor = mix(words), np.repeat(starts[None, :], WALKS, axis=0)
        last, seen = (starts + self.large - 1)[None, :], np.empty((len(self.odd), WALKS, len(starts)), np.uint64)
        for j, odd in enumerate(self.odd):
            seen[j] = words[cursor]
            cursor = np.minimum(cursor + ((mixed[cursor] * odd) >> np.uint64(63)).astype(np.int64), last)
        walk = np.repeat(np.arange(WALKS), BANDS)
        key = np.repeat((np.arange(WALKS * BANDS, dtype=np.uint64) * GOLDEN)[:, None], len(starts), axis=1)
        for j in range(self.sampled.shape[1]):
            key = mix(key + seen[self.sampled[:, j], walk])
        return key

    def met(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, places where they would begin) of the starts that share a hash with a part."""
        for i in range(0, len(starts), CHUNK):
            some = starts[i : i + CHUNK]
            row = self.embed(words, some)
            low, high = (np.searchsorted(self.keys, row.ravel(), side).astype(np.int64) for side in ("left", "right"))
            n = high - low
            at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
            yield self.item[at], np.tile(some, len(row)).repeat(n) - self.offset[at]


class Index:
    """A block of items, hashed by their walks."""

    def __init__(self, ids: list[int], items: list[np.ndarray], similarity: float = SIMILARITY, seed: int = 7):
        rng = np.random.default_rng(seed)
        keep = [(i, w) for i, w in zip(ids, items) if len(w)]
        self.ids, self.items = [i for i, _ in keep], [w for _, w in keep]
        self.edits = [max_edits(len(w), similarity) for w in self.items]
        by_size: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for k, w in enumerate(self.items):
            whole = len(w) <= SPLIT_WORDS
            size = len(w) if whole else PART_WORDS
            for at in [0] if whole else sorted({*range(0, len(w) - size + 1, size), len(w) - size}):
                by_size.setdefault(size, []).append((k, at, w[at : at + size]))
        self.classes: list[SizeClass] = []
        sizes = sorted(by_size)
        while sizes:
            small = sizes[0]
            some = [n for n in sizes if n == small or small >= SHORT_WORDS and n <= small * CLASS_RATIO]
            sizes = sizes[len(some) :]
            q = 3 if small >= SHORT_WORDS else min(2, small)
            self.classes.append(SizeClass([p for n in some for p in by_size[n]], max(max_edits(n, similarity) for n in some), q, rng))
            self.classes[-1].seeds = np.unique(np.concatenate([grams(w, q) for n in some for _, _, w in by_size[n]]))
        #: By sequence length: all its sequences, a table of their leading bits, the classes that each belongs to.
        self.seeds = {}
        for q in {c.q for c in self.classes}:
            own = [c for c in self.classes if c.q == q]
            seeds = np.unique(np.concatenate([c.seeds for c in own]))
            first = np.zeros(1 << TABLE_BITS, bool)
            first[seeds >> np.uint64(64 - TABLE_BITS)] = True
            self.seeds[q] = seeds, first, own, np.stack([np.isin(seeds, c.seeds, assume_unique=True) for c in own])

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, edits, first word) of the best window of each item found in a document's word hashes."""
        words = np.asarray(words).view(np.uint64)
        found: dict[int, list[np.ndarray]] = {}
        for q, (seeds, first, own, belongs) in self.seeds.items():
            if len(words) < q:
                continue
            g = grams(words, q)
            at = np.flatnonzero(first[g >> np.uint64(64 - TABLE_BITS)])
            place = np.minimum(np.searchsorted(seeds, g[at]), len(seeds) - 1)
            ok = seeds[place] == g[at]
            at, place = at[ok], place[ok]
            if len(at) < min(c.need for c in own):
                continue
            for c, has in zip(own, belongs):
                hit = at[has[place]]
                if len(hit) < c.need:
                    continue
                # Starts whose window holds as many sequences as it needs: all those between a hit and the one `need` later.
                low, high = np.maximum(hit[c.need - 1 :] - c.span + 1, 0), hit[: len(hit) - c.need + 1]
                step = np.zeros(len(words) + 2, np.int64)
                np.add.at(step, low[low <= high], 1)
                np.add.at(step, high[low <= high] + 1, -1)
                starts = np.flatnonzero(np.cumsum(step)[: len(words)] > 0)
                padded = np.concatenate([words, np.zeros(c.large + 1, np.uint64)])
                for item, begin in c.met(padded, starts):
                    for k in np.unique(item):
                        found.setdefault(int(k), []).append(begin[item == k])
        out = []
        for k, places in found.items():
            item, most = self.items[k], self.edits[k]
            begins, best = np.unique(np.concatenate(places)), (most + 1, 0)
            for run in np.split(begins, np.flatnonzero(np.diff(begins) > 2 * most + 1) + 1):  # places near each other are compared at once
                low, high = max(int(run[0]) - most, 0), max(int(run[-1]) + most, 0)
                d = edits_from(item, words[low : high + len(item) + most])[: high - low + 1]
                best = min(best, (int(d.min()), low + int(d.argmin())))
            if best[0] <= most:
                out.append((self.ids[k], *best))
        return sorted(out)


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(ids, word hashes) of the items, a bounded number of words at a time. One block is on the driver at a time."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), word_hashes(text_of()).alias("words"))
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, -(-total // block_words))
    for k in range(n):
        rows = (items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == k)).collect()
        yield [r.item_id for r in rows], [np.asarray(r.words, np.int64).view(np.uint64) for r in rows]


#: The index that this Python worker has built last, by the number of its broadcast: tasks of one job share it.
_BUILT: dict = {}


def _index(shared, number: int, similarity: float) -> Index:
    if _BUILT.get("key") != (number, similarity):
        _BUILT.clear()
        _BUILT.update(key=(number, similarity), index=Index(*shared.value, similarity))
    return _BUILT["index"]


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, n_item_words, n_edits, first_word: the best window of each item in each contaminated document."""
    out = None
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def find(words, shared=shared, number=shared._jbroadcast.id()):
            index = _index(shared, number, similarity)
            rows = [(r, i, e, p) for r, w in enumerate(longs(words)) for i, e, p in index.matches(w)]
            size = {i: len(w) for i, w in zip(index.ids, index.items)}
            return [r[0] for r in rows], [[r[1] for r in rows], [size[r[1]] for r in rows], [r[2] for r in rows], [r[3] for r in rows]]

        part = with_python(docs, [F.col("doc_id").cast("long")], [word_hashes(text_of())], "item_id long, n_item_words long, n_edits long, first_word long", find)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("k0", "doc_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the documents that hold a benchmark item. Documents are only filtered, in place; all columns stay as they are."""
    out = docs
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(words, shared=shared, number=shared._jbroadcast.id()):
            index = _index(shared, number, similarity)
            rows = [r for r, w in enumerate(longs(words)) if not index.matches(w)]
            return rows, []

        out = renamed(with_python(out, columns_of(out), [word_hashes(text_of())], "", clean), docs)
    return out
