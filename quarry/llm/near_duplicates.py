"""Near-duplicate classes by ProbMinHash.

Texts are five-word shingles, weighted by their count. Each shingle sends the arrivals of a Poisson process of its weight to random
registers; a register keeps its earliest arrival, and a shingle stops once it is later than all registers of its text. Two
registers agree with the probability Jaccard similarity of the texts. Registers are hashed in bands; texts that share a band
are candidates, compared exactly (probability Jaccard of all shingles), and linked at SIMILARITY or more. Classes are the connected
components of the links.

Exact copies are one node from the start. In a bucket, members are first compared with its hub, the text that meets most others.
Buckets that still hold several components are compared further: small ones with all their components, large ones with the hubs of
a few more components each round, while rounds pay (links over YIELD of their pairs). These rounds only join components cheaply. At the end every
bucket is finished exactly: all its pairs between different components are compared on all shingles, so no link of a bucket is lost and what it
links does not depend on the other buckets. What the bands miss is the only loss: at the limit 3 in 1000 pairs share none of them, above it fewer.

Defined cases: null and empty texts are copies of each other; texts of under five words are one shingle; a null doc_id gets the class of
its text; repeated rows give one row each; very long texts are sketched and compared whole; empty tables give an empty result; other columns are
ignored. A class id is the least doc_id of the class, null if it has none; ids pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, columns_of, cut, longs, release, renamed, text_of, with_python
from .hashing import GOLDEN, grams, groups, mix

BANDS, ROWS = 32, 8
REGISTERS = BANDS * ROWS
#: Buckets of up to so many members are compared with all of their components; in larger ones, each round adds so many hubs;
#: the rounds give way to the comparison of all pairs when a smaller share of their pairs are links.
SMALL, HUBS, YIELD = 8, 3, 0.001
#: Candidates whose registers agree less often than those of texts this much less similar are not compared: three standard errors.
SLACK = 0.09
#: Members of a bucket in a tile, and their shingles; a task compares two tiles.
TILE, TILE_SHINGLES = 256, 400_000
#: Words that are sketched at once in a task.
GROUP_WORDS = 300_000
#: Nodes whose ids are broadcast to pick out their texts; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Links whose components one partition may find.
FEW_LINKS = 20_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def sketches(rows: list[np.ndarray], shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Registers (uint64 shingle hashes) of each text, given its word hashes."""
    owner, element, weight = [], [], []
    for i, r in enumerate(rows):
        h, n = np.unique(grams(np.asarray(r), shingle), return_counts=True)
        owner.append(np.full(len(h), i, np.int64))
        element.append(h)
        weight.append(n)
    m = REGISTERS
    times, signature = np.full(len(rows) * m, np.inf), np.zeros(len(rows) * m, np.uint64)
    if not rows:
        return signature.reshape(0, m)
    owner, element, rate = np.concatenate(owner), np.concatenate(element), 1.0 / np.concatenate(weight)
    latest, now, step = np.full(len(rows), np.inf), np.zeros(len(element)), np.zeros(1, np.uint64)
    while len(owner):
        step = step + GOLDEN  # an array of one: it wraps silently
        x = mix(element + step)
        now = now - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        alive = now < latest[owner]
        owner, element, rate, now = owner[alive], element[alive], rate[alive], now[alive]
        place = owner * m + (x[alive] & np.uint64(m - 1)).astype(np.int64)
        np.minimum.at(times, place, now)
        first = times[place] == now
        signature[place[first]] = element[first]
        some = np.unique(owner)
        latest[some] = times.reshape(-1, m)[some].max(axis=1)
    return signature.reshape(-1, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    s = signature.reshape(len(signature), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * GOLDEN
    for k in range(ROWS):
        key = mix(key + s[:, :, k])
    return key.view(np.int64)


def register_bits(signature: np.ndarray) -> np.ndarray:
    """The two low bits of each register: REGISTERS low bits, then as many high bits, packed into longs."""
    bits = [np.packbits((signature >> np.uint64(k)).astype(np.uint8) & 1, axis=1) for k in (0, 1)]
    return np.ascontiguousarray(np.hstack(bits)).view(np.int64)


def _like(x: Column, y: Column, least: float) -> Column:
    """Whether the registers of two texts agree as often as those of texts of similarity `least` do: two bits agree by chance
    in a quarter of all registers."""
    half = REGISTERS // 64
    off = sum((F.bit_count((F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))).bitwiseOR(F.get(x, F.lit(half + i)).bitwiseXOR(F.get(y, F.lit(half + i))))) for i in range(half)), F.lit(0))
    return off <= F.lit(int(REGISTERS * 0.75 * (1 - least)) + 1)


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard of two arrays of shingles with repetitions: the sum over common shingles i of
    1 / sum over all j of max(a_j / a_i, b_j / b_i)."""
    return _jaccard(*np.unique(a, return_counts=True), *np.unique(b, return_counts=True))


def _jaccard(ua: np.ndarray, na: np.ndarray, ub: np.ndarray, nb: np.ndarray) -> float:
    """The same, given the different shingles in order and their counts."""
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if not len(ia):
        return 1.0 if not len(ua) and not len(ub) else 0.0
    x, y = na[ia].astype(float), nb[ib].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    only_a, only_b = na.sum() - x.sum(), nb.sum() - y.sum()
    # max(x_j / x_i, y_j / y_i) is y_j / y_i up to the ratio of i and x_j / x_i after it.
    below, above = np.cumsum(y), np.cumsum(x[::-1])[::-1] - x
    return float((1.0 / ((below + only_b) / y + (above + only_a) / x)).sum())


def _content(words: Column) -> Column:
    """What texts of equal words share."""
    return F.unhex(F.md5(F.array_join(words, " ")))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, content (MD5 of the words), bands, bits of the registers."""

    def run(words):
        rows = longs(words)
        made = [sketches(rows[g]) for g in groups(rows, GROUP_WORDS)]
        signature = np.concatenate(made) if made else sketches([])
        return None, [list(band_keys(signature)), list(register_bits(signature))]

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(text_of()).alias("w"))
    out = with_python(src, [F.col("doc_id"), _content(F.col("w"))], [_hashes(F.col("w"))], "bands array<long>, bits array<long>", run)
    return out.withColumnsRenamed({"k0": "doc_id", "k1": "content"})


def _shingles(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, shingles (sorted, with repetitions) of the nodes given as (id, doc_id, content)."""

    def run(words):
        return None, [[np.sort(grams(w, SHINGLE_WORDS)).view(np.int64) for w in longs(words)]]

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(text_of()).alias("w"))
    found = _matching(src.select("doc_id", "w", _content(F.col("w")).alias("content")), nodes.select("doc_id", "content", "id"))
    out = with_python(found, [F.col("id")], [_hashes(F.col("w"))], "shingles array<long>", run)
    return out.withColumnRenamed("k0", "id").dropDuplicates(["id"])


def _matching(rows: DataFrame, some: DataFrame) -> DataFrame:
    """rows with the columns of `some` that are equal in (doc_id, content). A few of them are broadcast, as one long each and what it stands for."""
    key = lambda: F.xxhash64("doc_id", "content")
    x = some.select(key().alias("_h"), F.struct(*some.columns).alias("_s"))
    j = rows.withColumn("_h", key()).join(F.broadcast(x) if some.count() <= BROADCAST_NODES else x, "_h")
    j = j.filter(F.col("doc_id").eqNullSafe(F.col("_s.doc_id")) & (F.col("content") == F.col("_s.content")))
    return j.select(*rows.columns, *[F.col(f"_s.{c}").alias(c) for c in some.columns if c not in ("doc_id", "content")])


def _distinct_buckets(shared: DataFrame) -> DataFrame:
    """(key, id, n) of one bucket of each set of members, that of the first band: the others hold the same pairs, and none of them is the first that a pair shares."""
    sign = [F.sum(F.shiftrightunsigned(F.xxhash64("id"), 32)).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    one = shared.groupBy("key").agg(F.first("n").alias("n"), F.min("band").alias("band"), *sign).groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("c"))
    return shared.join(one.select("c.key"), "key", "left_semi").select("key", "id", "n")


def _verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def run(sa, sb):
        return [i for i, (x, y) in enumerate(zip(longs(sa), longs(sb))) if probability_jaccard(x.view(np.uint64), y.view(np.uint64)) >= similarity], []

    sa, sb = (shingles.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    j = pairs.join(sb, "b").join(sa, "a")
    return with_python(j, [F.col("a"), F.col("b")], [F.col("sa"), F.col("sb")], "", run).withColumnsRenamed({"k0": "a", "k1": "b"})


def components(links: DataFrame, few: int | None = None) -> DataFrame:
    """(id, comp) of every linked node: alternating large-star and small-star rounds, until every link leads to its component's least id. Up to
    `few` (FEW_LINKS) links, whatever the documents, lie in one partition and need no rounds."""
    links = links.select("a", "b")
    if links.count() <= (FEW_LINKS if few is None else few):
        return links.coalesce(1).mapInArrow(_joined, "id long, comp long")
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = cut(new)
        if new.count() == edges.count() and not new.join(edges, ["u", "v"], "left_anti").head(1):
            return new.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(new.select(F.col("v").alias("id"), F.col("v").alias("comp"))).distinct()
        edges = new


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, comp) of the nodes of these links (a, b)."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    ids = list(up)
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "comp": pa.array([top(x) for x in ids], pa.int64())})


def merged(comps: DataFrame | None, links: DataFrame, few: int | None = None) -> DataFrame:
    """The components (id, comp) that further links (a, b) make of `comps`, written: only what the links join is gone through again, each component as one node."""
    if comps is None:
        return cut(components(links, few))
    held = F.broadcast if links.count() <= FEW_LINKS else lambda x: x
    placed = comps.join(held(links.select(F.explode(F.array("a", "b")).alias("id"))), "id", "left_semi")
    of = lambda c: held(placed.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}")))
    ends = cut(links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left"))
    over = cut(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), few))
    fresh = ends.filter("ca is null").select(F.col("a").alias("id")).unionByName(ends.filter("cb is null").select(F.col("b").alias("id")))
    to = held(over.select(F.col("id").alias("comp"), F.col("comp").alias("to")))
    return cut(comps.join(to, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")).unionByName(over.join(held(fresh), "id", "left_semi")))


def _candidates(shared: DataFrame, comps: DataFrame | None, hubs: int, small: bool, least: float) -> DataFrame:
    """Pairs (a < b): in each bucket, members against the most central member of other components, of the `hubs` most central
    components in it; of all components (if `small`) in buckets of up to SMALL members. Pairs whose registers differ too often are left out."""
    placed = shared.withColumn("comp", F.col("id")) if comps is None else shared.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    reps = placed.groupBy("key", "comp").agg(F.max(F.struct("degree", (-F.col("id")).alias("x"), "bits")).alias("c"), F.first("n").alias("n"))
    reps = reps.select("key", F.col("comp").alias("other"), (-F.col("c.x")).alias("rep"), F.col("c.degree").alias("d"), F.col("c.bits").alias("rep_bits"), "n")
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("d"), "rep"))
    chosen = reps.filter(F.col("n") > SMALL) if small else reps
    chosen = chosen.withColumn("rank", rank).filter(F.col("rank") <= hubs).select("key", "other", "rep", "rep_bits")
    if small:
        chosen = chosen.unionByName(reps.filter(F.col("n") <= SMALL).select("key", "other", "rep", "rep_bits"))
    pairs = placed.select("key", "id", "comp", "bits").join(chosen, "key").filter((F.col("comp") != F.col("other")) & _like(F.col("bits"), F.col("rep_bits"), least))
    return pairs.select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()


def _finished(shared: DataFrame, comps: DataFrame | None, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a < b) between different components of a bucket, after the exact comparison of all its pairs that could make one.

    Every such pair has a member outside the bucket's largest component; those, `TILE` at a time, meet all members, TILE at a time. A
    task holds two tiles with their shingles and compares inside; only links leave it, and none between what it has already joined. A pair that
    shares several buckets is compared in that of the first band. texts: (id, bands, shingles)."""
    placed = shared.withColumn("comp", F.col("id")) if comps is None else shared.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    open_ = parts.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("main"), F.count("*").alias("parts"), F.sum("m").alias("size")).filter("parts > 1")
    open_ = open_.select("key", F.col("main.comp").alias("main"), F.col("main.m").alias("m"), "size")
    placed = cut(placed.select("key", "id", "comp").join(open_, "key").join(texts, "id").withColumn("heavy", F.size("shingles")))
    weight = placed.groupBy("key").agg(F.sum("heavy").alias("all"), F.sum(F.when(F.col("comp") != F.col("main"), F.col("heavy")).otherwise(0)).alias("others"))
    tiles = lambda n, w: F.greatest(F.ceil(n / TILE), F.ceil(w / TILE_SHINGLES), F.lit(1)).cast("int")
    placed = placed.join(weight, "key").withColumns({"ty": tiles(F.col("size"), F.col("all")), "tx": tiles(F.col("size") - F.col("m"), F.col("others"))})
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    body = ["id", "comp", "main", "bands", "shingles"]
    y = placed.select("key", every("tx").alias("px"), own("ty").alias("py"), F.lit(False).alias("x"), *body)
    x = placed.filter("comp <> main").select("key", own("tx").alias("px"), every("ty").alias("py"), F.lit(True).alias("x"), *body)

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        first, x, y = int(g["key"].iloc[0]), g[g["x"]], g[~g["x"]]
        root = {c: c for c in g["comp"]}

        def top(c: int) -> int:
            while root[c] != c:
                c = root[c]
            return c

        ys = [(i, c, c == m, np.unique(s, return_counts=True)) for i, c, m, s in zip(y["id"], y["comp"], y["main"], y["shingles"])]
        bands = np.stack(y["bands"].to_list()) if len(y) else np.zeros((0, BANDS), np.int64)
        out = []
        for i, c, s, b in zip(x["id"], x["comp"], x["shingles"], x["bands"]):
            u = np.unique(s, return_counts=True)
            same = bands == np.asarray(b)[None, :]
            here = np.asarray(b)[same.argmax(axis=1)] == first  # the first band they share is this bucket's
            for k in np.flatnonzero(here):
                j, d, in_main, v = ys[k]
                if (in_main or i < j) and top(c) != top(d) and _jaccard(*u, *v) >= similarity:
                    root[top(c)] = top(d)
                    out.append((min(i, j), max(i, j)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return y.unionByName(x).groupBy("key", "px", "py").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_class: the class of every document and its number of documents."""
    sketched, classes = _classes(docs, similarity)
    return sketched.select("doc_id", "content").join(classes, "content").select("doc_id", "class_id", "n_class")


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The sketches, and (content, comp, class_id, n_class) of every different content."""
    sketched = cut(_sketched(docs))
    nodes = sketched.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.count("*").alias("n"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("id"), "*"))  # written once, so the ids stay
    members = nodes.select(F.posexplode("bands").alias("band", "key"), "id")
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(members.join(sizes, "key"))  # (key, band, id, n) of the buckets with more than one member
    inside = nodes.join(shared.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "content", "bands")
    inside = cut(inside)
    shingles = cut(_shingles(docs, inside.select("id", "doc_id", "content")))
    # The text that meets most others in its buckets is the likeliest original of a group of edited copies.
    degree = shared.groupBy("id").agg(F.sum(F.col("n") - 1).alias("degree"))
    shared = cut(_distinct_buckets(shared).join(degree.join(nodes.select("id", "bits"), "id"), "id").select("key", "id", "n", "degree", "bits"))
    comps, tested, late, turn, last = None, None, None, 1, False
    while True:
        release(docs.sparkSession)
        if last:
            new = cut(_finished(shared, comps, inside.select("id", "bands").join(shingles, "id"), similarity))
        else:
            pairs = _candidates(shared, comps, 1 if turn == 1 else HUBS * (turn - 1), turn > 1, similarity - SLACK)
            pairs = cut(pairs.join(tested, ["a", "b"], "left_anti") if tested else pairs)
            tested = tested.unionByName(pairs) if tested else pairs
            new = cut(_verified(pairs, shingles, similarity))
        found = new.count()
        ends, last = last, not last and turn > 1 and found <= YIELD * pairs.count()
        if last and found:  # few: they wait for those of the end
            late = new
        elif found or ends and late:
            comps = merged(comps, new.unionByName(late) if late else new)
        if ends:
            break
        turn += 1
    if comps is None:
        comps = new.select(F.col("a").alias("id"), F.col("a").alias("comp"))  # empty
    classes = nodes.select("id", "content", "doc_id", "n").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    ids = classes.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("n_class"))
    return sketched, cut(classes.select("comp", "content").join(ids, "comp").select("content", "comp", "class_id", "n_class"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of the least id (null ids last), of equal ids that of the least content hash, of rows equal in
    both any one. Other columns stay as they are."""
    sketched, classes = _classes(docs, similarity)
    rows = sketched.groupBy("content", "doc_id").agg(F.count("*").alias("rows")).join(classes.select("content", "comp"), "content")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "rows")).alias("c")
    kept = cut(rows.groupBy("comp").agg(least).select("c.doc_id", "c.content", "c.rows"))
    # A row is carried whole in one column: no name of the table can clash with ours.
    src = docs.select(F.struct(*columns_of(docs)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _content(words_of(text_of())).alias("content"))
    out = _matching(src, kept)
    again = out.filter("rows > 1").dropDuplicates(["doc_id", "content"])
    return out.filter("rows = 1").unionByName(again).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
