"""Set-similarity join on word shingles by parity sketches: exact, without a candidate limit.

A text's set is its distinct five-word shingles; two texts link when 100 * |intersection| >= 80 * |union|.

Parity sketches. Each shingle toggles one bit of a sketch, so two sketches differ in at most as many bits as the sets do in elements. For
sizes n and m a link allows (n + m) / 9 differing elements. Texts are put in size bands (n from 2^k up); a text whose partners can be larger
than its band also enters the next one. A band's sketch is cut into segments. A segment that differs costs at least one element, so texts that link
agree in all segments but the allowed number d. Of all segments of a text, taken in one common order, the first d + 1 must then include one that
the other text has among its first: those are the keys that meet in a join (a segment's bits are many and hardly any is set; the key is
the XOR of the codes of its set bits). The order is free, which is what keeps hot passages out: segments are taken by how often the corpus
has them, counted in 2^16 slots over all texts, empty segments last. A text with a passage that a third of all texts share still has
enough segments of its own.

Partners then pass two tests: a dense sketch, about a bit for each shingle, whose Hamming distance may not exceed d, and the count of all shingles.

Components. Exact copies are one node from the start. In a bucket members are first held against its hub, then against the best members of a few more
components each round, which joins groups of copies cheaply; a bucket whose components a round leaves as they were has no more rounds. When rounds no longer pay, the open buckets are finished: every pair of members of
different components is tested on sketches, inside tasks that hold two tiles of a bucket, and what passes is verified. So no link between components
is lost, and no task or the driver holds a whole group.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing, its component is its own doc_id; texts of one to
four words are one shingle; a null doc_id is never a component's id unless the component has no other; rows of equal id give one row each; very long
texts are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, cut, longs, text_of, with_python
from .hashing import GOLDEN, ascii_words, grams, mix
from .near_duplicates import BROADCAST_NODES, merged

#: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Counters of segments; their number bounds what is gathered and broadcast.
SLOT_BITS = 16
#: Each round after the first adds so many hubs; rounds end when fewer than this share of the tested pairs link.
HUBS, YIELD = 3, 0.001
#: Buckets of up to PAIRED members take part in the first round only: in the end their pairs are joined as rows; larger buckets are compared inside tasks, in tiles of so many members.
PAIRED, TILE = 24, 512
#: Vectors that a task adds up, and that are left for the driver.
FAN_IN, LAST = 32, 8


def allowed(n: int, m: int) -> int:
    """The most elements in which linked sets of sizes n and m differ."""
    return (n + m) * (100 - PERCENT) // (100 + PERCENT)


def largest(n: int) -> int:
    """The largest set that one of size n can link with."""
    return 100 * n // PERCENT


def bands(n: int) -> list[tuple[int, int]]:
    """(band, number of keys) in which a set of size n meets its partners."""
    own, top = n.bit_length() - 1, largest(n)
    most = min(top, (2 << own) - 1)
    return [(own, allowed(n, most) + 1)] + ([(own + 1, allowed(n, top) + 1)] if top > most else [])


def segments(band: int) -> int:
    """Half as many as the band's largest set has elements: two bits in each, and over twice as many as may differ."""
    return max(16, 1 << band)


def segment_keys(shingles: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all segments of a band's sketch, and which of them are empty."""
    g = segments(band)
    bit = mix(shingles + np.arange(band + 1, band + 2, dtype=np.uint64) * GOLDEN)
    at = ((bit >> np.uint64(32)) * np.uint64(g) >> np.uint64(32)).astype(np.int64)
    parity = np.zeros(g, np.uint64)
    np.bitwise_xor.at(parity, at, bit)
    key = mix(parity + (np.arange(g, dtype=np.uint64) * np.uint64(64) + np.uint64(band)) * GOLDEN)
    return key, parity == 0


def dense(shingles: np.ndarray) -> np.ndarray:
    """The sketch for the Hamming test: 2^(band + 1) bits, 64 at least, as longs. Its two halves XORed are the sketch of half as many bits."""
    size = max(64, 2 << (len(shingles).bit_length() - 1)) if len(shingles) else 64
    bit = mix(shingles ^ GOLDEN) & np.uint64(size - 1)
    out = np.zeros(size // 64, np.uint64)
    np.bitwise_xor.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(grams(words, SHINGLE_WORDS)) if len(words) else np.zeros(0, np.uint64)


def _identity(s: np.ndarray) -> tuple[int, int]:
    """What equal sets share: 128 bits."""
    a, b = (mix(s ^ np.uint64(c)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(b, initial=np.uint64(0)).view(np.int64))


def _slot_counts(docs: DataFrame) -> np.ndarray:
    """How many segments of all texts fall in each slot. A task adds up one vector; the vectors are added up in a tree."""
    size = 1 << SLOT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            found = []
            for words in ascii_words(b.column(0)):
                s = shingle_set(words)
                for band, _ in bands(len(s)) if len(s) else ():
                    key, empty = segment_keys(s, band)
                    found.append(key[~empty] >> np.uint64(64 - SLOT_BITS))
            if found:
                total += np.bincount(np.concatenate(found).astype(np.int64), minlength=size)
        yield pa.RecordBatch.from_pydict({"n": [total.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for n in b.column(0):
                total += np.frombuffer(n.as_py(), np.int64)
        yield pa.RecordBatch.from_pydict({"n": [total.tobytes()]})

    texts = docs.select(text_of().alias("text"))
    parts, n = texts.mapInArrow(count, "n binary"), texts.rdd.getNumPartitions()
    while n > LAST:
        n = max(LAST, -(-n // FAN_IN))
        parts = parts.repartition(n).mapInArrow(add, "n binary")
    return sum((np.frombuffer(r.n, np.int64) for r in parts.collect()), np.zeros(size, np.int64))


def _sketched(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """row, doc_id, n, f1, f2, keys, dense of every document, written."""

    def chosen(s: np.ndarray) -> np.ndarray:
        out = []
        for band, d in bands(len(s)) if len(s) else ():
            key, empty = segment_keys(s, band)
            out.append(key[np.lexsort((key, slots[(key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], empty))[:d]])
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)

    def run(text):
        sets = [shingle_set(w) for w in ascii_words(text)]
        ids = [_identity(s) for s in sets]
        return None, [[len(s) for s in sets], [a for a, _ in ids], [b for _, b in ids], [chosen(s) for s in sets], [dense(s) for s in sets]]

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = with_python(src, [F.col("doc_id")], [F.col("text")], "n long, f1 long, f2 long, keys array<long>, dense array<long>", run)
    return cut(out.withColumnRenamed("k0", "doc_id").withColumn("row", F.monotonically_increasing_id()))


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small: a few numbers a row, BROADCAST_NODES rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df


def _shingles(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, shingles of the nodes given as (id, doc_id, f1, f2), read from their texts again."""
    key = lambda: F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("of")
    held = F.broadcast if nodes.count() <= BROADCAST_NODES else lambda x: x
    src = docs.select(key(), text_of().alias("text")).join(held(nodes.select(key())), "of", "left_semi")

    def run(text):
        sets = [shingle_set(w) for w in ascii_words(text)]
        ids = [_identity(s) for s in sets]
        return None, [[a for a, _ in ids], [b for _, b in ids], [s.view(np.int64) for s in sets]]

    out = with_python(src, [F.col("of")], [F.col("text")], "f1 long, f2 long, shingles array<long>", run).withColumnRenamed("k0", "of")
    return cut(out.join(held(nodes.select(key(), "f1", "f2", "id")), ["of", "f1", "f2"]).select("id", "shingles").dropDuplicates(["id"]))


def _passes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose dense sketches differ in no more bits than allowed."""
    x, y = (nodes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("dense").alias(f"d{c}")) for c in "ab")
    j = pairs.join(y, "b").join(x, "a")
    half = lambda d: F.zip_with(F.slice(d, F.lit(1), F.size(d) / 2), F.slice(d, F.size(d) / 2 + 1, F.size(d) / 2), lambda p, q: p.bitwiseXOR(q))
    fit = lambda d, e: F.when(F.size(d) > F.size(e), half(d)).otherwise(d)
    da, db = F.col("da"), F.col("db")
    off = F.aggregate(F.zip_with(fit(da, db), fit(db, da), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, z: s + F.coalesce(z, F.lit(0)))
    near = (F.greatest(F.size("da"), F.size("db")) <= 2 * F.least(F.size("da"), F.size("db"))) & (F.greatest("na", "nb") * PERCENT <= F.least("na", "nb") * 100)
    return j.filter(near & (off * (100 + PERCENT) <= (F.col("na") + F.col("nb")) * (100 - PERCENT))).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Only the texts in them are read again."""
    some = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    shingles = _shingles(docs, cut(some.select("id", "doc_id", "f1", "f2")))

    def run(sa, sb):
        keep = []
        for i, (x, y) in enumerate(zip(longs(sa), longs(sb))):
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= PERCENT * (len(x) + len(y) - common):
                keep.append(i)
        return keep, []

    sa, sb = (shingles.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    j = pairs.join(sb, "b").join(sa, "a")
    return with_python(j, [F.col("a"), F.col("b")], [F.col("sa"), F.col("sb")], "", run).withColumnsRenamed({"k0": "a", "k1": "b"})


def _distinct_buckets(shared: DataFrame) -> DataFrame:
    """(key, id, n) of one bucket of each set of members: near copies meet in scores of equal buckets, which hold the same pairs."""
    sign = [F.sum(F.shiftrightunsigned(F.xxhash64("id"), 32)).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    one = shared.groupBy("key").agg(F.first("n").alias("n"), *sign).groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return shared.join(one, "key", "left_semi")


def _placed(shared: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The members of buckets that still hold several components, with their component."""
    placed = shared.withColumn("comp", F.col("id")) if comps is None else shared.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    if comps is None:
        return placed
    open_ = placed.groupBy("key").agg((F.min("comp") != F.max("comp")).alias("open")).filter("open").select("key")
    return placed.join(open_, "key")


def _sized(x: str, y: str) -> Column:
    """Whether sets of these sizes can link."""
    return F.greatest(x, y) * PERCENT <= F.least(x, y) * 100


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _paying(placed: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The members of buckets for which another round of hubs may pay, and these buckets' number of components (key, parts): such as are too large for their
    pairs to be joined and, after a round on the buckets `before`, have fewer components than then. The others wait for the end, which compares all their pairs."""
    large = placed.filter(F.col("n") > PAIRED)
    parts = large.groupBy("key", "comp").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("parts"))
    if before is not None:
        parts = parts.join(before.withColumnRenamed("parts", "were"), "key").filter("parts < were").drop("were")
    parts = cut(parts)
    return large.join(parts.select("key"), "key", "left_semi"), parts


def _by_hubs(placed: DataFrame, hubs: int) -> DataFrame:
    """Pairs (a < b) of members and the best members of other components of their bucket: of the `hubs` first components."""
    reps = placed.groupBy("key", "comp").agg(F.max(F.struct("degree", (-F.col("id")).alias("x"), "size")).alias("c"))
    if hubs == 1:
        chosen = reps.groupBy("key").agg(F.max(F.struct("c.degree", "c.x", "comp", "c.size")).alias("c"))
        chosen = chosen.select("key", F.col("c.comp").alias("other"), (-F.col("c.x")).alias("rep"), F.col("c.size").alias("rep_size"))
    else:
        rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("c.degree"), F.desc("c.x")))
        chosen = reps.withColumn("rank", rank).filter(F.col("rank") <= hubs).select("key", F.col("comp").alias("other"), (-F.col("c.x")).alias("rep"), F.col("c.size").alias("rep_size"))
    pairs = placed.select("key", "id", "comp", "size").join(chosen, "key").filter((F.col("comp") != F.col("other")) & _sized("size", "rep_size"))
    return pairs.select(*_pair("id", "rep")).distinct()


def _finished(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a < b) of different components that share a bucket and pass the Hamming test: all of them, without a limit.

    Those of small buckets, a bounded number for each member, are joined. In a larger one each pair has a member outside the bucket's largest
    component; TILE of those at a time meet the bucket's members, TILE at a time."""
    few, placed = placed.filter(F.col("n") <= PAIRED).select("key", "id", "comp", "size"), placed.filter(F.col("n") > PAIRED)
    x, y = (few.withColumnsRenamed({"id": c, "comp": f"c{c}", "size": f"s{c}"}) for c in "ab")
    met = x.join(y, "key").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _sized("sa", "sb"))
    few = _passes(met.select("a", "b").distinct(), nodes)
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    main = parts.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("main"), F.sum("m").alias("size"))
    main = main.select("key", F.col("main.comp").alias("main"), F.ceil((F.col("size") - F.col("main.m")) / TILE).cast("int").alias("tx"), F.ceil(F.col("size") / TILE).cast("int").alias("ty"))
    rows = cut(placed.select("key", "id", "comp").join(main, "key").join(nodes.select("id", F.col("n").alias("size"), "dense"), "id"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    body = ["id", "comp", "main", "size", "dense"]
    y = rows.select("key", every("tx").alias("px"), own("ty").alias("py"), F.lit(False).alias("x"), *body)
    x = rows.filter("comp <> main").select("key", own("tx").alias("px"), every("ty").alias("py"), F.lit(True).alias("x"), *body)

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g[g["x"]], g[~g["x"]]
        out = [np.zeros((0, 2), np.int64)]
        yd, yi, yc, yn, ym = [np.asarray(d) for d in y["dense"]], y["id"].to_numpy(), y["comp"].to_numpy(), y["size"].to_numpy(), (y["comp"] == y["main"]).to_numpy()
        by_size = {s: np.flatnonzero([len(d) == s for d in yd]) for s in {len(d) for d in yd}}
        stacks = {s: np.stack([yd[i] for i in at]) for s, at in by_size.items()}
        for i, c, n, d in zip(x["id"], x["comp"], x["size"], x["dense"]):
            d = np.asarray(d)
            for s, at in by_size.items():
                if s == len(d):
                    off = stacks[s] ^ d
                elif s == 2 * len(d):
                    off = stacks[s][:, : len(d)] ^ stacks[s][:, len(d) :] ^ d
                elif 2 * s == len(d):
                    off = stacks[s] ^ (d[:s] ^ d[s:])
                else:
                    continue
                ok = (yc[at] != c) & (ym[at] | (yi[at] > i)) & (np.bitwise_count(off.view(np.uint64)).sum(axis=1, dtype=np.int64) * (100 + PERCENT) <= (yn[at] + n) * (100 - PERCENT))
                ok &= np.maximum(yn[at], n) * PERCENT <= np.minimum(yn[at], n) * 100
                out.append(np.stack([np.full(ok.sum(), i), yi[at][ok]], axis=1))
        found = np.sort(np.concatenate(out), axis=1)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]}, dtype="int64")

    return y.unionByName(x).groupBy("key", "px", "py").applyInPandas(compare, "a long, b long").unionByName(few).distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = _sketched(docs, _slot_counts(docs))
    same = ["f1", "f2", "n"]
    nodes = rows.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("id"))
    nodes = cut(nodes)
    # All but one row of each set are left out: by a broadcast where they are few.
    copies = rows.filter("n > 0").select("row", *same).join(nodes.select("id", *same), same).filter("row <> id").select("row")
    held = rows.filter("n > 0").join(_small(cut(copies)), "row", "left_anti").select(F.col("row").alias("id"), "keys", "dense")
    members = held.select(F.explode("keys").alias("key"), "id")
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(members.join(sizes, "key"))
    degree = shared.groupBy("id").agg(F.sum(F.col("n") - 1).alias("degree"))
    inside = cut(nodes.join(held.select("id", "dense"), "id").join(degree, "id"))
    shared = cut(_distinct_buckets(shared).join(inside.select("id", "degree", F.col("n").alias("size")), "id"))
    # Before the first round each member is a component.
    parts = shared.filter(F.col("n") > PAIRED).groupBy("key").agg(F.first("n").alias("parts"))
    comps, tested, late, turn, last = None, None, None, 1, False
    while True:
        placed = _placed(shared, comps)
        if last:
            pairs = _finished(placed, inside)
        else:
            if turn > 1:
                placed, parts = _paying(placed, parts)
            pairs = _passes(_by_hubs(placed, 1 if turn == 1 else HUBS * (turn - 1)), inside)
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = cut(_verified(pairs, docs, inside))
        found = new.count()
        ends, last = last, not last and turn > 1 and found <= YIELD * pairs.count()
        if last and found:  # few: they wait for those of the end
            late = new
        elif found or ends and late is not None:
            comps = merged(comps, new if late is None else new.unionByName(late))
        if ends:
            break
        turn += 1
    comps = comps if comps is not None else new.select(F.col("a").alias("id"), F.col("a").alias("comp"))  # empty
    whole = nodes.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = whole.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    classes = whole.join(least, "comp").select(*same, "component_id")
    out = rows.select("doc_id", *same).join(classes, same, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def sql() -> str:
    """The same for DuckDB over documents, with rows told apart by their id."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT w.doc_id, coalesce(len(s), 0) AS n FROM w LEFT JOIN s USING (doc_id)),
g AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS c, min(doc_id) AS node, any_value(s) AS s FROM s GROUP BY 1),
p AS (SELECT node, len(s) AS n, hash(x) AS x FROM (SELECT node, s, unnest(s) AS x FROM g)),
r AS (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY df, x) AS pos FROM r),
k AS (SELECT node, n, x FROM f WHERE pos <= n - (80 * n + 99) // 100 + 1 AND df > 1),
c AS (SELECT DISTINCT a.node AS a, b.node AS b, a.n AS na, b.n AS nb FROM k a JOIN k b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM (SELECT c.a, c.b, c.na + c.nb AS t, len(list_intersect(x.s, y.s)) AS i FROM c JOIN g x ON x.node = c.a JOIN g y ON y.node = c.b) WHERE 100 * i >= 80 * (t - i)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
t AS (SELECT node AS u, node AS v FROM g UNION SELECT t.u, e.v FROM t JOIN e ON e.u = t.v),
m AS (SELECT u AS node, min(v) AS component FROM t GROUP BY u)
SELECT w.doc_id, n.n::BIGINT AS n_shingles, CASE WHEN n.n = 0 THEN w.doc_id ELSE component END AS component_id
FROM w JOIN n USING (doc_id) LEFT JOIN (SELECT s.doc_id, node FROM s JOIN g ON g.c = md5(array_to_string(list_sort(s.s), chr(10)))) h USING (doc_id) LEFT JOIN m USING (node)"""
