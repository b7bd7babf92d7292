"""Quality by compression: two zstandard dictionaries, built from good and from bad labelled text.

A text is cut into pieces of a few kilobytes (so that the dictionary weighs on all of it), each piece is compressed with
either dictionary, and the difference of the sizes, normalised by the length, is calibrated to a probability.

The dictionaries and the calibration are fitted on a bounded sample of the labelled rows (`PER_CLASS` documents, `PIECES`
pieces of each class); every text is scored whole.

Defined cases: null and empty texts get the score of zero difference; without labels (an empty table, null labels or ids) every score is
0.5; a repeated label counts once, of contradicting ones the higher; every input row gives one row, repeated rows too; very long texts are scored
whole, piece by piece; ids pass through unchanged, null included; empty tables give an empty result; other columns are ignored (`score` and
`keep_good` keep them).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import fit_logistic, probability
from .common import columns_of, cut, renamed, text_of, with_python
from .labelled import fold, sample

PER_CLASS, PIECES = 3000, 4000
#: Least score of a text that counts as good.
THRESHOLD = 0.7
PIECE_BYTES, DICT_BYTES, LEVEL = 2048, 112 * 1024, 3


def pieces_of(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]


class Sizes:
    """Compressed sizes of texts under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        def of(d: bytes):
            p = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
            if not d:
                return z.ZstdCompressor(compression_params=p).compress
            shared = z.ZstdCompressionDict(d)
            shared.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(dict_data=shared, compression_params=p).compress

        self.good, self.bad = of(good), of(bad)

    def features(self, text: str) -> list[float]:
        """Normalised size difference (positive where good text explains it better), the same weighted by the root of the
        length, shortness (little evidence), and the logarithm of the better compression ratio (endless repetition)."""
        data = text.encode("utf-8", "replace")
        g = b = 0
        for p in pieces_of(data):
            g += len(self.good(p))
            b += len(self.bad(p))
        d = (b - g) / max(b, g, 1)
        return [d, d * min(8.0, len(data) ** 0.5 / 8), 64 / (64 + len(data)), min(0.0, math.log((min(g, b) + 16) / (len(data) + 16)))]


#: Numbers of features.
N_FEATURES = 4


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))

    def scores(self, texts: list[str]) -> np.ndarray:
        sizes = Sizes(self.good, self.bad)
        return probability(np.array([sizes.features(t) for t in texts]).reshape(-1, N_FEATURES), self.weights)


def train(docs: DataFrame, labels: DataFrame, n: int = 4, held: int = 2, per_class: int = PER_CLASS, pieces: int = PIECES) -> Model:
    """Fit on a bounded sample: half of its documents build the dictionaries, the other half calibrates."""
    # Read once from the corpus: the dictionaries and the calibration both use it.
    rows = cut(sample(docs, labels, "quality", n, held, per_class).withColumn("half", F.crc32(F.col("text").cast("binary")) % 2))
    cut_up = F.expr(f"transform(sequence(1, greatest(1, ceil(char_length(text) / {PIECE_BYTES}))), i -> substring(text, int((i - 1) * {PIECE_BYTES} + 1), {PIECE_BYTES}))")
    some = rows.filter("half = 0").select("y", F.explode(cut_up).alias("piece"))
    got = {y: [r.piece.encode() for r in some.filter(F.col("y") == y).orderBy(F.md5("piece"), "piece").limit(pieces).collect()] for y in (0, 1)}
    model = Model(_dictionary(got[1]), _dictionary(got[0]))
    sizes = (model.good, model.bad)

    def run(texts):
        s = Sizes(*sizes)
        return None, [[s.features(t) for t in texts.to_pylist()]]

    seen = with_python(rows.filter("half = 1"), [F.col("y")], [F.col("text")], "x array<double>", run).withColumnRenamed("k0", "y").toPandas()
    if seen["y"].nunique() > 1:
        model.weights = fit_logistic(np.stack(seen["x"].to_list()), seen["y"].to_numpy())
    return model


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    import zstandard as z

    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    try:
        return z.train_dictionary(size, samples).as_bytes() if size >= 1024 else b"".join(samples)[-DICT_BYTES:]
    except z.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def _scored(docs: DataFrame, model: Model, keep: list) -> DataFrame:
    def run(texts):
        return None, [model.scores(texts.to_pylist())]

    return with_python(docs, keep, [text_of()], "score double", run)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with quality_score and quality_predicted (in place of columns of these names); the other columns stay."""
    own = ("quality_score", "quality_predicted")
    out = renamed(_scored(docs, model, columns_of(docs)), docs, F.col("score").alias("\u0001"))
    return out.select(*[c for c, n in zip(columns_of(docs), docs.columns) if n not in own], F.col("\u0001").alias(own[0]), (F.col("\u0001") >= threshold).cast("int").alias(own[1]))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, as they are."""
    return renamed(_scored(docs, model, columns_of(docs)).filter(F.col("score") >= threshold), docs)


def quality_scores(docs: DataFrame, labels: DataFrame, n: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = _scored(docs, train(docs, labels, n, held), [F.col("doc_id").cast("long"), fold(n) == held])
    return out.select(F.col("k0").alias("doc_id"), F.col("k1").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
