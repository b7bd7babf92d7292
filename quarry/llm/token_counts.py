"""Token counts by a public tokenizer: Arrow batches in, lengths out.

White space is a safe boundary for the word tokenizer (it drops white space and never merges across it), so a text is split
there, however long it is, and a piece that has been seen is not encoded again. New pieces go to the library in batches
balanced by bytes.

Defined cases: a null text is empty (0 bytes, 0 tokens); every input row gives one row, repeated rows too; ids pass through unchanged, null
included; empty tables give an empty result; other columns are ignored. A very long text is split at its white space; what holds none (a
run of text of any length) goes to the library as one piece.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, with_python

#: Pieces whose length an executor's Python worker remembers; the memory starts anew beyond that.
MEMORY_PIECES = 600_000
#: Longest piece worth remembering, in characters.
MEMORY_CHARS = 64
#: Bytes of pieces handed to the library at once.
BATCH_BYTES = 1 << 20
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Token counts of texts; `encode` maps a list of strings to their token counts."""

    def __init__(self, encode):
        self.encode, self.known = encode, {}

    def _learn(self, pieces: list[str]) -> None:
        batch, size = [], 0
        for p in pieces:
            batch.append(p)
            size += len(p.encode("utf-8", "replace"))
            if size >= BATCH_BYTES:
                self.known.update(zip(batch, self.encode(batch)))
                batch, size = [], 0
        if batch:
            self.known.update(zip(batch, self.encode(batch)))

    def count(self, texts: list[str], n_bytes: list[int] | None = None) -> list[int]:
        out, start, size = [], 0, 0
        for i, n in enumerate(n_bytes or map(len, texts)):  # groups of texts of similar size, so that memory follows bytes and not rows
            size += n
            if size >= 4 * BATCH_BYTES or i == len(texts) - 1:
                out += self._group(texts[start : i + 1])
                start, size = i + 1, 0
        return out

    def _group(self, texts: list[str]) -> list[int]:
        if len(self.known) > MEMORY_PIECES:
            self.known.clear()
        # str.split() also cuts at the separators U+001C to U+001F, which the tokenizer does not drop: join on spaces it knows.
        split = [t.translate(SAFE).split(" ") for t in texts]
        known = self.known
        new = {p for pieces in split for p in pieces if p not in known}
        self._learn(list(new))
        out = [sum(map(known.__getitem__, pieces)) for pieces in split]
        for p in new:
            if len(p) > MEMORY_CHARS:
                del known[p]
        return out


#: White space at which a text may be cut.
SAFE = {9: " ", 10: " ", 13: " "}


@functools.cache
def word_counter(path: str) -> Counter:
    """The counter of a file, kept by the worker with what it has learned."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return Counter(lambda batch: [len(e.ids) for e in t.encode_batch_fast(batch, add_special_tokens=False)])


def token_counts(df: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `df`. `path`: a tokenizers file that every executor has."""
    name = path

    def run(texts, n_bytes):
        counter = word_counter(name or tokenizer_path())
        return None, [counter.count(texts.to_pylist(), n_bytes.to_pylist())]

    size = F.octet_length(text_of()).cast("long")
    out = with_python(df, [F.col("doc_id").cast("long"), size], [text_of(), size], "n_tokens long", run).withColumnsRenamed({"k0": "doc_id", "k1": "n_bytes"})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
