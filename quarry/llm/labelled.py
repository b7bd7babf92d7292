"""Bounded samples of labelled texts and the fold of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


def fold(n: int) -> Column:
    """crc32(doc_id as text) mod n; of a null id, that of the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, n: int, held: int, per_class: int) -> DataFrame:
    """(text, y) of at most `per_class` labelled ids of each label outside the held-out fold, taken by the MD5 of the id, one row each: of an id that stands in
    several rows the text of the least hash.

    Because the sample of labels is bounded, it is broadcast to the documents; only the texts of the sample move, and of repeated rows one a task."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(n) != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = [F.md5(F.col("doc_id").cast("string")), "doc_id"]
    some = known.filter("y = 0").orderBy(*order).limit(per_class).unionByName(known.filter("y = 1").orderBy(*order).limit(per_class))
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("t.text", "y")
