"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, html_text, jaccard_join, license_scan, mixing, near_duplicates, quality_classifier, quality_rules, secrets_scan, spelling_variants, token_counts, toxicity
from .common import bounded_batches, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and benchmark item in it."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its class."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.secret_digest(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell's share, its inclusion probability and whether it is drawn."""
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, topic=mixing.topics(docs), columns=["doc_id", "source", "lang"])
    return out.select("doc_id", "source", "lang", "topic_class", "n_tokens", "cell_share", "keep_probability", "sampled")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_near_duplicates,
        op3_html_text,
        op4_secrets,
        op5_quality_classifier,
        op6_quality_rules,
        op7_toxicity,
        op8_mixing,
        op9_token_counts,
        op10_license_scan,
        op11_spelling_variants,
        op12_jaccard_join,
        op13_filter_audit,
    )
}

ORACLES = {"op6_quality_rules": quality_rules.sql(), "op10_license_scan": license_scan.sql(), "op12_jaccard_join": jaccard_join.sql(), "op13_filter_audit": filter_audit.sql()}


# Stages of the corpus pipeline: (spark, docs, sf_dir) -> the documents that stay, with the columns of documents. Each states what it does with
# odd rows through its operator; in all of them ids, null ids and further columns pass through unchanged, repeated rows are as many
# rows (but in the near-duplicate stage, which keeps one), null and empty texts count as empty, and an empty table stays empty.


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good. Without labels every score is 0.5 and none stays."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; all null and empty texts are one class."""
    bounded_batches(spark)
    return near_duplicates.keep_one(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; without a benchmark, all."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and n_chars that of the new text; a null text stays null, with its n_chars."""
    bounded_batches(spark)
    out = secrets_scan.redact(docs)
    n = F.coalesce(F.char_length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[n.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents, with their tokens, cell and inclusion probability."""
    return mixing.mix(docs, topic=mixing.topics(docs)).filter("sampled").drop("sampled")
