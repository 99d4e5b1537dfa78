"""Queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import capping, encoding, languages, leakage, linkage, mojibake, pii, variants
from quillmark.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.found(table(spark, d, "posts_combined"))


def p1_people(spark: SparkSession, d: str) -> DataFrame:
    """Every typed person name that has other spellings, with its entity."""
    return variants.entities(variants.mentions(table(spark, d, "posts_combined"), ("person",))).drop("kind")


def p1_companies(spark: SparkSession, d: str) -> DataFrame:
    return variants.entities(variants.mentions(table(spark, d, "posts_combined"), ("company",))).drop("kind")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "posts_combined"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Fields with personal information, before and after, with the spans replaced."""
    return pii.detect(table(spark, d, "posts_combined"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found(table(spark, d, "posts_combined"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair(table(spark, d, "posts_combined"), "row_id", mojibake.FIELDS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return capping.found(table(spark, d, "posts_combined"))


def p6_ranks(spark: SparkSession, d: str) -> DataFrame:
    return capping.ranked(table(spark, d, "posts_combined"), "row_id", capping.contributor("profile_url"), F.col("reactions_total"))


def p6_share(spark: SparkSession, d: str) -> DataFrame:
    """Rows beyond one percent of all rows per contributor."""
    return capping.beyond(table(spark, d, "posts_combined"), "row_id", capping.contributor("profile_url"), F.col("reactions_total"), most=None, share=0.01)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.found(table(spark, d, "all_linkedin_urls"), table(spark, d, "all_people"))


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Proposed pairs with their confidence and agreement pattern."""
    return linkage.match(table(spark, d, "all_linkedin_urls"), table(spark, d, "all_people"))


def p7_calibration(spark: SparkSession, d: str) -> DataFrame:
    return linkage.calibration(table(spark, d, "all_linkedin_urls"), table(spark, d, "all_people"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return encoding.round_trip(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: documents that give it away, the longest reproduction and answers found near it."""
    leaks = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_passages"))
    return leaks.groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_documents"),
        F.max("n_common").alias("most_words"),
        F.max("cosine").alias("nearest"),
        F.count_if("answer_near").alias("n_with_answer"),
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.found(table(spark, d, "documents"))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.per_document(table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.detect(table(spark, d, "documents"))


_CONTRIBUTOR = "lower(regexp_replace(regexp_replace(profile_url, '[?#].*$', '', 's'), '/+$', ''))"
_RANKED = f"""SELECT row_id, contributor, row_number() OVER (PARTITION BY contributor ORDER BY reactions_total DESC NULLS LAST, row_id) AS rank
FROM (SELECT row_id, reactions_total, {_CONTRIBUTOR} AS contributor FROM posts_combined) WHERE contributor <> ''"""
SQL = {
    "p6_found": f"SELECT row_id FROM ({_RANKED}) WHERE rank > 30",
    "p6_ranks": _RANKED,
    "p6_share": f"SELECT row_id FROM ({_RANKED}) WHERE rank > (SELECT CAST(floor(0.01 * count(*)) AS BIGINT) FROM posts_combined)",
    "p8_round_trip": "SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS n_signs, true AS same FROM documents",
}
QUERIES: tuple[Query, ...] = (
    p1_found, p1_people, p1_companies, p3_found, p3_redacted, p5_found, p5_repaired, p6_found, p6_ranks, p6_share, p7_found, p7_matches, p7_calibration, p8_ids, p8_round_trip, p9_found, p9_items,
    p10_found, p10_documents, p10_segments,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
