"""All core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.plans import linking, quality, registry, relations, rosters, sentiment, streams, training


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.sentiment_by_company(spark, d)


def queries() -> dict[str, registry.Query]:
    assert linking and quality and relations and rosters and streams  # imported for the queries they register
    return dict(registry.QUERIES) | dict(training.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
