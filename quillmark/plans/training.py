"""Queries of the core training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import nested, rejects
from quillmark.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejects(rejects.load_records(table(spark, d, "raw_post_lines")))


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.typed(rejects.load_records(table(spark, d, "raw_post_lines")))


def p2_reject_cells(spark: SparkSession, d: str) -> DataFrame:
    """Rejected records per reason and failing cell."""
    out = rejects.load_records(table(spark, d, "raw_post_lines")).where("reason IS NOT NULL")
    return out.select("reason", F.explode_outer("failing").alias("cell")).groupBy("reason", "cell").agg(F.count("*").alias("n_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found_paths(table(spark, d, "raw_records"))


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every row of every child table, with its links."""
    return nested.folded(nested.nodes(table(spark, d, "raw_records"))).drop("body")


def p4_merged_schema(spark: SparkSession, d: str) -> DataFrame:
    return nested.merged_schema(nested.folded(nested.nodes(table(spark, d, "raw_records"))))


def _child(kind: str):  # noqa: ANN202
    def child(spark: SparkSession, d: str) -> DataFrame:
        return nested.table_of(table(spark, d, "raw_records"), kind)

    child.__name__ = f"p4_{kind}"
    return child


CHILDREN = tuple(_child(k) for k in (*nested.OBJECT_KEYS, *nested.LIST_KEYS, "education"))
QUERIES = {f.__name__: f for f in (p2_found, p2_loaded, p2_reject_cells, p4_found, p4_nodes, p4_merged_schema, *CHILDREN)}
