"""Landed files as tables: explicit schemas, strict quoting, one reader per format."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that untyped readers take for missing values.
MISSING_TEXT = ("NA", "N/A", "null", "NULL", "None", "nan", "NaN", "")


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, tolerant: bool = True, missing: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header; quotes doubled inside quotes, line breaks inside quotes. ``tolerant`` skips rows
    that do not fit, else they fail the read. Ids stay text as the schema says. ``missing``: further
    strings that stand for null in every text column."""
    reader = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED" if tolerant else "FAILFAST")
    df = reader.csv(path)
    if missing:
        df = df.select(*[F.when(~F.col(f.name).isin(*missing), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])
    return df


def read_batches(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """All files of a pattern as one table, with ``file_name`` to order by."""
    return read_csv(spark, pattern, schema).withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A record per line; blank and broken lines are left out."""
    corrupt = "_broken"
    full = T.StructType([*(T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields, T.StructField(corrupt, T.StringType())])
    df = spark.read.schema(full).option("columnNameOfCorruptRecord", corrupt).json(path).cache()
    return df.where(F.col(corrupt).isNull()).drop(corrupt)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that is one array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_records(spark: SparkSession, folder: str, stem: str, schema: T.StructType | str) -> DataFrame:
    """``stem.jsonl`` if it is there, else ``stem.json``."""
    lines = os.path.join(folder, f"{stem}.jsonl")
    return read_json_lines(spark, lines, schema) if exists(spark, lines) else read_json_array(spark, os.path.join(folder, f"{stem}.json"), schema)


def read_sql(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """A query on a relational source through JDBC; the source filters what the plan can push down."""
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return bool(fs.exists(where))


def latest_file(spark: SparkSession, pattern: str, by: str = "time") -> str:
    """The newest file of a pattern, by modification time or by name."""
    fs, where = _fs(spark, pattern)
    found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.globStatus(where) or []]
    if not found:
        raise FileNotFoundError(pattern)
    return max(found, key=(lambda x: x) if by == "time" else (lambda x: x[1]))[1]


def first_available(spark: SparkSession, *names: str) -> DataFrame:
    """The first table of a chain that is there."""
    for name in names:
        if spark.catalog.tableExists(name):
            return spark.table(name)
    raise LookupError(", ".join(names))


def describe_tables(spark: SparkSession, like: str = "*") -> DataFrame:
    """(table, column, type, position) of the catalog's tables."""
    rows = [(t.name, c.name, c.dataType, k) for t in spark.catalog.listTables(pattern=like) for k, c in enumerate(spark.catalog.listColumns(t.name), 1)]
    return spark.createDataFrame(rows, "table string, column string, type string, position int")


def detect_column(df: DataFrame, candidates: tuple[str, ...], contains: tuple[str, ...] = ()) -> str:
    """The first candidate there is, any case; else the first column whose name holds all of ``contains``."""
    low = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in low:
            return low[c.lower()]
    for name, c in low.items():
        if contains and all(x in name for x in contains):
            return c
    raise LookupError(f"none of {candidates} among {df.columns}")


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def with_defaults(df: DataFrame, **defaults: object) -> DataFrame:
    """Adds the columns that are not there yet."""
    return df.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in df.columns})


def existing(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])
