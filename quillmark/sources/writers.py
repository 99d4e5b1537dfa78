"""Tables to files: partitioned writes; only small reports pass the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a sheet below its header.
SHEET_ROWS = 1_048_575


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header in every part, quotes doubled; ``append`` adds parts."""
    df.write.mode("append" if append else "overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_table(df: DataFrame, name: str, buckets: int = 0, by: tuple[str, ...] = ()) -> None:
    """A catalog table in place of an indexed database file: bucketed and sorted by the lookup columns."""
    writer = df.write.mode("overwrite").format("parquet")
    if buckets and by:
        writer = writer.bucketBy(buckets, *by).sortBy(*by)
    writer.saveAsTable(name)


def write_batches(df: DataFrame, path: str, order: str, size: int = 1000) -> None:
    """One folder per batch of ``size`` rows in order (``batch=1`` and so on)."""
    from quillmark.operators.relational import batch_numbers

    batch_numbers(df, order, size).write.mode("overwrite").partitionBy("batch").options(header=True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value per line, nulls left out."""
    df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def keep_raw(df: DataFrame, path: str) -> DataFrame:
    """A copy of landed records as they came, before anything is read from them."""
    df.write.mode("append").parquet(path)
    return df


def report(df: DataFrame, most: int = 10_000) -> list[dict]:
    """A small report as rows for the driver; refuses anything larger."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    return [r.asDict(recursive=True) for r in rows]


def write_report(df: DataFrame, path: str, text: bool = False) -> None:
    """A small report as a JSON file, or as aligned text."""
    rows = report(df)
    with open(path, "w", encoding="utf-8") as out:
        if text:
            out.writelines("  ".join(f"{k}: {v}" for k, v in r.items()) + "\n" for r in rows)
        else:
            json.dump(rows, out, ensure_ascii=False, default=str, indent=1)


def _pieces(df: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """All rows in pieces of ``size``; one empty piece of an empty table."""
    rows = df.toLocalIterator()
    piece = list(islice(rows, size))
    while True:
        yield pd.DataFrame(piece, columns=df.columns, dtype=object)
        if not (piece := list(islice(rows, size))):
            return


def write_sheets(frames: dict[str, DataFrame], path: str) -> None:
    """Tables as sheets of one workbook, where openpyxl is installed; else one CSV file each. Rows beyond a
    sheet's bound go to further sheets (``name_2`` and so on)."""
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        for name, df in frames.items():
            for k, pdf in enumerate(_pieces(df, 100_000)):
                pdf.to_csv(f"{path}.{name}.csv", index=False, header=k == 0, mode="a" if k else "w")
        return
    with pd.ExcelWriter(path, engine="openpyxl") as book:
        for name, df in frames.items():
            for k, pdf in enumerate(_pieces(df, SHEET_ROWS), 1):
                more = f"_{k}" if k > 1 else ""
                pdf.to_excel(book, sheet_name=name[: 31 - len(more)] + more, index=False)


def ranked(df: DataFrame, by: str, order: str) -> DataFrame:
    """Position within a group, from 1, for display."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(order)))
