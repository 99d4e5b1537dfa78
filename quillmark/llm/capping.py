"""At most so many records per contributor, the best by score kept.

One global range sort by contributor and descending score lays every contributor out as one
stretch. Prefix sums of the partition sizes turn places within partitions into exact global
positions; a contributor's start offset subtracted gives the rank. A contributor that holds a third
of all rows spans many range partitions, so no group is ever gathered in one task. Only one small
row per partition reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.session import cut


def contributor(url: str) -> Column:
    """Profile URL up to the first ``?`` or ``#``, without trailing slashes, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.col(url), "(?s)[?#].*$", ""), "/+$", ""))


def _layout(part: int, batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
    """First and last contributor of a sorted partition, its size and where its last one begins."""
    first = last = None
    size = begin = 0
    for batch in batches:
        who = batch.column(0)
        if not len(who):
            continue
        ends = pc.run_end_encode(who)
        values, stops = ends.values, ends.run_ends.to_pylist()
        if first is None:
            first = values[0].as_py()
        tail = values[-1].as_py()
        start = size + (stops[-2] if len(stops) > 1 else 0)
        if len(stops) > 1 or tail != last:
            begin = start
        last, size = tail, size + len(who)
    if first is None:
        return None
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([first], pa.string()), pa.array([last], pa.string()), pa.array([size], pa.int64()), pa.array([begin], pa.int64())], names=["part", "first", "last", "size", "begin"])


def ranked(df: DataFrame, key: str, by: Column, score: Column, parts: int | None = None) -> DataFrame:
    """(key, contributor, rank from 1) of every row whose contributor is not null or empty.

    Order within a contributor: score descending, nulls last, then ``key`` ascending (null first).
    Rows equal in all three get successive ranks. An empty table gives an empty result. Other columns
    are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), by.alias("who"), score.alias("score")).where("who IS NOT NULL AND who <> ''")
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = (F.col("who").asc(), F.col("score").desc_nulls_last(), F.col("key").asc())
    # The range bounds come from a sample: written once, so that every later pass sees one layout.
    laid = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("who", "key").withColumn("part", F.spark_partition_id()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal part
            for batch in batches:
                if part is None and len(batch):
                    part = batch.column(1)[0].as_py()
                yield batch
        out = _layout(0, seen())
        if out is not None:
            yield out.set_column(0, "part", pa.array([part], pa.int32()))

    layout = sorted(laid.select("who", "part").mapInArrow(measure, "part int, first string, last string, size long, begin long").collect(), key=lambda r: r["part"])
    carried: dict[int, int] = {}  # rows of the partition's first contributor that stand before it
    before, open_who, open_from = 0, None, 0
    for r in layout:
        carried[r["part"]] = before - open_from if r["first"] == open_who else 0
        if not (r["first"] == r["last"] == open_who):
            open_who, open_from = r["last"], before + r["begin"]
        before += r["size"]

    key_type = df.schema[key].dataType.simpleString()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = None
        count = 0
        for batch in batches:
            if not len(batch):
                continue
            if who is None:
                who, count = batch.column(0)[0].as_py(), carried[batch.column(2)[0].as_py()]
            ends = pc.run_end_encode(batch.column(0))
            ranks: list[int] = []
            at = 0
            for value, stop in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
                count = count if value == who else 0
                ranks.extend(range(count + 1, count + 1 + stop - at))
                count, who, at = count + stop - at, value, stop
            yield pa.record_batch([batch.column(1), batch.column(0), pa.array(ranks, pa.int64())], names=[key, "contributor", "rank"])

    return laid.select("who", "key", "part").mapInArrow(rank, f"`{key}` {key_type}, contributor string, rank long")


def beyond(df: DataFrame, key: str, by: Column, score: Column, most: int | None = 30, share: float | None = None) -> DataFrame:
    """Keys of the rows to drop so that each contributor keeps at most ``most`` rows, or at most
    ``share`` of all rows, whichever is less. Rows without a contributor are never dropped."""
    limit = most
    if share is not None:
        allowed = int(share * df.count())
        limit = allowed if most is None else min(most, allowed)
    return ranked(df, key, by, score).where(F.col("rank") > F.lit(limit)).select(key)


def found(df: DataFrame) -> DataFrame:
    return beyond(df, "row_id", contributor("profile_url"), F.col("reactions_total")).distinct()
