"""Relational kit: first, latest and merged rows, guards over batches, overlaps, shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``; null keys are one key. Ties must be broken by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All members of groups of two and more; nulls are equal to each other."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n > 1").drop("__n")


def submitted_prefix(df: DataFrame, key: Column, order: str, n: int) -> DataFrame:
    """The first ``n`` distinct keys in order of first appearance; ``n`` = 0 gives none."""
    seen = df.select(key.alias("key"), order).where("key IS NOT NULL").groupBy("key").agg(F.min(order).alias("first_seen"))
    return seen.orderBy("first_seen").limit(n)


def batch_numbers(df: DataFrame, order: str, size: int) -> DataFrame:
    """Batch number by position, from 1. Positions come from per-range counts, so no global window is needed."""
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id() % (1 << 33))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"))
    # One row per range: the window sees the ranges, not the data.
    starts = sizes.select(F.col("__p"), (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__start"))
    return ranged.join(F.broadcast(starts), "__p").withColumn("batch", F.floor((F.col("__start") + F.col("__k")) / size) + 1).drop("__p", "__k", "__start")


def priority_merge(df: DataFrame, keys: list[str], priority: Column, order: str, tags: str, fill: list[str], rest: list[str]) -> DataFrame:
    """One row per key from several sources: ``rest`` from the row of least priority, ``tags`` as the
    sorted set joined by ``|``, each of ``fill`` as its first non-null value by priority. Blank keys drop."""
    rank = F.struct(priority.alias("p"), F.col(order).alias("o"))
    present = reduce(lambda a, b: a & b, [F.coalesce(F.trim(k) != "", F.lit(False)) for k in keys])
    return df.where(present).groupBy(*keys).agg(
        *[F.min_by(c, rank).alias(c) for c in rest],
        F.array_join(F.array_sort(F.collect_set(tags)), "|").alias(tags),
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in fill],
    )


def prefer_newer(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those rows of ``old`` whose key ``new`` has not; null keys of ``old`` stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both, only in a, only in b."""
    x = a.select(key).where(F.col(key).isNotNull()).distinct().withColumn("a", F.lit(1))
    y = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("b", F.lit(1))
    return x.join(y, key, "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def shares(df: DataFrame, key: str, digits: int = 4, with_null: bool = True) -> DataFrame:
    """Frequency and percentage of the total per value."""
    rows = df if with_null else df.where(F.col(key).isNotNull())
    total = rows.agg(F.count("*").alias("total"))
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", F.bround(F.col("n") * 100.0 / F.col("total"), digits).alias("pct"))  # one row of totals


def binned(df: DataFrame, value: Column, edges: list[int]) -> DataFrame:
    """Right-closed bins with counts, percentage and cumulative percentage; values beyond the edges
    count in the total only."""
    bin_ = reduce(lambda c, k: c.when((value > edges[k]) & (value <= edges[k + 1]), k), range(1, len(edges) - 1), F.when((value > edges[0]) & (value <= edges[1]), 0))
    counts = df.select(bin_.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    w = Window.orderBy("bin")
    total = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # A row per bin only: the window without partitions sees the bins, not the data.
    out = counts.withColumn("total", total).where("bin IS NOT NULL")
    return out.select("bin", "n", F.bround(F.col("n") * 100.0 / F.col("total"), 4).alias("pct"), F.bround(F.sum("n").over(w) * 100.0 / F.col("total"), 4).alias("cumulative_pct"))


def cap_guard(counts: DataFrame, batch: str, n: str, cap: int = 1000) -> DataFrame:
    """Batches up to and including the first that has a profile at exactly ``cap`` while no batch so far
    went beyond it. One row per batch reaches the window."""
    per = counts.groupBy(batch).agg(F.max(n).alias("most"), F.max(F.when(F.col(n) == cap, 1).otherwise(0)).alias("at_cap"))
    w = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = per.withColumn("running", F.max("most").over(w)).withColumn("stop", (F.col("at_cap") == 1) & (F.col("running") <= cap))
    stop = F.min(F.when(F.col("stop"), F.col(batch))).over(Window.partitionBy())
    return flagged.withColumn("stop_at", stop).select(batch, "most", "stop", F.coalesce(F.col(batch) <= F.col("stop_at"), F.lit(True)).alias("kept"))


def failure_guard(df: DataFrame, by: str, order: list[str], status: Column, limit: int = 5) -> DataFrame:
    """First row per ``by`` at which ``limit`` failures followed each other; neutral rows neither count
    nor reset. ``status``: 1 failure, 0 neutral, -1 reset."""
    seen = df.withColumn("__s", status).where("__s <> 0")
    w = Window.partitionBy(by).orderBy(*order)
    islands = seen.withColumn("__i", F.sum(F.when(F.col("__s") < 0, 1).otherwise(0)).over(w)).where("__s = 1")
    run = F.row_number().over(Window.partitionBy(by, "__i").orderBy(*order))
    hit = islands.withColumn("__r", run).where(F.col("__r") == limit)
    return first_per_key(hit, [by], *[F.col(c) for c in order]).select(by, *order)


def best_hits(hits: DataFrame, query: str, verified: Column, order: str, score: Column | None = None) -> DataFrame:
    """One hit per query: the first verified; else the first (or, with ``score``, the best above 0)."""
    rank = [verified.desc_nulls_last()]
    rows = hits
    if score is not None:
        rows = hits.where(verified | (score > 0))
        rank += [F.when(verified, 0).otherwise(-score)]
    return first_per_key(rows, [query], *rank, F.col(order).asc())


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, pct) of every column in one pass."""
    row = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns]))
    return row.select("__n", cells.alias("x")).select("x.column", "x.nulls", F.bround(F.col("x.nulls") * 100.0 / F.nullif(F.col("__n"), F.lit(0)), 4).alias("pct"))


def optionally(df: DataFrame, predicate: Column | None) -> DataFrame:
    """The rows of ``predicate``, all where none is asked for."""
    return df if predicate is None else df.where(predicate)


def search(df: DataFrame, column: str, text: str, most: int = 10) -> DataFrame:
    """Distinct values that hold ``text``, any case; where there are none, the first ``most`` by name that hold any of its
    words (a list of suggestions). One scan: both answers are looked for at once, and the better kind is kept."""
    low, words = F.lower(F.col(column)), text.lower().split()
    any_word = reduce(lambda a, b: a | b, [low.contains(w) for w in words], F.lit(False))
    kind = F.when(low.contains(text.lower()), 0).when(any_word, 1)
    found = df.select(F.col(column), kind.alias("__k")).where("__k IS NOT NULL").distinct()
    best = found.agg(F.min("__k").alias("__best"))
    kept = found.crossJoin(F.broadcast(best)).where("__k = __best")  # one row
    hits, suggested = kept.where("__k = 0"), kept.where("__k = 1").orderBy(column).limit(most)
    return hits.select(column).unionByName(suggested.select(column))


def choose(df: DataFrame, order: str, number: int = 1) -> DataFrame:
    """The row of that number in ``order``; the first by default."""
    return df.orderBy(order).offset(number - 1).limit(1)


def is_code(column: str, code: str) -> Column:
    return F.coalesce(F.col(column) == code, F.lit(False))


def clean_or_raw(df: DataFrame, column: str, suffix: str = "_clean") -> Column:
    return F.col(column + suffix if column + suffix in df.columns else column)


def stamped(stem: str, moment: Column) -> Column:
    return F.concat(F.lit(f"{stem}_"), F.date_format(moment, "yyyyMMdd_HHmmss"))


def latest_per_key(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    return first_per_key(df, keys, F.desc_nulls_last(time), F.desc(tie))


def overriding(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join; of columns both sides have, those of ``left`` stay."""
    return left.join(right.drop(*[c for c in left.columns if c != key]), key, "left")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def restored(*batches: DataFrame) -> DataFrame:
    """All batches as they were landed, in one table."""
    return reduce(DataFrame.unionByName, batches)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A reproducible sample of ``n`` rows by hash order of the key."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), F.col(key)).limit(n)


def verified_true(c: Column) -> Column:
    """True also where the flag came as text."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == "true", F.lit(False))
