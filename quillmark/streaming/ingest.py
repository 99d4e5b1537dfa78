"""Incremental ingest of landed JSON lines: append-only, resumable, with a ledger of batches.

The checkpoint takes the place of hand-kept counters: a run continues where the last one stopped,
and a file that was read is not read again. Failed batches are not marked done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LANDED = "record_id long, record_kind string, payload string, landed_at timestamp"


def landed_stream(spark: SparkSession, folder: str, schema: str = LANDED, files_per_batch: int = 100) -> DataFrame:
    """New JSON-lines files of a landing folder, some per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest(spark: SparkSession, folder: str, bronze: str, ledger: str, checkpoint: str, schema: str = LANDED) -> StreamingQuery:
    """Append everything landed since the last run to ``bronze`` and a row per micro-batch to ``ledger``,
    then stop. The batch id is a column of both, so a batch that is replayed after a failure replaces
    its own rows."""
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id)).persist()
        try:
            rows.write.mode("overwrite").partitionBy("batch_id").parquet(bronze)
            done = rows.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("payload").isNotNull()).alias("found"), F.max("landed_at").alias("ts"))
            done.write.mode("overwrite").partitionBy("batch_id").parquet(ledger)
        finally:
            rows.unpersist()

    return landed_stream(spark, folder, schema).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, ledger: str) -> DataFrame:
    """Batches done, rows and payloads so far."""
    return spark.read.parquet(ledger).agg(F.count("*").alias("batches"), F.sum("total").alias("total"), F.sum("found").alias("found"), F.max("ts").alias("latest"))


def counts_stream(stream: DataFrame, hours: int = 24, late: str = "7 days") -> DataFrame:
    """Records per kind and day of landing; records later than ``late`` are not counted any more."""
    return stream.withWatermark("landed_at", late).groupBy(F.window("landed_at", f"{hours} hours"), "record_kind").count()
