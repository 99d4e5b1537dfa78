"""The streaming ingest as a batch-callable query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.plans.registry import query
from quillmark.session import checkpoint_dir, table
from quillmark.streaming import ingest


@query("SELECT record_kind, count(*) AS n, count(payload) AS with_payload FROM raw_records GROUP BY 1")
def streamed_records(spark: SparkSession, d: str) -> DataFrame:
    """Landed records written as JSON lines, taken up by the stream in one run, then counted."""
    home = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, d, "raw_records").select("record_id", "record_kind", "payload", "landed_at").write.json(f"{home}/landing")
    run = ingest.ingest(spark, f"{home}/landing", f"{home}/bronze", f"{home}/ledger", f"{home}/checkpoint")
    run.awaitTermination()
    return spark.read.parquet(f"{home}/bronze").groupBy("record_kind").agg(F.count("*").alias("n"), F.count("payload").alias("with_payload"))
