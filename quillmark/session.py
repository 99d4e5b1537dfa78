"""Session, table loading and the few physical helpers every operator shares."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillmark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores if str(cores).isdigit() else 8))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not on their path: sent once by the
    driver's own file server, so nothing has to be installed on the executors."""
    home = Path(__file__).resolve().parent
    context = spark.sparkContext
    on_path = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(home.parent) in on_path or getattr(context, "_quillmark_shipped", False):
        return
    context._quillmark_shipped = True
    folder = tempfile.mkdtemp(prefix="quillmark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(home.rglob("*")):
            if file.is_file() and "__pycache__" not in file.parts:
                z.write(file, file.relative_to(home.parent))
    target = Path(folder, "quillmark.zip")
    target.write_bytes(buffer.getvalue())
    context.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One landed table. Parquet carries its schema, so nothing is inferred from values."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Even out an input of too few splits before CPU-heavy work.

    A single small file is one split and would run on one core. Inputs that fill two splits a core by
    the plan's own estimate of their size (any input of real size) are left alone, so no shuffle is
    added at scale; reading the estimate runs no job.
    """
    spark = df.sparkSession
    ship(spark)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 2 * cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df
    return df.repartition(per_core * cores)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where that
    setting is absent on a local master, as in tests. A cluster without the setting is an error."""
    named = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="quillmark-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage; survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_anew(df: DataFrame) -> DataFrame:
    """``cut`` for loops: also forgets the plan's estimate of the size, whose digits joins multiply in every round."""
    spark, held = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)
