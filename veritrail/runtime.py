"""Session helpers shared by every subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


ARROW_ROWS = 2000  # rows of a batch between the JVM and Python: texts are long, and both sides hold a batch per task


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where the driver can, and keep Arrow batches small."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, known) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ARROW_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where it is unset and Spark runs in one process (local mode, as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='veritrail-')}"
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/veritrail-{uuid.uuid4().hex[:12]}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.veritrail_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and nothing reads any more."""
    path = getattr(df, "veritrail_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mounted_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for files that tasks open themselves; the shared folder must be mounted on all machines under its path."""
    found = shared_dir(spark)
    if "://" in found and not found.startswith("file://") or ":" in found.split("/")[0] and not found.startswith("file:"):
        raise ValueError("spark.checkpoint.dir isn't a mounted folder: give a ledger of your own")
    return f"{found.removeprefix('file://').removeprefix('file:').rstrip('/')}/veritrail-{uuid.uuid4().hex[:12]}/{name}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so only when the driver's references to them are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
