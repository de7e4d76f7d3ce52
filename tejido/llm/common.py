"""What the training-data operators share: reading tables, cutting lineage, id digests."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, as in local tests, a temporary folder stands in; one JVM holds every executor then.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints/{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(_remove, folder.removeprefix("file://"))
    return folder


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/tables/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives freed memory of a Python worker back to the system, where the C library can: workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo divisor."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get texts in batches of so many rows, which bounds their memory; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty), whatever further columns docs has."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
