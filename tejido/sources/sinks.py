"""Writers: JSON lines, CSV, one-row JSON, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """One object per line, without the raw payload."""
    df.drop("raw").write.mode(mode).json(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def one_row_json(df: DataFrame) -> str:
    """A row such as a baseline, as text."""
    return df.select(F.to_json(F.struct("*"))).first()[0]


def run_started(df_of_runs: DataFrame, run_id: str, store: str, at: Column) -> DataFrame:
    """One audit row; a finish is another row, and the latest of a run counts."""
    spark = df_of_runs.sparkSession
    return spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(store).alias("store_slug"), at.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("long").alias("ok"), F.lit(None).cast("long").alias("failed"))


def run_finished(df_of_runs: DataFrame, run_id: str, ok: int, failed: int, at: Column) -> DataFrame:
    start = df_of_runs.where(F.col("run_id") == run_id).limit(1)
    return start.withColumns({"finished_at": at, "ok": F.lit(ok).cast("long"), "failed": F.lit(failed).cast("long")})
