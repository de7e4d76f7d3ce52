"""Structured Streaming over landed observations: windowed counts, exactly-once appends, gated upserts, rate control."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import gate, validate
from ..operators.storage import changed


def landed(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder, a bounded number at a time; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def window_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and sum of value by window and kind; rows later than the watermark are left out, and state is let go of."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), by, "n", "total")


def once(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark: an append that repeats do not double."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def upsert_batches(products: DataFrame, read_existing: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame, int], None], checkpoint: str):
    """Runs each micro-batch through the gate and hands what changed, with the table it was compared with, to `write`."""

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        gate(validate(batch))
        existing = read_existing()
        write(changed(batch, existing), existing, number)

    return products.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Fixed values of the controller: answers that mean stress, healthy answers before a step up, latency guard.
STRESS = (429, 500, 502, 503, 504, 408)
PROBE, GUARD, START, LEAST, MOST, COOLDOWN = 40, 2.5, 4, 1, 32, 5.0


def control(state: dict, status: int, latency: float, retry_after: float | None = None) -> dict:
    """One answer of a host: a step up after PROBE healthy ones unless latency has grown, half under stress."""
    s = dict(state) if state else {"concurrency": START, "streak": 0, "best": None, "recent": [], "ok": 0, "stressed": 0, "failed": 0, "peak": START, "cooldown": 0.0}
    if status in STRESS:
        s["stressed"] += 1
        s["streak"] = 0
        s["concurrency"] = max(LEAST, s["concurrency"] // 2)
        s["cooldown"] = retry_after or COOLDOWN
    elif status <= 0 or status >= 400:
        s["failed"] += 1
        s["streak"] = 0
    else:
        s["ok"] += 1
        s["streak"] += 1
        s["recent"] = [*s["recent"], latency][-PROBE:]
        s["best"] = latency if s["best"] is None else min(s["best"], latency)
        if s["streak"] >= PROBE and s["concurrency"] < MOST:
            median = sorted(s["recent"])[len(s["recent"]) // 2]
            if not (s["best"] and median > s["best"] * GUARD):
                s["concurrency"] += 1
                s["peak"] = max(s["peak"], s["concurrency"])
            s["streak"] = 0
    return s


def rate_controller(answers: DataFrame, host: str = "host", order: str = "ts", status: str = "status", latency: str = "latency", tie: str | None = None) -> DataFrame:
    """The controller's state per host after all its answers, in order of `order` and `tie`.

    Answers of one host are a sequence by nature. They are sorted by Spark and come to the task in batches, so that what a
    task holds is the state of one host and one batch, however many answers a host has.
    """
    import pandas as pd

    def run(batches):
        now, s = None, {}
        done = lambda: pd.DataFrame([{"host": now, "concurrency": s["concurrency"], "peak": s["peak"], "ok": s["ok"], "stressed": s["stressed"], "failed": s["failed"]}])
        for pdf in batches:
            for name, code, took in zip(pdf["_host"], pdf["_status"], pdf["_latency"]):
                if name != now:
                    if s:
                        yield done()
                    now, s = name, {}
                s = control(s, int(code), float(took))
        if s:
            yield done()

    tied = F.col(tie) if tie else F.xxhash64(*answers.columns)
    rows = answers.select(F.col(host).cast("string").alias("_host"), F.col(order).alias("_order"), tied.alias("_tie"), F.col(status).cast("int").alias("_status"), F.col(latency).cast("double").alias("_latency"))
    return rows.repartition("_host").sortWithinPartitions("_host", "_order", "_tie").mapInPandas(run, "host string, concurrency int, peak int, ok long, stressed long, failed long")


def rate_controller_stream(answers: DataFrame, host: str = "host", status: str = "status", latency: str = "latency") -> DataFrame:
    """The same as a stream, with each host's state kept between micro-batches."""
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        s = json.loads(state.get[0]) if state.exists else {}
        for pdf in frames:
            for code, took in zip(pdf[status], pdf[latency]):
                s = control(s, int(code), float(took))
        state.update((json.dumps(s),))
        yield pd.DataFrame([{"host": key[0], "concurrency": s["concurrency"], "ok": s["ok"], "stressed": s["stressed"], "failed": s["failed"]}])

    return answers.groupBy(host).applyInPandasWithState(step, "host string, concurrency int, ok long, stressed long, failed long", "state string", "update", GroupStateTimeout.NoTimeout)
