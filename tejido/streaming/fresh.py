"""Which products are fresh, as a stream: a product leaves when its store's run came to an end without seeing it.

Sightings (store_slug, product_uid, at) and ends of runs (store_slug, null, at) come in one stream, in any order within the
watermark. A run's end takes effect by an event-time timer when the watermark reaches it, so that sightings that come late
for it are there first. Then all products of the store that were last seen more than `hours` before the run leave. A
product that is seen again enters again.

Keys are a store and a bucket of its products, and an end goes to all buckets of its store: a store with very many products is
so many pieces of state. State is what is fresh and the last run, so it is let go of with the products that leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 16
OUT = "store_slug string, product_uid string, event string, at timestamp"


class Freshness(StatefulProcessor):
    def __init__(self, hours: int) -> None:
        self.slack = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "product_uid string", "at long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set(self.handle.listTimers())
        for pdf in rows:
            entered = []
            for uid, at in zip(pdf["product_uid"], pdf["ms"].astype("int64")):
                at = int(at)
                if uid is None or pd.isna(uid):
                    if at not in due:
                        due.add(at)
                        self.handle.registerTimer(at)
                    continue
                last = self.last.get()[0] if self.last.exists() else None
                if last is not None and at < last - self.slack:
                    continue
                before = self.seen.getValue((uid,)) if self.seen.containsKey((uid,)) else None
                if before is None:
                    entered.append((uid, "in", at))
                if before is None or at > before[0]:
                    self.seen.updateValue((uid,), (at,))
            yield self._out(key, entered)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.last.exists() or self.last.get()[0] < at:
            self.last.update((at,))
            gone = [uid for (uid,), (seen,) in self.seen.iterator() if seen < at - self.slack]
            for uid in gone:
                self.seen.removeKey((uid,))
            yield self._out(key, [(uid, "out", at) for uid in gone])

    def _out(self, key, rows: list[tuple]) -> pd.DataFrame:
        at = pd.to_datetime(pd.Series([r[2] for r in rows], dtype="int64"), unit="ms")
        said = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({"store_slug": said([key[0]] * len(rows)), "product_uid": said([r[0] for r in rows]), "event": said([r[1] for r in rows]), "at": at})

    def close(self) -> None:
        pass


def comings_and_goings(events: DataFrame, hours: int = 12, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """OUT: "in" when a product becomes fresh, "out" when it leaves (at: the run that it was not seen in). Needs the RocksDB state store.

    events: a stream (store_slug, product_uid, at); a null product_uid is the end of a store's run. Times are UTC.
    """
    own = F.array(F.pmod(F.xxhash64("product_uid"), F.lit(buckets)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))
    timed = events.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    keyed = timed.withColumn("bucket", F.explode(F.when(F.col("product_uid").isNull(), every).otherwise(own)))
    return keyed.groupBy("store_slug", "bucket").transformWithStateInPandas(Freshness(hours), OUT, "append", "eventtime")


def fresh_now(changes: DataFrame) -> DataFrame:
    """store_slug, product_uid of what is fresh after all comings and goings."""
    last = changes.groupBy("store_slug", "product_uid").agg(F.count_if(F.col("event") == "in").alias("i"), F.count_if(F.col("event") == "out").alias("o"))
    return last.where("i > o").select("store_slug", "product_uid")
