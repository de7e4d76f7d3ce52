"""A crawl that goes on where it stopped.

Addresses come from a streaming source whose offset is a place in the shop's list; a batch is a bounded number of them, and the
checkpoint knows which batches are done. Addresses that were listed before, in this batch or any earlier one, are told by keyed state and
aren't fetched again. Pages are fetched by tasks. What a batch has fetched is written under its number, so a batch that is run
again after a crash replaces its own rows; batches that were done aren't run again.

Lister and fetcher are given by name (`module:function`): lister(start, end) gives the addresses at these places of a list that
may grow but keeps its order; fetcher(url) gives (status, body). An answer of stress stays pending, other failures are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..sources.paged import _named
from .price_stream import STRESS

FETCHED = "at long, url string, status int, body string, error string"


class AddressReader(SimpleDataSourceStreamReader):
    """Lists a batch of addresses: strings, `batch` at most."""

    def __init__(self, options):
        self.lister, self.batch = options["lister"], int(options.get("batch", "250"))

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _listed(self, start: int, end: int) -> list[tuple[int, str]]:
        return [(start + i, url) for i, url in enumerate(_named(self.lister)(start, end))]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._listed(start["at"], start["at"] + self.batch)
        return iter(rows), {"at": start["at"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._listed(start["at"], end["at"]))

    def commit(self, end: dict) -> None:
        pass


class AddressSource(DataSource):
    """spark.readStream.format("shop_addresses").options(lister="module:function", batch=250)"""

    @classmethod
    def name(cls) -> str:
        return "shop_addresses"

    def schema(self) -> str:
        return "at long, url string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return AddressReader(self.options)


def fetched(addresses: DataFrame, fetcher: str) -> DataFrame:
    """FETCHED: one page for each address; what a fetcher raises is a row with status 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = _named(fetcher)
        for b in batches:
            out = []
            for url in b.column("url").to_pylist():
                try:
                    status, body = fetch(url)
                    out.append((status, body, None))
                except Exception as e:
                    out.append((0, None, f"{type(e).__name__}: {e}"))
            status, body, error = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("url"), pa.array(status, pa.int32()), pa.array(body, pa.string()), pa.array(error, pa.string())], ["at", "url", "status", "body", "error"])

    return addresses.mapInArrow(run, FETCHED)


def crawl(spark: SparkSession, folder: str, lister: str, fetcher: str, batch: int = 250, tasks: int = 8) -> StreamingQuery:
    """Starts the crawl, or goes on with it: the folder holds its progress and what it has fetched."""
    spark.dataSource.register(AddressSource)
    listed = spark.readStream.format("shop_addresses").options(lister=lister, batch=batch).load()
    new = listed.dropDuplicates(["url"]).repartition(tasks, "url")

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/pages/batch={number}")

    return fetched(new, fetcher).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").start()


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{FETCHED}, batch int").parquet(f"{folder}/pages")


def outcome(rows: DataFrame) -> DataFrame:
    """url, state of each address: done, pending (stress: to be asked for again) or skipped; the best of several answers."""
    stress = F.col("status").isin(*STRESS) | (F.col("status") == 0)
    place = F.when(F.col("status").between(200, 399), 0).when(~stress, 1).otherwise(2)
    found = rows.groupBy("url").agg(F.min(place).alias("place"))
    return found.select("url", F.element_at(F.array(F.lit("done"), F.lit("skipped"), F.lit("pending")), F.col("place") + 1).alias("state"))


def again(spark: SparkSession, folder: str, fetcher: str) -> int:
    """Asks once more for what is pending; returns how many that were. Its pages stand beside those of the batches, under numbers below zero."""
    have = pages(spark, folder)
    pending = have.join(outcome(have).where("state = 'pending'").select("url"), "url", "left_semi").groupBy("url").agg(F.min("at").alias("at")).select("at", "url")
    number = min(0, have.agg(F.min("batch")).first()[0] or 0) - 1
    # A broken attempt leaves no rows, as a folder without its mark isn't listed by the writer.
    fetched(pending, fetcher).write.mode("overwrite").parquet(f"{folder}/pages/batch={number}")
    return pages(spark, folder).where(F.col("batch") == number).count()
