"""Streams that are stopped and go on: the crawl, freshness by timers, results in stable folders."""

import collections
import datetime
import os

import pytest
from pyspark.sql import functions as F

from tejido.streaming import crawl, fresh
from tests import crawl_double


@pytest.fixture
def shop():
    for path in (crawl_double.LOG, crawl_double.BREAK, crawl_double.LOG + ".calm"):
        if os.path.exists(path):
            os.remove(path)
    open(crawl_double.LOG, "w").close()
    yield lambda: collections.Counter(open(crawl_double.LOG).read().split())
    for path in (crawl_double.LOG, crawl_double.BREAK, crawl_double.LOG + ".calm"):
        if os.path.exists(path):
            os.remove(path)


def test_a_crawl_that_broke_goes_on_and_fetches_nothing_twice(spark, shop, tmp_path):
    run = lambda: crawl.crawl(spark, str(tmp_path), "tests.crawl_double:listed", "tests.crawl_double:page", batch=20, tasks=2)
    open(crawl_double.BREAK, "w").close()
    q = run()
    with pytest.raises(Exception, match="can't be had"):
        q.processAllAvailable()
    assert set(shop()) == set(crawl_double.URLS[:40]) and crawl.pages(spark, str(tmp_path)).count() == 40
    os.remove(crawl_double.BREAK)
    q = run()
    q.processAllAvailable()
    q.stop()
    # 100 places, 70 addresses; places 70 to 99 repeat those of the first batches, which only the state knows.
    assert shop() == collections.Counter({f"https://shop/p/{i}": 1 for i in range(70)})
    rows = crawl.pages(spark, str(tmp_path))
    assert rows.count() == rows.select("url").distinct().count() == 70
    states = {r["url"]: r["state"] for r in crawl.outcome(rows).collect()}
    number = lambda u: int(u.rpartition("/")[2])
    assert states == {u: "pending" if number(u) % 10 == 7 or number(u) == 9 else "skipped" if number(u) % 10 == 8 else "done" for u in crawl_double.URLS}
    open(crawl_double.LOG + ".calm", "w").close()
    assert crawl.again(spark, str(tmp_path), "tests.crawl_double:page") == 8
    states = {r["url"]: r["state"] for r in crawl.outcome(crawl.pages(spark, str(tmp_path))).collect()}
    assert collections.Counter(states.values()) == {"done": 62, "skipped": 7, "pending": 1}
    assert crawl.again(spark, str(tmp_path), "tests.crawl_double:page") == 1
    # Nothing new in the list: going on once more fetches nothing.
    before = shop()
    q = run()
    q.processAllAvailable()
    q.stop()
    assert shop() == before


def test_stream_queries_go_on_where_they_stopped(spark, tmp_path):
    from tejido.plans.stored import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    parts = [events.where(F.col("event_id") % 3 == i) for i in range(3)]
    parts[0].coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    hours = lambda rows: {(r["window_start"], r["event_type"]): (r["n"], round(r["total"], 2)) for r in rows.collect()}
    want = lambda df: hours(df.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    have = parts[0]
    for i in range(3):
        if i:
            parts[i].coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
            have = have.unionByName(parts[i])
        for _ in range(2):  # a second call without new files gives the same
            assert hours(QUERIES["stream_window_counts"](spark, str(tmp_path))) == want(have)
    assert QUERIES["stream_dedup_append"](spark, str(tmp_path)).count() == QUERIES["stream_dedup_append"](spark, str(tmp_path)).count() == events.count()


DAY = datetime.datetime(2026, 1, 1)


def at(hours):
    return DAY + datetime.timedelta(hours=hours)


def test_products_leave_when_a_run_ends_without_them(spark, tmp_path):
    schema = "store_slug string, product_uid string, at timestamp"
    batches = [
        [("a", "p1", at(0)), ("a", "p2", at(0)), ("b", "q1", at(0)), ("a", None, at(1)), ("b", None, at(1))],
        [("a", "p2", at(20)), ("a", "p3", at(20)), ("a", None, at(21))],
        # Late, but within the watermark: p1 was seen in that run after all... and p4 before its slack ended.
        [("a", "p4", at(20.5)), ("b", "q2", at(20.5))],
        [("c", "r1", at(23))],  # moves the watermark beyond the run of hour 21
        [("a", "p1", at(30)), ("b", None, at(40)), ("c", "r1", at(41))],
        [("c", "r1", at(60)), ("a", "p5", at(5))],  # p5 is too late to count
        [("c", "r2", at(61))],
    ]
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            # Each batch is a run of its own, on the checkpoint of the one before.
            events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            out = fresh.comings_and_goings(events, 12, "1 hour", buckets=3)
            out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    changes = spark.read.schema(fresh.OUT).parquet(f"{tmp_path}/out")
    told = sorted((r["store_slug"], r["product_uid"], r["event"], r["at"]) for r in changes.collect())
    assert told == sorted([
        ("a", "p1", "in", at(0)), ("a", "p2", "in", at(0)), ("b", "q1", "in", at(0)), ("a", "p3", "in", at(20)), ("a", "p4", "in", at(20.5)), ("b", "q2", "in", at(20.5)), ("c", "r1", "in", at(23)),
        ("a", "p1", "out", at(21)), ("a", "p1", "in", at(30)), ("b", "q1", "out", at(40)), ("b", "q2", "out", at(40)), ("c", "r2", "in", at(61)),
    ])
    assert {tuple(r) for r in fresh.fresh_now(changes).collect()} == {("a", "p1"), ("a", "p2"), ("a", "p3"), ("a", "p4"), ("c", "r1"), ("c", "r2")}
