"""Restores of several tables, running counts and the early stop, twin catalogues, the whole onboarding chain."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tejido.operators import onboarding as O
from tejido.operators.running import before
from tejido.operators.snapshot import Occupied, Tables
from tejido.operators.twins import twins
from tejido.sources import landed


def broken(spark):
    return spark.range(5).select(F.raise_error(F.lit("no more")).cast("long").alias("id"))


def test_a_failure_in_the_second_table_leaves_nothing_to_see(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "shop"))
    with pytest.raises(Exception, match="no more"):
        t.restore({"product": spark.range(3), "variant": broken(spark)})
    assert t.versions() == [] and t.manifest() == {"tables": {}} and not list((tmp_path / "shop" / "attempts").iterdir())
    assert t.restore({"product": spark.range(3).withColumn("v", F.lit(1)), "variant": spark.range(10, 14)}, {"variant": "id"}) == 1
    assert (t.read("product").count(), t.read("variant").count(), t.last_number("variant"), t.last_number("product")) == (3, 4, 13, 0)
    with pytest.raises(Occupied, match="product"):
        t.restore({"product": spark.range(7)})
    with pytest.raises(Exception, match="no more"):
        t.restore({"product": spark.range(7), "variant": broken(spark)}, force=True)
    assert t.versions() == [1] and t.read("product").count() == 3
    # Numbers of new rows lie beyond those that came with the dump, as do those after a smaller restore.
    assert t.numbered(spark.range(4).select(F.lit("x").alias("sku")), "variant").agg(F.min("id")).first()[0] == 14
    assert t.restore({"variant": spark.range(2)}, {"variant": "id"}, force=True) == 2
    assert (t.read("product").count(), t.read("variant").count(), t.last_number("variant")) == (3, 2, 13)
    assert t.restore({"empty": spark.range(0)}, {"empty": "id"}) == 3 and t.read("empty").count() == 0 and t.last_number("empty") == 0
    assert len(t.vacuum()) == 0 and t.read("product").count() == 3


def test_of_two_restores_at_once_one_is_refused(spark, tmp_path, monkeypatch):
    t = Tables(spark, str(tmp_path))
    t.restore({"a": spark.range(0)})
    monkeypatch.setattr(Tables, "versions", lambda self: [])
    with pytest.raises(Occupied, match="another"):
        t.restore({"a": spark.range(1)})
    monkeypatch.undo()
    assert t.versions() == [1] and t.read("a").count() == 0


@pytest.mark.parametrize("n, width", [(0, 4), (1, 4), (300, 4), (1000, 7), (50, 4096)])
def test_running_counts_are_those_of_a_loop(spark, n, width):
    r = random.Random(n)
    places = r.sample(range(3 * n + 1), n)
    rows = [(p, r.randrange(0, 5)) for p in places]
    got = {x["p"]: (x["s"], x["k"]) for x in before(spark.createDataFrame(rows, "p long, v long").repartition(3), "p", {"s": F.col("v"), "k": F.lit(1)}, width).collect()}
    want, s = {}, 0
    for k, (p, v) in enumerate(sorted(rows)):
        want[p] = (s, k)
        s += v
    assert got == want


def visited(pages, misses):
    order = sorted((p for p in pages if not p[3]), key=lambda p: (p[2], p[1]))
    out, missed, hits = [], 0, 0
    for url, _, _, _, hit in order:
        if missed >= misses and not hits:
            break
        out.append(url)
        missed, hits = (missed, hits) if hit is None else (0, hits + 1) if hit else (missed + 1, hits)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_a_shop_is_given_up_after_misses_without_a_hit(spark, seed):
    r = random.Random(seed)
    kinds = [("/producto/x", 0, False), ("/p/y", 0, False), ("/other/z", 1, False), ("/blog/n", 1, True)]
    pages = []
    for i in range(300):
        path, unlikely, never = r.choice(kinds)
        pages.append((f"https://s{path}{i}", i, unlikely, never, r.choice([False, False, None, True] if r.random() < (0, 0.01, 0.02, 0.05, 0.2, 1)[seed] else [False, False, None])))
    df = spark.createDataFrame([(u, i, h) for u, i, _, _, h in pages], "url string, position long, hit boolean").repartition(4)
    found = landed.until_hopeless(df, misses=20)
    assert [x["url"] for x in found.collect()] == visited(pages, 20)
    # Not all rows in one task: each window is by block.
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_what_is_cut_is_counted(spark):
    df = spark.createDataFrame([(f"https://s/{'blog' if i % 5 == 0 else 'p'}/{i}", i) for i in range(50)], "url string, position long")
    assert landed.count_left(df, most=30) == 10 and landed.likely_first(df, most=30).count() == 30
    assert landed.likely_first(df, most=40, beyond="raise").count() == 40
    with pytest.raises(landed.TooMany, match="10 addresses"):
        landed.likely_first(df, most=30, beyond="raise")


@pytest.mark.parametrize("percent, margin", [(80, 0.03), (80, 0.0), (50, 0.1), (95, 0.01), (100, 0.0)])
def test_twins_are_those_of_all_pairs(spark, percent, margin):
    r = random.Random(percent)
    sets = {}
    for i in range(14):
        base = {f"k{r.randrange(3000)}" for _ in range(r.choice([1, 2, 5, 40, 300]))}
        for j in range(3):
            sets[f"d{i}-{j}"] = {k for k in base if r.random() > 0.08 * j} | {f"k{r.randrange(3000)}" for _ in range(j)}
    sets |= {"twin": sets["d3-0"], "twin9": sets["d4-0"] | sets["d5-0"]}
    rows = [(s, k) for s, ks in sets.items() for k in ks] * 2 + [(None, "k1"), ("d0-0", None)]
    got = {tuple(x) for x in twins(spark.createDataFrame(rows, "store string, key string"), percent, margin=margin).collect()}
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert got == want and want


def test_the_whole_chain_of_a_shop(spark):
    from tests.test_operators import batch

    price = F.struct(F.lit(100).cast("long").alias("amount_cents"), F.lit(None).cast("long").alias("compare_at_cents"))
    variants = F.array(F.struct(F.lit("0").alias("external_id"), F.struct(F.lit("Negro").alias("raw")).alias("color"), price.alias("price"), F.lit("in_stock").alias("availability"), F.lit(None).cast("int").alias("stock")))
    new = batch(spark, 40, variants=variants, content_hash=F.lit("h"), store_slug=F.lit("s"), description=F.lit(None).cast("string"), description_ia=F.lit(None).cast("string"), embedding=F.lit(None).cast("array<double>"))
    new = new.withColumns({"description_ia_at": F.lit(None).cast("timestamp"), "embedding_ia_at": F.lit(None).cast("timestamp")})
    first, second = new.where("product_uid < 's:30'"), new.withColumn("title", F.concat(F.lit("otra "), "title"))
    old = new.limit(0).withColumn("first_seen_at", F.lit(None).cast("timestamp"))
    points = spark.createDataFrame([], "product_uid string, variant_external_id string, observed_at timestamp")
    out = O.chain([first, second], old, points, F.lit(datetime.datetime(2026, 1, 1)), lambda texts: [(i, [float(len(t))]) for i, t in enumerate(texts)])
    rows = {r["product_uid"]: r for r in out["products"].collect()}
    assert len(rows) == new.count() == out["points"].count()
    early = {r["product_uid"] for r in first.collect()}
    assert 0 < len(early) < len(rows)
    # What an earlier pass has stands; a later one only adds.
    assert all(r["title"].startswith("otra ") == (u not in early) and r["embedding"] == [float(len(r["title"]))] for u, r in rows.items())
    assert [tuple(r) for r in out["counts"].collect()] == [("s", len(rows), len(rows))]


def test_twins_send_few_rows_where_many_stores_share_some_keys(spark):
    r = random.Random(5)
    rows = [(f"s{i}", k) for i in range(600) for k in r.sample(range(400), 60)]
    rows += [("twin", k) for s, k in rows if s == "s7"]
    tracker = spark.sparkContext._jsc.sc().statusStore()

    def sent():
        stages = tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = sent()
    assert [tuple(x) for x in twins(spark.createDataFrame(rows, "store string, key long")).collect()] == [("s7", "twin", 60, 60, 60)]
    # Pairs of stores that share any key: about 180,000 here, and more for each task that counts them.
    assert sent() - before < 3 * len(rows)
