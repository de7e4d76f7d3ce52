"""Searches by index against the same searches by scan."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tejido.operators import search as S
from tejido.operators import text_index, vector_index
from tejido.operators.best_first import best_first

NOW = datetime.datetime(2026, 1, 1)
COLUMNS = "product_uid string, store_slug string, title string, title_normalized string, brand string, category string, gender string, price_min_cents long, availability string, sizes_available array<string>, scraped_at timestamp, description string, description_ia string, variants array<struct<color:struct<normalized:string>,availability:string>>, embedding array<float>"


def catalogue(spark, n=900, dims=8, seed=4):
    """Products in clumps of like vectors and words; some without a vector, with a zero one or a broken one; titles that repeat."""
    r, rng = random.Random(seed), np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims))
    words = ["remera", "verde", "vestido", "largo", "jean", "ancho", "campera", "negra", "zapato", "rojo"]
    rows = []
    for i in range(n):
        clump = i % 12
        v = (centers[clump] + 0.15 * rng.normal(size=dims)).astype(np.float32).tolist()
        v = None if i % 31 == 0 else [0.0] * dims if i % 37 == 0 else [float("nan")] * dims if i % 41 == 0 else [] if i % 43 == 0 else rows[-1][-1] if i % 29 == 0 else v
        title = " ".join(r.choice(words[clump % 5 * 2 :]) for _ in range(r.randrange(1, 5)))
        title = None if i % 97 == 0 else "" if i % 89 == 0 else title
        rows.append((f"p{i:04}", f"s{i % 4}", title, title, r.choice([None, "", "b", "c"]), f"c{clump}" if i % 50 else "rare", r.choice(["women", "men"]), r.randrange(100, 9000), "in_stock" if i % 3 else "out_of_stock", ["40"], NOW - datetime.timedelta(hours=i % 30), None, None, [], v))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def shop(spark):
    products = catalogue(spark).repartition(3).cache()
    stores = spark.createDataFrame([(f"s{i}", NOW if i else None) for i in range(4)], "slug string, last_crawl timestamp")
    return products, stores


FILTERS = [S.Filters(in_stock=False, fresh_hours=None), S.Filters(), S.Filters(category="rare", in_stock=False, fresh_hours=None), S.Filters(category="c5", max_cents=3000), S.Filters(category="none"), S.Filters(store="s2", genero="men", min_cents=500)]


def told(rows):
    return [(r["product_uid"], r["distance"]) for r in rows.orderBy("distance", "product_uid").collect()]


@pytest.fixture(scope="module")
def vectors(shop, tmp_path_factory):
    return vector_index.build(shop[0], str(tmp_path_factory.mktemp("index") / "v"), lists=16)


@pytest.mark.parametrize("f", FILTERS)
@pytest.mark.parametrize("limit, offset", [(12, 0), (3, 20)])
def test_vector_index_is_the_scan(shop, vectors, f, limit, offset):
    products, stores = shop
    usable = products.where(vector_index.usable(F.col("embedding")))
    for seed in range(3):
        q = np.random.default_rng(seed).normal(size=8).tolist()
        assert told(vector_index.search(vectors, stores, f, q, limit, offset)) == told(S.search(usable, stores, f, q, limit=limit, offset=offset))


def test_vector_index_reads_few_lists_and_a_filter_more(spark, shop, vectors):
    products, _ = shop
    q = products.where("product_uid = 'p0013'").first()["embedding"]
    wide = vectors.nearest(spark, q, 5, "product_uid")
    assert wide.opened < len(vectors.lists) / 2
    narrow = vectors.nearest(spark, q, 5, "product_uid", lambda rows: rows.where("category = 'rare'"))
    assert wide.opened < narrow.opened and narrow.rows.count() >= 5
    plan = wide.rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_list" in plan
    assert vectors.nearest(spark, q, 5, "product_uid", lambda rows: rows.where("category = 'none'")).opened == len(vectors.lists)


def test_vector_bounds_hold(spark, shop, vectors):
    held = {}
    for r in spark.read.parquet(f"{vectors.path}/rows").select("_list", "embedding").collect():
        held.setdefault(r["_list"], []).append(np.array(r["embedding"], float))
    assert sum(map(len, held.values())) == vectors.size.sum() == shop[0].where(vector_index.usable(F.col("embedding"))).count()
    for seed in range(20):
        q = np.random.default_rng(seed).normal(size=8) * 3
        for i, bound in zip(vectors.lists, vectors.bounds(q)):
            assert all(1 - v @ q / np.linalg.norm(v) / np.linalg.norm(q) >= bound for v in held[i])


def test_vector_index_of_nothing(spark, shop, tmp_path):
    products, stores = shop
    for i, rows in enumerate((products.limit(0), products.where("product_uid = 'p0000'"), products.where("product_uid = 'p0005'"))):
        index = vector_index.build(rows, str(tmp_path / str(i)))
        assert len(vector_index.search(index, stores, FILTERS[0], [1.0] * 8).collect()) == (i == 2)


@pytest.fixture(scope="module")
def titles(shop, tmp_path_factory):
    return text_index.build(shop[0], str(tmp_path_factory.mktemp("index") / "t"))


@pytest.mark.parametrize("f", FILTERS)
@pytest.mark.parametrize("text", ["remera verde", "campera", "xyz", "", "zapato rojo jean"])
def test_text_index_is_the_scan(shop, titles, f, text):
    products, stores = shop
    for limit, offset in ((12, 0), (30, 25)):
        assert told(text_index.search(titles, stores, f, text, limit, offset)) == told(S.search(products, stores, f, text=text, limit=limit, offset=offset))


def test_text_index_reads_rare_trigrams_first(spark, shop, titles):
    grams = titles.rarest_first(spark, "campera verde")
    assert [n for _, n in grams] == sorted(n for _, n in grams)
    found = titles.nearest(spark, "campera verde", 3, "product_uid")
    assert found.opened < len(grams)
    # Each entry of a trigram is read where it is stored only.
    entries = spark.read.schema(text_index.ENTRIES).parquet(f"{titles.path}/entries")
    assert entries.groupBy("bucket").agg(F.count_distinct(text_index._bucket(F.col("gram"))).alias("n")).where("n > 1").count() == 0
    assert titles.nearest(spark, "campera verde", 10_000, "product_uid").opened == len(grams) + 1


def test_text_index_of_nothing(shop, tmp_path):
    products, stores = shop
    index = text_index.build(products.limit(0), str(tmp_path / "t"))
    assert text_index.search(index, stores, FILTERS[0], "remera").count() == 0


def test_ties_at_a_bound_are_read(spark):
    """A row at the very distance of the last match may win by its name."""
    parts = [[("b", 0.25), ("c", 0.5)], [("x", 0.7)], [("a", 0.5)], [("z", 0.9)]]
    read = lambda ps: spark.createDataFrame([r for p in ps for r in parts[p]], "uid string, distance double")
    found = best_first([0.0, 0.25, 0.5, 0.6], read, 2, "uid", first=1)
    assert found.opened == 3 and [r["uid"] for r in found.rows.orderBy("distance", "uid").limit(2).collect()] == ["b", "a"]
    assert best_first([], lambda ps: read([0]).limit(0), 2, "uid").opened == 0
