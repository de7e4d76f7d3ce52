"""Searches by an index, whose results are those of the scans; joins of stores and of prices with products."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import search as S
from ..operators import text_index, vector_index
from ..operators.twins import twins
from . import search as scans
from .frames import NOW, POINT_SQL, PRODUCT_SQL, kept_index, points, products, stores, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


@query(scans.ORACLE_SQL["search_vector_filtered"])
def search_vector_index(spark, sf_dir):
    """search_vector_filtered by lists around centroids, nearest bound first."""
    folder = kept_index(spark, sf_dir, "vectors", "lists", lambda to: vector_index.build(table(spark, sf_dir, "embeddings"), to), "embeddings")
    found = vector_index.opened(spark, folder).nearest(spark, scans.VECTOR, 16, "vec_id", lambda rows: rows.where("label = 3"))
    return found.rows.orderBy("distance", "vec_id").offset(4).limit(12).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(scans.ORACLE_SQL["search_text_topk"])
def search_text_index(spark, sf_dir):
    """search_text_topk by the trigrams of titles, rarest first."""
    folder = kept_index(spark, sf_dir, "titles", "counts", lambda to: text_index.build(products(spark, sf_dir), to), "part")
    found = text_index.search(text_index.TextIndex(folder, "title_normalized"), stores(spark, sf_dir), S.Filters(category="tops", max_cents=150000), scans.TEXT, 12)
    return found.select("product_uid", "store_slug", "title", "brand", "price", "distance")


@query(
    """WITH items AS (SELECT DISTINCT 's' || l_suppkey AS store, l_partkey AS key FROM lineitem UNION SELECT 't' || l_suppkey, l_partkey FROM lineitem WHERE l_linenumber <> 7),
    sizes AS (SELECT store, count(*) AS n FROM items GROUP BY store),
    shared AS (SELECT a.store AS store_a, b.store AS store_b, count(*) AS shared FROM items a JOIN items b ON a.key = b.key AND a.store < b.store GROUP BY ALL)
    SELECT store_a, store_b, shared, a.n AS n_a, b.n AS n_b FROM shared JOIN sizes a ON a.store = store_a JOIN sizes b ON b.store = store_b WHERE 100 * shared >= 80 * (a.n + b.n - shared)"""
)
def same_catalogue(spark, sf_dir):
    """Each supplier's parts under one domain, and all but a seventh of its lines under another."""
    line = table(spark, sf_dir, "lineitem")
    named = lambda df, letter: df.select(F.concat(F.lit(letter), F.col("l_suppkey").cast("string")).alias("store"), F.col("l_partkey").alias("key"))
    return twins(named(line, "s").unionByName(named(line.where("l_linenumber <> 7"), "t")), 80)


_COSINE = scans.COSINE_SQL.replace("embedding::", "embeddings.embedding::")


@query(
    f"""WITH {PRODUCT_SQL} SELECT product_uid, title, round({_COSINE}, 6) AS distance FROM product JOIN embeddings ON vec_id = key
    WHERE availability = 'in_stock' AND gender = 'women' AND price_min_cents BETWEEN 90500 AND 150000 ORDER BY {_COSINE}, product_uid LIMIT 40"""
)
def vector_price_range(spark, sf_dir):
    """Of the women's products in stock within a range of prices the nearest forty, by the index."""

    def build(to):
        vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
        vector_index.build(products(spark, sf_dir).select("key", "product_uid", "title", "availability", "gender", "price_min_cents").join(vectors, "key"), to, "vector")

    index = vector_index.opened(spark, kept_index(spark, sf_dir, "product-vectors", "lists", build, "part", "embeddings"))
    wanted = (F.col("availability") == "in_stock") & (F.col("gender") == "women") & F.col("price_min_cents").between(90500, 150000)
    found = index.nearest(spark, scans.VECTOR, 40, "product_uid", lambda rows: rows.where(wanted))
    return found.rows.orderBy("distance", "product_uid").limit(40).select("product_uid", "title", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {PRODUCT_SQL}, {POINT_SQL} SELECT product_uid, title, url, variant_external_id, first_value(amount_cents) OVER w / 100.0 AS price_now, last_value(amount_cents) OVER w / 100.0 AS price_before
    FROM point JOIN product USING (product_uid) WHERE observed_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS
    WINDOW w AS (PARTITION BY product_uid ORDER BY observed_at DESC, variant_external_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def price_window_products(spark, sf_dir):
    """Each price point of a week with its product's name and its newest and oldest price in that week."""
    week = A.price_window(points(spark, sf_dir), F.lit(NOW).cast("timestamp"), 7)
    named = week.join(products(spark, sf_dir).select("product_uid", "title", "url"), "product_uid")
    return named.select("product_uid", "title", "url", "variant_external_id", *((F.col(c) / 100).alias(c) for c in ("price_now", "price_before")))
