"""Dashboard aggregates, price windows and completion of missing genders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overview(products: DataFrame, variants: DataFrame, points: DataFrame, stores: DataFrame, marketplace: str = "avellaneda") -> DataFrame:
    """One row of counts; each table is scanned once."""
    p = products.agg(
        F.count("*").alias("products"),
        F.count("embedding").alias("with_embedding"),
        F.count_distinct(F.when(F.col("store_slug") == marketplace, F.col("seller"))).alias("sellers"),
        F.count_distinct(F.when(F.col("store_slug") != marketplace, F.col("brand"))).alias("brands"),
    )
    parts = [p, variants.agg(F.count("*").alias("variants")), points.agg(F.count("*").alias("price_points")), stores.agg(F.count("*").alias("stores"))]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns))


def by_store(products: DataFrame, price: str = "price_min_cents") -> DataFrame:
    return products.groupBy("store_slug").agg(F.count("*").alias("n"), (F.percentile(price, F.lit(0.5)) / 100).alias("median_price")).orderBy(F.desc("n"), "store_slug")


def top_categories(products: DataFrame, n: int = 10) -> DataFrame:
    return products.groupBy(F.coalesce("category", F.lit("(sin clasificar)")).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(n)


def price_window(points: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Every point of the last days with its product's newest and oldest price in them."""
    recent = points.where(F.col("observed_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    w = Window.partitionBy("product_uid").orderBy(F.desc("observed_at"), F.desc("variant_external_id")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return recent.withColumn("price_now", F.first("amount_cents").over(w)).withColumn("price_before", F.last("amount_cents").over(w))


def price_drops(points: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Products whose newest price in the last days is below their oldest in them; by aggregation, no sort."""
    recent = points.where(F.col("observed_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    at = F.struct("observed_at", "variant_external_id")
    found = recent.groupBy("product_uid").agg(F.max_by("amount_cents", at).alias("price_now"), F.min_by("amount_cents", at).alias("price_before"))
    return found.where("price_now < price_before").withColumn("drop_pct", F.round(100 * (1 - F.col("price_now") / F.col("price_before")), 2))


def dominant_gender(products: DataFrame, least: int = 25, share: float = 0.90) -> DataFrame:
    """Stores where one known gender has at least `share` of at least `least` products: one count by store and gender."""
    known = products.where(F.col("gender").isin("women", "men", "kids"))
    counts = known.groupBy("store_slug", "gender").agg(F.count("*").alias("n"))
    totals = counts.groupBy("store_slug").agg(F.sum("n").alias("n"), F.max(F.struct("n", "gender")).alias("top"))
    return totals.where((F.col("n") >= least) & (F.col("top.n") / F.col("n") >= share)).select("store_slug", F.col("top.gender").alias("gender"), "n", (F.col("top.n") / F.col("n")).alias("share"))


def complete_gender(products: DataFrame, least: int = 25, share: float = 0.90) -> DataFrame:
    """Unknown (and unisex) genders filled by category, then by the store's dominant gender."""
    from ..functions.taxonomy import WOMEN_CATEGORIES

    missing = ~F.coalesce(F.col("gender").isin("women", "men", "kids"), F.lit(False))
    first = products.withColumn("gender", F.when(missing & F.col("category").isin(*WOMEN_CATEGORIES), "women").otherwise(F.col("gender")))
    stores = dominant_gender(first, least, share).select("store_slug", F.col("gender").alias("_gender"))
    return first.join(stores, "store_slug", "left").withColumn("gender", F.when(missing & F.col("_gender").isNotNull(), F.col("_gender")).otherwise(F.col("gender"))).select(products.columns)


def detail(products: DataFrame, variants: DataFrame, points: DataFrame, uid: str, history: int = 60) -> DataFrame:
    """One product with its variants and latest price points nested; no row when it is missing. Vectors and raw data stay out."""
    mine = lambda df: df.where(F.col("product_uid") == uid)
    recent = mine(points).orderBy(F.desc("observed_at")).limit(history)
    v = mine(variants).groupBy("product_uid").agg(F.sort_array(F.collect_list(F.struct("external_id", *(c for c in variants.columns if c not in ("product_uid", "external_id"))))).alias("variants"))
    h = recent.groupBy("product_uid").agg(F.sort_array(F.collect_list(F.struct("observed_at", *(c for c in points.columns if c not in ("product_uid", "observed_at")))), asc=False).alias("history"))
    return mine(products).drop("embedding", "raw", "variants").join(v, "product_uid", "left").join(h, "product_uid", "left")


def keep_first(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key by position."""
    w = Window.partitionBy(key).orderBy(position)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_first_of_two_keys(rows: DataFrame, group: str, position: str, first: str, second: str) -> DataFrame:
    """In order of position, a row stays unless a row that stayed has either key; rows without one of the keys go.

    Each choice needs those before it, so a group is a sequence by nature. Spark sorts it and it comes in batches: a task
    holds the keys that stayed in one group, not its rows.
    """
    import pyarrow as pa

    def fold(batches):
        now, met_a, met_b = None, set(), set()
        for b in batches:
            flags = []
            for g, x, y in zip(*(b.column(c).to_pylist() for c in (group, first, second))):
                if g != now:
                    now, met_a, met_b = g, set(), set()
                stays = bool(x) and bool(y) and x not in met_a and y not in met_b
                if stays:
                    met_a.add(x)
                    met_b.add(y)
                flags.append(stays)
            yield b.filter(pa.array(flags, pa.bool_()))

    return rows.repartition(group).sortWithinPartitions(group, position).mapInArrow(fold, rows.schema)


def apparel(products: DataFrame) -> DataFrame:
    """keep and reason: a fashion category stays; without one, a title of something else goes."""
    from ..functions import apparel_words as A

    in_category = F.col("category").isin(*A.FASHION)
    other = F.coalesce(F.col("title"), F.lit("")).rlike(A.OTHER)
    return products.withColumn("keep", F.coalesce(in_category, F.lit(False)) | ~other).withColumn("reason", F.when(in_category, "categoría").when(other, "título no-ropa").otherwise("sin categoría, se conserva"))


def mall_trade(trade: Column) -> Column:
    from ..functions import apparel_words as A

    return F.coalesce((trade != "") & ~trade.rlike(A.MALL_OTHER) & trade.rlike(A.MALL_FASHION), F.lit(False))
