"""Product, variant, price-history and audit tables: upserts by join and rewrite, appends by anti-join.

Built-in Parquet tables have no MERGE, so an upsert gives the whole new table, which the caller writes beside the old one and
swaps. Every join is on the key alone and shuffles both sides once; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in the given order."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], preserved: dict[str, Column] | None = None, update_only: list[str] | None = None) -> DataFrame:
    """existing with incoming's rows put in by key.

    preserved: columns that an update leaves as they are, with their value for a new row. update_only: the only columns
    that an update changes; all others stay. Rows of existing that incoming lacks stay. incoming's keys must be unique.
    """
    preserved = preserved or {}
    old, new = existing.alias("o"), incoming.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    known, given = F.col(f"o.{keys[0]}").isNotNull(), F.col(f"n.{keys[0]}").isNotNull()
    out = []
    for c in existing.columns:
        if c in keys:
            value = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        elif c in preserved:
            value = F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}") if c in incoming.columns else preserved[c])
        elif c not in incoming.columns:
            value = F.col(f"o.{c}")
        elif update_only is not None and c not in update_only:
            value = F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        else:
            value = F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        out.append(value.cast(existing.schema[c].dataType).alias(c))
    return old.join(new, on, "full").select(*out)


def upsert_products(existing: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """When a product was first seen, its generated description and its embedding survive an update."""
    none = F.lit(None)
    return upsert(existing, incoming, ["product_uid"], {"first_seen_at": now, "description_ia": none, "description_ia_at": none, "embedding": none, "embedding_ia_at": none})


def upsert_variants(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Variants that a store no longer lists stay."""
    return upsert(existing, incoming, ["product_uid", "external_id"])


def upsert_stores(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, ["slug"], update_only=["name", "domain", "platform"])


def changed(incoming: DataFrame, existing: DataFrame, key: str = "product_uid", digest: str = "content_hash") -> DataFrame:
    """Rows that are new or whose hash differs."""
    before = existing.select(F.col(key), F.col(digest).alias("_before"))
    return incoming.join(before, key, "left").where(~F.col(digest).eqNullSafe(F.col("_before"))).drop("_before")


def new_points(points: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("product_uid", "variant_external_id", "observed_at")) -> DataFrame:
    """Price points to append: those whose key is not there yet, each once."""
    return points.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def price_points(products: DataFrame, now: Column) -> DataFrame:
    v = F.col("v")
    return products.select("product_uid", F.explode("variants").alias("v")).select(
        "product_uid", v["external_id"].alias("variant_external_id"), now.alias("observed_at"), v["price"]["amount_cents"].alias("amount_cents"),
        v["price"]["compare_at_cents"].alias("compare_at_cents"), v["availability"].alias("availability"), v["stock"].alias("stock"),
    )


def append_points(points: DataFrame, path: str) -> None:
    """Month partitions, so that a window over recent days reads one or two of them."""
    points.withColumn("month", F.date_trunc("month", "observed_at").cast("date")).write.mode("append").partitionBy("month").parquet(path)


def set_columns(existing: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """existing with the non-key columns of updates put in where the key matches."""
    columns = [c for c in updates.columns if c != key]
    new = updates.select(F.col(key), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = existing.join(new, key, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns if c in existing.columns}).select(existing.columns)


def set_embeddings(products: DataFrame, pairs: DataFrame) -> DataFrame:
    """Vectors by product; each is stamped with the description it was made from."""
    new = pairs.select("product_uid", F.col("embedding").alias("_embedding"))
    joined = products.join(new, "product_uid", "left")
    hit = F.col("_embedding").isNotNull()
    return joined.withColumns({"embedding": F.coalesce("_embedding", "embedding"), "embedding_ia_at": F.when(hit, F.col("description_ia_at")).otherwise(F.col("embedding_ia_at"))}).select(products.columns)


def set_descriptions(products: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """Generated descriptions by product, with the time they came; a null one changes nothing. Of several of one product the first in order of text counts."""
    new = pairs.where(F.col("description_ia").isNotNull()).groupBy("product_uid").agg(F.min("description_ia").alias("description_ia"))
    return set_columns(products, new.withColumn("description_ia_at", now), "product_uid")


def pending_embedding(products: DataFrame, only_generated: bool = False) -> DataFrame:
    """Products without a vector, or whose generated description changed since theirs was made."""
    stale = F.col("description_ia").isNotNull() & ~F.col("embedding_ia_at").eqNullSafe(F.col("description_ia_at"))
    return products.where(stale if only_generated else F.col("embedding").isNull() | stale)


def pending_description(products: DataFrame) -> DataFrame:
    """Products to describe from their first image, brands before the marketplace."""
    from ..functions.vocabulary import WHOLESALE_STORE

    short = F.col("description").isNull() | (F.length(F.trim("description")) < 20)
    rows = products.where(short & F.col("description_ia").isNull() & (F.size("images") > 0))
    return rows.select("product_uid", "title", F.col("images")[0]["url"].alias("image_url"), "store_slug").orderBy((F.col("store_slug") != WHOLESALE_STORE).desc(), "product_uid")


def seal(stores: DataFrame, runs: DataFrame, store: str = "store_slug", seen: str = "scraped_at") -> DataFrame:
    """last_crawl of each store set to its products' latest sighting."""
    last = runs.groupBy(F.col(store).alias("slug")).agg(F.max(seen).alias("last_crawl"))
    return set_columns(stores, last, "slug")


def finish_runs(runs: DataFrame) -> DataFrame:
    """Audit rows are only appended (a start, later a finish): the latest row of each run."""
    return latest(runs, ["run_id"], [F.coalesce("finished_at", "started_at")])


def touch(existing: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Unchanged products that a crawl saw count as fresh."""
    ids = seen.select("product_uid", F.lit(True).alias("_hit")).distinct()
    return existing.join(ids, "product_uid", "left").withColumn("scraped_at", F.when(F.col("_hit"), now).otherwise(F.col("scraped_at"))).select(existing.columns)


def subset(products: DataFrame, stores: list[str], caps: dict[str, int], order: Column) -> DataFrame:
    """All products of some stores, and the newest few of others."""
    whole = products.where(F.col("store_slug").isin(stores))
    for store, n in caps.items():
        whole = whole.unionByName(products.where(F.col("store_slug") == store).orderBy(order, "product_uid").limit(n))
    return whole


def restore(df: DataFrame, path: str) -> None:
    """Refuses to write over what is there."""
    df.write.mode("errorifexists").parquet(path)


def orphans(children: DataFrame, parents: DataFrame, key: str = "product_uid") -> DataFrame:
    """Rows whose parent is missing: what a foreign key would refuse."""
    return children.join(parents.select(key), key, "left_anti")
