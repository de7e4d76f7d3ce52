"""Bringing shops in: resolving brands to domains, mall directories, coverage reports, generated descriptions, the job itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shaping import short_hash
from ..functions.text import clean, strip_tags
from .analytics import mall_trade
from .quality import gate, validate
from .storage import changed, new_points, price_points, upsert_products

#: Platforms that can be read, category names for people, comments that are no description, inner labels.
READABLE = ("tiendanube", "shopify", "vtex", "magento", "avellaneda")
CATEGORY_NAMES = {
    "tops": "parte de arriba", "pants": "pantalón", "jeans": "jean", "shorts": "short", "skirts": "pollera", "dresses": "vestido", "knitwear": "prenda de punto", "outerwear": "abrigo", "lingerie": "lencería",
    "swimwear": "traje de baño", "activewear": "ropa deportiva", "shoes": "calzado", "bags": "bolso", "jewelry": "bijouterie", "accessories": "accesorio",
}
COMMENTS = ("no es una prenda", "no describe", "esta imagen", "la imagen", "no hay prenda", "gift card", "tarjeta regalo", "no se puede")
LABELS = r"(?i)\s*\b(tipo\s+)?(knitwear|outerwear|activewear|swimwear|footwear|bottoms)\b"


def resolve_brands(candidates: DataFrame) -> DataFrame:
    """brand, position, domain, platform (null: not alive) to the domain taken: the first readable one, else the first alive."""
    known = F.coalesce(F.col("platform").isin(*READABLE), F.lit(False))
    best = F.min_by(F.struct("domain", "platform"), F.when(F.col("platform").isNotNull(), F.struct((~known).alias("unread"), "position")))
    found = candidates.groupBy("brand").agg(best.alias("b"))
    alive = F.col("b.platform").isNotNull()
    state = F.when(~alive, "no resuelve").when(F.col("b.platform").isin(*READABLE), "ok").otherwise("plataforma no cubierta")
    return found.select("brand", F.when(alive, F.col("b.domain")).otherwise("").alias("domain"), F.when(alive, F.col("b.platform")).otherwise("").alias("platform"), state.alias("state"))


def mall_directory(shops: DataFrame, terms: DataFrame) -> DataFrame:
    """shops (mall, slug, name, term_ids) with the names of their trades; a term without a name keeps its number.

    Terms are a small table of each mall; Spark decides how to join it.
    """
    one = shops.select("mall", "slug", F.posexplode_outer("term_ids").alias("at", "term_id"))
    named = one.join(terms.select("mall", F.col("id").alias("term_id"), F.col("name").alias("_term")), ["mall", "term_id"], "left")
    name = F.coalesce("_term", F.col("term_id").cast("string"))
    trades = named.groupBy("mall", "slug").agg(F.array_sort(F.collect_list(F.when(name != "", F.struct("at", name.alias("n"))))).alias("ns"))
    trade = F.array_join(F.array_distinct(F.transform("ns", lambda x: x["n"])), " / ")
    out = shops.drop("term_ids").join(trades.select("mall", "slug", trade.alias("trade")), ["mall", "slug"])
    return out.withColumn("name", strip_tags(F.col("name"))).withColumn("fashion", mall_trade(F.col("trade")))


def sampled_coverage(products: DataFrame, n: int, fields: dict[str, Column]) -> DataFrame:
    """Share of a sample of n products (by hash of the id, so the same each time) that has each field."""
    sample = products.orderBy(F.md5("product_uid"), "product_uid").limit(n)
    return sample.agg(F.count("*").alias("n"), *(F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in fields.items()))


def coverage_by_store(products: DataFrame) -> DataFrame:
    """What the mappers found, by store."""
    with_ = lambda field: F.sum(F.size(F.filter("variants", lambda v: v[field].isNotNull())))
    return products.groupBy("store_slug").agg(
        F.count("*").alias("products"), F.sum(F.size("variants")).alias("variants"), with_("size").alias("with_size"), with_("color").alias("with_color"),
        F.sum(F.size("images")).alias("images"), F.count("category").alias("with_category"), F.count("description").alias("with_description"),
    )


def capabilities(probes: DataFrame) -> DataFrame:
    """probes (types, price, sitemap) to counts: sites, those with a product in structured data, with its price, with a sitemap."""
    product = F.contains("types", F.lit("Product"))
    return probes.agg(F.count("*").alias("sites"), F.count_if(product).alias("with_product"), F.count_if(product & F.col("price").isNotNull()).alias("with_price"), F.count_if("sitemap").alias("with_sitemap"))


def anchor(title: Column, category: Column) -> Column:
    """What is on sale, said so that a describer keeps to it."""
    names = F.create_map(*(F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv))
    return F.when(names[category].isNotNull(), F.concat(title, F.lit(" (es un/a "), names[category], F.lit(")"))).otherwise(title)


def cleaned_description(raw: Column, most: int = 320, least: int = 25) -> Column:
    """A generated description fit to be embedded; null for comments, refusals and short answers."""
    cut = F.substring(clean(raw), 1, most)
    low = F.lower(cut)
    bad = F.contains(F.upper(cut), F.lit("NO_ES_PRENDA"))
    for c in COMMENTS:
        bad = bad | F.contains(low, F.lit(c))
    out = F.regexp_replace(F.trim(F.regexp_replace(cut, LABELS, "")), r"\s{2,}", " ")
    return F.when(~bad & (F.length(out) >= least), out)


def onboard(products: DataFrame, existing: DataFrame, points: DataFrame, now: Column, baseline: dict | None = None, expected: int | None = None, force: bool = False, only_changed: bool = True) -> dict[str, DataFrame]:
    """Gate, diff and upsert of one harvest: the new product table, the price points to append, and what changed.

    only_changed: price points of changed products only; otherwise of all that were seen.
    """
    gate(validate(products, baseline, expected), force)
    new = changed(products, existing)
    return {"products": upsert_products(existing, new, now), "points": new_points(price_points(new if only_changed else products, now), points), "changed": new}


def chain(passes: list[DataFrame], existing: DataFrame, points: DataFrame, now: Column, provider, text: str = "title", **gate_options) -> dict[str, DataFrame]:
    """The whole way of a shop: what earlier passes lack is taken from later ones, then gate, upsert, vectors for what waits for one, counts by store."""
    from .requests import embedded
    from .storage import pending_embedding, set_embeddings

    seen = passes[0]
    for more in passes[1:]:
        seen = seen.unionByName(more.join(seen.select("product_uid"), "product_uid", "left_anti"))
    out = onboard(seen, existing, points, now, **gate_options)
    waiting = embedded(pending_embedding(out["products"]).select("product_uid", text), text, provider).drop(text)
    products = set_embeddings(out["products"], waiting)
    return out | {"products": products, "counts": products.groupBy("store_slug").agg(F.count("*").alias("products"), F.count("embedding").alias("with_vector"))}


def inventory_hash(url: Column) -> Column:
    """The name under which a fetched page is kept."""
    return short_hash(url)
