"""Filtered top-k search over a product frame: hard filters, vector or trigram ranking, one row per title and brand,
gradual relaxation, facets."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.similarity import cosine_distance, literal_vector, trigram_similarity
from ..functions.text import fold, fold_literal, word

#: Order in which filters are let go of when nothing is found; price comes last.
RELAX_ORDER = ("detalle", "tela", "color", "size", "category", "store", "min_cents")
MAX_LIMIT, MAX_OFFSET = 48, 600


@dataclass(frozen=True)
class Filters:
    """What a search asks for. Empty values and a price of 0 mean no filter."""

    canal: str | None = None
    genero: str | None = None
    tela: str | None = None
    detalle: str | None = None
    max_cents: int | None = None
    min_cents: int | None = None
    category: str | None = None
    color: str | None = None
    size: str | None = None
    store: str | None = None
    in_stock: bool = True
    fresh_hours: int | None = 12


def _mentions(words, columns=("title", "description", "description_ia")) -> Column:
    """Any of the words inside any of the texts, whatever the case; accents count."""
    lowered = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w.lower())) for c in lowered for w in words))


def fresh(hours: int) -> Column:
    """Seen in the store's last crawl, give or take some hours; stores never crawled pass."""
    return F.col("last_crawl").isNull() | (F.col("scraped_at") >= F.col("last_crawl") - F.expr(f"INTERVAL {int(hours)} HOURS"))


def hard_conditions(f: Filters) -> list[Column]:
    """Conditions that are never relaxed."""
    out = []
    if f.in_stock:
        out.append(F.col("availability") == "in_stock")
    if f.fresh_hours is not None:
        out.append(fresh(f.fresh_hours))
    if f.max_cents:
        out.append(F.col("price_min_cents") <= f.max_cents)
    if f.genero == "sin":
        out.append(~F.col("gender").isin("women", "men", "kids"))
    elif f.genero:
        out.append(F.col("gender") == f.genero)
    if f.canal == "mayorista":
        out.append(F.col("store_slug") == V.WHOLESALE_STORE)
    elif f.canal == "marcas":
        out.append(F.col("store_slug") != V.WHOLESALE_STORE)
    return out


def soft_conditions(f: Filters, variants: str | None = "variants") -> dict[str, Column]:
    """Conditions that can be relaxed, by field."""
    out: dict[str, Column] = {}
    if f.detalle:
        out["detalle"] = _mentions(V.AXES["detalle"].get(f.detalle, (f.detalle,)))
    if f.tela:
        out["tela"] = _mentions(V.AXES["tela"].get(f.tela, (f.tela,)))
    if f.color:
        said = _mentions(V.COLOR_WORDS.get(f.color, (f.color,)))
        held = F.exists(F.col(variants), lambda v: (v["color"]["normalized"] == f.color) & (v["availability"] == "in_stock")) if variants else F.lit(False)
        out["color"] = F.coalesce(held, F.lit(False)) | said
    if f.size:
        out["size"] = F.array_contains("sizes_available", f.size)
    if f.category:
        out["category"] = F.col("category") == f.category
    if f.store:
        out["store"] = F.col("store_slug") == f.store
    if f.min_cents:
        out["min_cents"] = F.col("price_min_cents") >= f.min_cents
    return out


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _checked(limit: int, offset: int) -> None:
    if not 0 < limit <= MAX_LIMIT or not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"limit is 1 to {MAX_LIMIT}, offset 0 to {MAX_OFFSET}")


def ranked(products: DataFrame, embedding=None, text: str = "") -> DataFrame:
    """products with `distance` (cosine, rows without a vector left out) or, without an embedding, 1 - trigram similarity."""
    if embedding is not None:
        return products.where(F.col("embedding").isNotNull()).withColumn("distance", cosine_distance(F.col("embedding"), literal_vector(embedding)))
    return products.withColumn("distance", 1 - trigram_similarity(F.col("title_normalized"), F.lit(text)))


def best_per_title(rows: DataFrame) -> DataFrame:
    """One row per title and brand: the nearest, ties to the smaller uid."""
    w = Window.partitionBy("title_normalized", F.coalesce("brand", F.lit(""))).orderBy("distance", "product_uid")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page(rows: DataFrame, limit: int, offset: int = 0, candidate_limit: int | None = None) -> DataFrame:
    """The page of the nearest titles. candidate_limit: first take so many titles in alphabetical order, as some engines do."""
    best = best_per_title(rows)
    if candidate_limit is not None:
        best = best.orderBy("title_normalized", F.coalesce("brand", F.lit(""))).limit(candidate_limit)
    return best.orderBy("distance", "product_uid").offset(offset).limit(limit)


def with_store(products: DataFrame, stores: DataFrame) -> DataFrame:
    """Stores are a small dimension; Spark broadcasts them while they are below its threshold, and shuffles beyond."""
    return products.join(stores.select(F.col("slug").alias("store_slug"), "last_crawl"), "store_slug")


def search(products: DataFrame, stores: DataFrame, filters: Filters, embedding=None, text: str = "", limit: int = 12, offset: int = 0, candidate_limit: int | None = None) -> DataFrame:
    _checked(limit, offset)
    kept = with_store(products, stores).where(_all([*hard_conditions(filters), *soft_conditions(filters).values()]))
    return shaped(page(ranked(kept, embedding, text), limit, offset, candidate_limit))


def search_relaxed(products: DataFrame, stores: DataFrame, filters: Filters, embedding=None, text: str = "", limit: int = 12) -> DataFrame:
    """search(), letting go of filters in RELAX_ORDER until something is found, in one pass.

    A row's level is the last filter in that order that it fails; the rows of the lowest level are what the first
    successful relaxation finds. Levels are ranked apart, so the best of the lowest come first in one scan, and of the page
    (`limit` rows) only its lowest level stays. `relaxed` names the filters let go of.
    """
    _checked(limit, 0)
    soft = soft_conditions(filters)
    order = [f for f in RELAX_ORDER if f in soft]
    level = F.greatest(F.lit(0), F.lit(0), *(F.when(~F.coalesce(soft[f], F.lit(False)), i + 1).otherwise(0) for i, f in enumerate(order)))
    rows = ranked(with_store(products, stores).where(_all(hard_conditions(filters))), embedding, text).withColumn("level", level)
    w = Window.partitionBy("level", "title_normalized", F.coalesce("brand", F.lit(""))).orderBy("distance", "product_uid")
    best = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy("level", "distance", "product_uid").limit(limit)
    found = best.withColumn("_lowest", F.min("level").over(Window.partitionBy())).where("level = _lowest").drop("_lowest")
    names = F.array(*(F.lit(f"{f}={getattr(filters, f)}") for f in order)) if order else F.array().cast("array<string>")
    return found.orderBy("distance", "product_uid").withColumn("relaxed", F.slice(names, F.lit(1), F.col("level")))


def relaxed_by_loop(products: DataFrame, stores: DataFrame, filters: Filters, embedding=None, text: str = "", limit: int = 12) -> tuple[DataFrame, list[str]]:
    """The same by trying again and again; for comparison."""
    gone: list[str] = []
    rows = search(products, stores, filters, embedding, text, limit)
    for f in [f for f in RELAX_ORDER if getattr(filters, f)]:
        if not rows.isEmpty():
            break
        gone.append(f"{f}={getattr(filters, f)}")
        filters = replace(filters, **{f: None})
        rows = search(products, stores, filters, embedding, text, limit)
    return rows, gone


def shaped(rows: DataFrame) -> DataFrame:
    """Prices in units of currency, three images, the distance rounded."""
    out = rows.withColumn("price", F.col("price_min_cents") / 100).withColumn("distance", F.round("distance", 4))
    if "price_retail_cents" in rows.columns:
        out = out.withColumn("price_retail", F.nullif(F.col("price_retail_cents"), F.lit(0)) / 100)
    if "images" in rows.columns:
        urls = F.filter(F.transform("images", lambda i: i["url"]), lambda u: u.isNotNull())
        out = out.withColumns({"images": F.slice(urls, 1, 3), "image": F.get(urls, F.lit(0))})
    return out


def facets(rows: DataFrame, used: tuple[str, ...] = (), title: str = "title", description: str | None = "description", most_options: int = 4, most_axes: int = 2) -> DataFrame:
    """axis, position, option, n: refinements that some but not all of the rows mention, by one aggregation.

    Up to four options by count (ties in vocabulary order) for each axis with two or more, on the first two such axes.
    """
    spark = rows.sparkSession
    columns = [F.coalesce(F.col(c), F.lit("")) for c in (title, description) if c]
    text = F.lower(fold(F.concat_ws(" ", *columns)))
    terms = [(axis, i, label, keys) for axis in V.AXES if axis not in used for i, (label, keys) in enumerate(V.AXES[axis].items())]
    if not terms:
        return spark.createDataFrame([], "axis string, position int, option string, n long")
    hit = lambda keys: reduce(lambda a, b: a | b, (F.contains(F.col("_text"), F.lit(fold_literal(k))) for k in dict.fromkeys(map(fold_literal, keys))))
    counts = rows.select(text.alias("_text")).agg(F.count("*").alias("total"), *(F.count_if(hit(keys)).alias(f"t{j}") for j, (*_, keys) in enumerate(terms)))
    entries = F.array(*(F.struct(F.lit(list(V.AXES).index(a)).alias("axis_no"), F.lit(a).alias("axis"), F.lit(i).alias("term_no"), F.lit(label).alias("option"), F.col(f"t{j}").alias("n")) for j, (a, i, label, _) in enumerate(terms)))
    found = counts.select("total", F.explode(entries).alias("e")).where((F.col("e.n") > 0) & (F.col("e.n") < F.col("total"))).select("e.*")
    by_count = Window.partitionBy("axis").orderBy(F.desc("n"), "term_no")
    found = found.withColumn("position", F.row_number().over(by_count)).withColumn("_terms", F.count("*").over(Window.partitionBy("axis"))).where("_terms >= 2")
    return (
        found.withColumn("_axis", F.dense_rank().over(Window.orderBy("axis_no")))
        .where((F.col("_axis") <= most_axes) & (F.col("position") <= most_options))
        .select("axis", "position", "option", "n")
    )


def whole_word(column: str, token: str) -> Column:
    return F.col(column).rlike(word([token]))
