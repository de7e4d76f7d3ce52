"""Reading what crawls have landed: JSON lines, CSV, lists, sitemaps, dumps, and URL inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clean, fold
from ..operators.running import before


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Strict: a broken line fails the read. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows and broken lines, by one schema with a column for the line that does not parse."""
    whole = StructType(list(schema.fields)).add("_broken", "string")
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
    return rows.where(F.col("_broken").isNull()).drop("_broken"), rows.where(F.col("_broken").isNotNull()).select("_broken")


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def brand_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines `Brand` or `Brand=domain`; what follows # is a comment."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    parts = F.split(line, "=", 2)
    return spark.read.text(path).where(line != "").select(F.trim(parts[0]).alias("brand"), F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("domain"))


def sitemap_urls(pages: DataFrame, body: str = "body", position: str = "position") -> DataFrame:
    """url, child: what the sitemaps list, each address once, in order of first appearance; children are sitemaps too."""
    found = pages.select(F.col(position), F.posexplode(F.regexp_extract_all(body, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("at", "url"))
    first = found.groupBy("url").agg(F.min(F.struct(position, "at")).alias("first"))
    return first.select("url", F.col("url").rlike(r"(?i)\.xml(\.gz)?(\?.*)?$").alias("child"), "first")


def sitemap_entries(pages: DataFrame, body: str = "body") -> DataFrame:
    """url, lastmod of every entry that has both."""
    entry = r"(?s)<url>\s*<loc>\s*([^<\s]+)\s*</loc>\s*<lastmod>\s*([^<\s]+)\s*</lastmod>"
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(entry), 1).alias("url"), F.regexp_extract_all(body, F.lit(entry), 2).alias("lastmod"))
    return pages.select(F.explode(pairs).alias("e")).select("e.url", "e.lastmod")


def sitemap_number(url: Column) -> Column:
    """The number that orders the files of a sitemap index; files without one come first."""
    return F.coalesce(F.regexp_extract(url, r"/(\d+)\.xml$", 1).try_cast("long"), F.lit(0))


#: What product addresses look like, and what never is one.
LIKELY = r"(?i)/(producto|productos|product|products|item|shop|tienda|p)/"
NEVER = (
    r"(?i)/(blog|nota|noticias?|prensa|ayuda|faq|contacto|terminos|privacidad|cuenta|carrito|checkout|login|categoria|category|coleccion|collections?)/|\.(pdf|jpg|png|webp)$"
)


class TooMany(ValueError):
    """More addresses than are taken."""


def likely_first(urls: DataFrame, url: str = "url", position: str = "position", most: int = 8000, beyond: str = "leave") -> DataFrame:
    """Addresses worth fetching, likely products first, each part in its own order.

    Of more than `most` the last are left (count_left says how many), or with beyond="raise" refused.
    """
    if beyond == "raise" and (left := count_left(urls, url, most)):
        raise TooMany(f"{left} addresses beyond {most}")
    return urls.where(~F.col(url).rlike(NEVER)).orderBy(~F.col(url).rlike(LIKELY), position).limit(most)


def count_left(urls: DataFrame, url: str = "url", most: int = 8000) -> int:
    """How many addresses worth fetching likely_first leaves."""
    return max(0, urls.where(~F.col(url).rlike(NEVER)).count() - most)


#: Misses in a row, without a hit before, after which a shop is given up.
HOPELESS = 60


def until_hopeless(pages: DataFrame, url: str = "url", position: str = "position", hit: str = "hit", misses: int = HOPELESS) -> DataFrame:
    """The pages that are asked for, in the order of likely_first: after so many misses and not one hit the rest is left.

    hit: true for a product, false for none, null for a page that failed, which counts as neither. Positions are each once and
    not below zero. Running counts are by blocks (running.py), so no task has all rows.
    """
    # The unlikely come behind all of the likely.
    place = F.col(position) + F.when(F.col(url).rlike(LIKELY), 0).otherwise(1 << 40)
    counts = {"_misses": (F.col(hit) == F.lit(False)), "_hits": F.col(hit)}
    counted = before(pages.where(~F.col(url).rlike(NEVER)).withColumn("_place", place), "_place", {k: F.when(c, 1).otherwise(0) for k, c in counts.items()})
    stop = counted.where((F.col("_hits") == 0) & (F.col("_misses") >= misses)).agg(F.min("_place")).first()[0]
    return (counted if stop is None else counted.where(F.col("_place") < stop)).orderBy("_place").drop("_place", *counts)


def from_url(url: Column) -> Column:
    """struct(external_id, handle, title_guess) of an address /p/{id}-{slug}; null for others."""
    pattern = r"/p/(\d+)-([^/?#]+)"
    slug = F.regexp_extract(url, pattern, 2)
    return F.when(url.rlike(pattern), F.struct(F.regexp_extract(url, pattern, 1).alias("external_id"), slug.alias("handle"), F.initcap(clean(F.replace(slug, F.lit("-"), F.lit(" ")))).alias("title_guess")))


def inventory(urls: DataFrame, url: str = "url") -> DataFrame:
    """One row per product id, from addresses alone."""
    found = urls.withColumn("_p", from_url(F.col(url))).where(F.col("_p").isNotNull())
    return found.groupBy(F.col("_p.external_id").alias("external_id")).agg(F.min_by(F.struct(F.col("_p.handle"), F.col("_p.title_guess"), F.col(url)), F.col(url)).alias("v")).select("external_id", "v.handle", "v.title_guess", F.col(f"v.{url}").alias("url"))


def dump_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows by table of a plain or compressed SQL dump: lines between a COPY line and the line that ends it."""

    def count(batches):
        import pyarrow as pa

        table, counts = None, {}
        for b in batches:
            for line in b.column("value").to_pylist():
                if table is None:
                    if line.startswith("COPY "):
                        table = line.split()[1]
                        counts.setdefault(table, 0)
                elif line == "\\.":
                    table = None
                else:
                    counts[table] += 1
        yield pa.RecordBatch.from_pydict({"table": list(counts), "n": list(counts.values())}, schema=pa.schema([("table", pa.string()), ("n", pa.int64())]))

    # One dump is one stream: its lines mean something in order only, and a compressed file is read by one task anyway.
    return spark.read.text(path, wholetext=False).coalesce(1).mapInArrow(count, "table string, n long")


def domain_candidates(brand: Column) -> Column:
    """Addresses that a brand's shop may have."""
    slug = F.regexp_replace(F.lower(fold(clean(brand))), "[^a-z0-9]+", "")
    dashed = F.regexp_replace(F.regexp_replace(F.lower(fold(clean(brand))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.array_distinct(F.array(*(F.concat(s, F.lit(end)) for end in (".com.ar", ".com", ".ar") for s in (slug, dashed))))


#: Signatures of shop platforms in markup, and the platform known by host.
HOSTS = {"avellaneda": r"(?i)avellanedaa(?:un|l)toque\.com"}
SIGNATURES = {
    "tiendanube": r"(?i)tiendanube|nuvemshop|mitiendanube\.com", "shopify": r"(?i)cdn\.shopify\.com|Shopify\.theme", "vtex": r"(?i)vtexassets\.com|vtexcommercestable",
    "woocommerce": r"(?i)woocommerce|wp-content/plugins/woo", "empretienda": r"(?i)empretienda", "magento": r"(?i)Magento_|mage/cookies",
}


def platform(html: Column, domain: Column) -> Column:
    """By host, else the signature found most often, at least three times; ties to the first in order."""
    known = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in HOSTS.items():
        known = known.when(domain.rlike(pattern), F.lit(name))
    hits = [F.struct(F.regexp_count(html, F.lit(p)).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, p) in enumerate(SIGNATURES.items())]
    best = F.array_max(F.array(*hits))
    return F.coalesce(known, F.when(best["n"] >= 3, best["name"]), F.lit("unknown"))
