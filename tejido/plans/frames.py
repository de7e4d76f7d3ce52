"""Catalogue frames derived from the analytic tables, each with its DuckDB text, so that queries run at any scale."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_title

NOW = "2024-01-31 00:00:00"
GARMENTS = ("Vestido", "Jean", "Pantalón cargo", "Pollera de jean", "Remera", "Buzo con capucha", "Campera", "Zapatilla", "Cartera", "Collar", "Sábanas de lino", "Termo")
COLORS = ("negro", "Bordó", "off white", "verde oliva", "azul", "crudo", "42")
GENDERS = ("women", "men", "kids", "unknown", "women", "women", "unisex")
CATEGORIES = ("dresses", "jeans", "pants", "skirts", "tops", "knitwear", "outerwear", "shoes", "bags", "jewelry", None, None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(values, key: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), (key % len(values)).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_at(values, key: str) -> str:
    return f"({sql_list(values)})[1 + ({key}) % {len(values)}]"


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product columns that searches and checks read, from part."""
    k = F.col("p_partkey")
    title = F.concat_ws(" ", at(GARMENTS, k), at(COLORS, k), "p_name")
    slug = F.when(k % 10 == 9, "avellaneda").otherwise(F.concat(F.lit("tienda"), (k % 10).cast("string")))
    color = at(COLORS, k)
    cents = F.bround(F.col("p_retailprice") * 100).cast("long")
    v = lambda i, c, ok: F.struct(F.lit(str(i)).alias("external_id"), F.struct(c.alias("raw"), F.when(c == "negro", "black").otherwise(F.lit(None).cast("string")).alias("normalized")).alias("color"), F.when(ok, "in_stock").otherwise("out_of_stock").alias("availability"))
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("product_uid"), k.alias("key"), slug.alias("store_slug"), title.alias("title"), normalize_title(title).alias("title_normalized"), F.col("p_brand").alias("brand"),
        at(CATEGORIES, k).alias("category"), at(GENDERS, k).alias("gender"), cents.alias("price_min_cents"), F.when(k % 4 == 0, cents + 5000).when(k % 4 == 1, cents - 100).alias("compare_at_cents"),
        F.when(k % 3 == 0, F.concat(F.lit("Tela "), F.col("p_type"), F.lit(" con tajo y bordado de lino"))).alias("description"),
        F.when(k % 5 == 0, F.lit("prenda oversize de algodón liso")).alias("description_ia"), F.when(k % 6 != 0, F.lit(1)).alias("embedding"),
        F.when(k % 5 == 0, F.lit(1)).alias("description_ia_at"), F.when(k % 10 == 0, F.lit(1)).alias("embedding_ia_at"),
        F.when(k % 5 != 0, "in_stock").otherwise("out_of_stock").alias("availability"), F.array(F.col("p_size").cast("string"), (F.col("p_size") + 2).cast("string")).alias("sizes_available"),
        F.array(v(0, color, k % 2 == 0), v(1, F.lit("6"), F.lit(True))).alias("variants"), F.when(k % 7 != 0, F.array(F.struct(F.concat(F.lit("https://img/"), k.cast("string")).alias("url")))).otherwise(F.array().cast("array<struct<url:string>>")).alias("images"),
        F.concat(F.lit("https://shop/p/"), k.cast("string"), F.lit("-item")).alias("url"), F.expr(f"TIMESTAMP '{NOW}' - make_interval(0, 0, 0, 0, cast(p_partkey % 48 as int), 0, 0)").alias("scraped_at"),
        F.when(k % 10 == 9, F.concat(F.lit("Local "), (k % 20).cast("string"))).alias("seller"), "p_size", "p_type", "p_name",
    )


PRODUCT_SQL = f"""product AS (
  SELECT cast(p_partkey AS VARCHAR) AS product_uid, p_partkey AS key,
    CASE WHEN p_partkey % 10 = 9 THEN 'avellaneda' ELSE 'tienda' || (p_partkey % 10) END AS store_slug,
    {sql_at(GARMENTS, 'p_partkey')} || ' ' || {sql_at(COLORS, 'p_partkey')} || ' ' || p_name AS title,
    trim(regexp_replace(lower(strip_accents({sql_at(GARMENTS, 'p_partkey')} || ' ' || {sql_at(COLORS, 'p_partkey')} || ' ' || p_name)), '[^a-z0-9]+', ' ', 'g')) AS title_normalized,
    p_brand AS brand, {sql_at(CATEGORIES, 'p_partkey')} AS category, {sql_at(GENDERS, 'p_partkey')} AS gender,
    cast(round_even(p_retailprice * 100, 0) AS BIGINT) AS price_min_cents,
    CASE WHEN p_partkey % 4 = 0 THEN cast(round_even(p_retailprice * 100, 0) AS BIGINT) + 5000 WHEN p_partkey % 4 = 1 THEN cast(round_even(p_retailprice * 100, 0) AS BIGINT) - 100 END AS compare_at_cents,
    CASE WHEN p_partkey % 3 = 0 THEN 'Tela ' || p_type || ' con tajo y bordado de lino' END AS description,
    CASE WHEN p_partkey % 5 = 0 THEN 'prenda oversize de algodón liso' END AS description_ia,
    CASE WHEN p_partkey % 6 <> 0 THEN 1 END AS embedding, CASE WHEN p_partkey % 5 = 0 THEN 1 END AS description_ia_at, CASE WHEN p_partkey % 10 = 0 THEN 1 END AS embedding_ia_at,
    CASE WHEN p_partkey % 5 <> 0 THEN 'in_stock' ELSE 'out_of_stock' END AS availability,
    [cast(p_size AS VARCHAR), cast(p_size + 2 AS VARCHAR)] AS sizes_available, {sql_at(COLORS, 'p_partkey')} AS color,
    p_partkey % 7 <> 0 AS has_image, 'https://shop/p/' || p_partkey || '-item' AS url,
    TIMESTAMP '{NOW}' - to_hours(p_partkey % 48) AS scraped_at,
    CASE WHEN p_partkey % 10 = 9 THEN 'Local ' || (p_partkey % 20) END AS seller, p_size, p_type, p_name
  FROM part)"""


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten stores; the last crawl of the first is unknown."""
    k = F.col("id")
    return spark.range(10).select(
        F.when(k == 9, "avellaneda").otherwise(F.concat(F.lit("tienda"), k.cast("string"))).alias("slug"), F.concat(F.lit("Tienda "), k.cast("string")).alias("name"),
        F.when(k > 0, F.lit(NOW).cast("timestamp")).alias("last_crawl"),
    )


STORE_SQL = f"""store AS (SELECT CASE WHEN i = 9 THEN 'avellaneda' ELSE 'tienda' || i END AS slug, 'Tienda ' || i AS name, CASE WHEN i > 0 THEN TIMESTAMP '{NOW}' END AS last_crawl FROM range(10) t(i))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price points from events: users are products, events their observations."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("product_uid"), F.col("event_id").cast("string").alias("variant_external_id"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.bround(F.col("value") * 100).cast("long").alias("amount_cents"),
    )


POINT_SQL = "point AS (SELECT cast(user_id AS VARCHAR) AS product_uid, cast(event_id AS VARCHAR) AS variant_external_id, ts AS observed_at, cast(round_even(value * 100, 0) AS BIGINT) AS amount_cents FROM events)"


def trigram_sql(x: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def similarity_sql(x: str, y: str) -> str:
    a, b = trigram_sql(x), trigram_sql(y)
    return f"(len(list_intersect({a}, {b})) * 1.0 / len(list_distinct(list_concat({a}, {b}))))"


def shared_folder(spark) -> str:
    """Where driver and executors both see files (spark.checkpoint.dir); unset, as in local tests, a temporary folder stands in."""
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _files(spark, path: str) -> list:
    """What is at a path: the file, or the files of the folder; nothing if nothing is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f for f in fs.listStatus(where) if f.isFile()] if fs.exists(where) else []


def state_of(spark, path: str, oldest: bool = False) -> str:
    """Names a table as it stands: its files, their sizes and times. oldest: by its oldest file only, so that a table that files are added to keeps its name."""
    said = sorted((f.getModificationTime(), f.getPath().toString(), f.getLen()) for f in _files(spark, path))
    return hashlib.sha256(repr((path, said[:1] if oldest else said)).encode()).hexdigest()[:32]


def kept_index(spark, sf_dir: str, name: str, last: str, build, *tables: str) -> str:
    """The folder of an index over the tables as they stand, built by build(folder) unless it is there. last: what is written last."""
    state = hashlib.sha256("".join(state_of(spark, f"{sf_dir}/{t}.parquet") for t in tables).encode()).hexdigest()[:32]
    folder = f"{shared_folder(spark)}/indexes/{name}-{state}"
    if not _files(spark, f"{folder}/{last}/_SUCCESS"):
        build(folder)
    return folder
