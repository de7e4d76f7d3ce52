"""Queries over tables that change: upserts, appends, diffs, subsets, streams; and the platform mappers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import analytics as A
from ..operators import onboarding as O
from ..operators import storage as K
from ..sources import platforms as P
from ..sources.pages import once
from ..streaming import price_stream as T
from .frames import COLORS, GARMENTS, NOW, POINT_SQL, PRODUCT_SQL, STORE_SQL, at, points, products, shared_folder, sql_at, state_of, stores, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


_TS = f"TIMESTAMP '{NOW}'"
_OLD = "old AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS kept FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "new AS (SELECT o_orderkey AS k, 'X' AS status, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 2 = 0)"


def _old_new(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("kept"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit("X").alias("status"), (F.col("o_totalprice") + 1).alias("price"))
    return old, new


@query(f"WITH {_OLD}, {_NEW} SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.status ELSE o.status END AS status, CASE WHEN n.k IS NOT NULL THEN n.price ELSE o.price END AS price, CASE WHEN o.k IS NOT NULL THEN o.kept ELSE 'first' END AS kept FROM old o FULL JOIN new n ON o.k = n.k")
def upsert_merge(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return K.upsert(old, new, ["k"], preserved={"kept": F.lit("first")})


@query(f"WITH {_OLD}, {_NEW} SELECT coalesce(n.k, o.k) AS k, CASE WHEN o.k IS NOT NULL THEN o.status ELSE n.status END AS status, CASE WHEN n.k IS NOT NULL THEN n.price ELSE o.price END AS price, o.kept AS kept FROM old o FULL JOIN new n ON o.k = n.k")
def upsert_some_columns(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return K.upsert(old, new, ["k"], update_only=["price"])


@query(f"WITH {POINT_SQL} SELECT product_uid, variant_external_id, observed_at, amount_cents FROM point WHERE variant_external_id::BIGINT % 4 = 0")
def price_point_append(spark, sf_dir):
    """Three quarters are there already; what is new comes twice."""
    p = points(spark, sf_dir)
    there = p.where(F.col("variant_external_id").cast("long") % 4 != 0)
    return K.new_points(p.unionByName(p), there).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def hash_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.col("o_totalprice").cast("string")).alias("content_hash"))
    before = o.where("o_orderkey % 3 <> 0").withColumn("content_hash", F.when(F.col("o_orderkey") % 5 == 0, "old").otherwise(F.col("content_hash")))
    return K.changed(o, before, "o_orderkey").select("o_orderkey")


@query(f"WITH {PRODUCT_SQL}, {STORE_SQL}, seen AS (SELECT store_slug AS slug, max(scraped_at) AS at FROM product GROUP BY 1) SELECT slug, name, coalesce(seen.at, last_crawl) AS last_crawl FROM store LEFT JOIN seen USING (slug)")
def seal_last_crawl(spark, sf_dir):
    return K.seal(stores(spark, sf_dir), products(spark, sf_dir)).select("slug", "name", F.col("last_crawl").cast("timestamp_ntz").alias("last_crawl"))


@query("SELECT o_custkey AS run_id, max(o_orderdate) AS finished_at FROM orders GROUP BY 1")
def crawl_run_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("finished_at"))
    return K.finish_runs(o).select("run_id", F.coalesce("finished_at", "started_at").alias("finished_at"))


@query(f"WITH {PRODUCT_SQL} SELECT product_uid FROM product WHERE embedding IS NULL OR (description_ia IS NOT NULL AND embedding_ia_at IS DISTINCT FROM description_ia_at)")
def pending_embedding(spark, sf_dir):
    return K.pending_embedding(products(spark, sf_dir)).select("product_uid")


@query(f"WITH {PRODUCT_SQL} SELECT product_uid, title, 'https://img/' || key AS image_url, store_slug FROM product WHERE (description IS NULL OR length(trim(description)) < 20) AND description_ia IS NULL AND has_image")
def pending_description(spark, sf_dir):
    return K.pending_description(products(spark, sf_dir))


@query(f"WITH {PRODUCT_SQL} SELECT product_uid, CASE WHEN key % 9 = 0 THEN 7 ELSE embedding END AS embedding, CASE WHEN key % 9 = 0 THEN description_ia_at ELSE embedding_ia_at END AS embedding_ia_at FROM product")
def set_embeddings(spark, sf_dir):
    p = products(spark, sf_dir)
    return K.set_embeddings(p, p.where("key % 9 = 0").select("product_uid", F.lit(7).alias("embedding"))).select("product_uid", "embedding", "embedding_ia_at")


@query(f"WITH {PRODUCT_SQL} (SELECT product_uid, store_slug FROM product WHERE store_slug IN ('tienda1', 'tienda2')) UNION ALL (SELECT product_uid, store_slug FROM product WHERE store_slug = 'avellaneda' ORDER BY scraped_at DESC, product_uid LIMIT 50)")
def demo_subset(spark, sf_dir):
    return K.subset(products(spark, sf_dir), ["tienda1", "tienda2"], {"avellaneda": 50}, F.desc("scraped_at")).select("product_uid", "store_slug")


@query(f"WITH {PRODUCT_SQL}, picked AS (SELECT key FROM product WHERE store_slug = 'tienda1') SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT key FROM picked)")
def demo_dependents(spark, sf_dir):
    picked = products(spark, sf_dir).where("store_slug = 'tienda1'").select("key")
    return table(spark, sf_dir, "lineitem").join(picked, F.col("l_partkey") == F.col("key"), "left_semi").select("l_orderkey", "l_linenumber")


@query(f"WITH {PRODUCT_SQL} SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN (SELECT key FROM product WHERE key % 2 = 0) p ON p.key = l_partkey WHERE p.key IS NULL")
def orphan_check(spark, sf_dir):
    parents = products(spark, sf_dir).where("key % 2 = 0").select(F.col("key").alias("l_partkey"))
    return K.orphans(table(spark, sf_dir, "lineitem"), parents, "l_partkey").select("l_orderkey", "l_linenumber")


@query(f"WITH {PRODUCT_SQL}, {POINT_SQL} SELECT product_uid, title, (SELECT count(*) FROM lineitem WHERE l_partkey = 7) AS variants, least(60, (SELECT count(*) FROM point WHERE product_uid = '7')) AS history, (SELECT max(observed_at) FROM point WHERE product_uid = '7') AS newest FROM product WHERE product_uid = '7'")
def product_detail(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("product_uid"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("external_id"), "l_extendedprice")
    d = A.detail(products(spark, sf_dir), v, points(spark, sf_dir), "7")
    return d.select("product_uid", "title", F.size("variants").cast("long").alias("variants"), F.size("history").cast("long").alias("history"), F.col("history")[0]["observed_at"].cast("timestamp_ntz").alias("newest"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0")
def pending_urls(spark, sf_dir):
    """All addresses less those done or skipped."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    done, skipped = o.where("o_orderkey % 4 = 0"), o.where("o_orderkey % 8 = 0")
    return o.join(done.union(skipped).distinct(), "o_orderkey", "left_anti")


def _through_stream(spark: SparkSession, sf_dir: str, name: str, build, mode: str) -> DataFrame:
    """Runs a stream over the events table's files to their end; Parquet parts and the stream's progress go to the shared folder.

    The folder goes by the query and the table (its oldest file), so a run that broke is gone on with, and files that came since are all that is
    read. Complete results are written once for each micro-batch, under its number, so a batch that is run again replaces its
    own rows; the newest number in the folder has the result.
    """
    source = f"{sf_dir}/events.parquet"
    at = f"{shared_folder(spark)}/streams/{name}-{state_of(spark, source, oldest=True)}"
    schema = spark.read.parquet(source).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/[e]vents.parquet")
    out = build(events)
    sink = out.writeStream.option("checkpointLocation", f"{at}/progress").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        sink.format("parquet").option("path", f"{at}/rows").start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{at}/rows")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    sink.foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(StructType([*out.schema.fields, StructField("batch", LongType())])).parquet(f"{at}/rows")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    out = _through_stream(spark, sf_dir, "window-counts", T.window_counts, "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id FROM events")
def stream_dedup_append(spark, sf_dir):
    """Every event comes twice and is appended once."""
    return _through_stream(spark, sf_dir, "dedup-append", lambda e: T.once(e.unionByName(e), ["event_id"]), "append").select("event_id", "user_id")


_HOST_EVENTS = "e AS (SELECT cast(user_id % 20 AS VARCHAR) AS host, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS i, CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status, value / 100 AS latency FROM events)"


@query(
    f"""WITH RECURSIVE {_HOST_EVENTS},
    s AS (SELECT DISTINCT host, 0::BIGINT AS i, 4 AS concurrency, 4 AS peak, 0 AS streak, [NULL::DOUBLE][2:] AS recent, NULL::DOUBLE AS best, 0::BIGINT AS ok, 0::BIGINT AS stressed FROM e
    UNION ALL SELECT host, i, CASE WHEN bad THEN greatest(1, concurrency // 2) WHEN up THEN concurrency + 1 ELSE concurrency END, CASE WHEN up THEN greatest(peak, concurrency + 1) ELSE peak END,
        CASE WHEN bad OR due THEN 0 ELSE streak END, recent, best, ok, stressed FROM (
        SELECT *, due AND NOT (best > 0 AND list_sort(recent)[1 + len(recent) // 2] > best * 2.5) AS up FROM (
            SELECT *, NOT bad AND streak >= 40 AND concurrency < 32 AS due FROM (
                SELECT s.host, e.i, e.status = 503 AS bad, s.concurrency, s.peak, s.streak + 1 AS streak, CASE WHEN e.status = 503 THEN s.recent ELSE list_append(s.recent, e.latency)[-40:] END AS recent,
                    CASE WHEN e.status = 503 THEN s.best ELSE least(coalesce(s.best, e.latency), e.latency) END AS best, s.ok + (e.status = 200)::BIGINT AS ok, s.stressed + (e.status = 503)::BIGINT AS stressed
                FROM s JOIN e ON e.host = s.host AND e.i = s.i + 1))))
    SELECT host, arg_max(concurrency, i) AS concurrency, max(peak) AS peak, max(ok) AS ok, max(stressed) AS stressed, 0::BIGINT AS failed FROM s GROUP BY host"""
)
def rate_controller(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("host"), "ts", "event_id", F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"), (F.col("value") / 100).alias("latency"))
    return T.rate_controller(e, tie="event_id")


@query(
    """WITH RECURSIVE p AS (SELECT p_partkey % 10 AS store, p_partkey, p_name AS model, cast(p_partkey % 77 AS VARCHAR) AS id, row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY p_partkey) AS i FROM part),
    s AS (SELECT DISTINCT store, 0::BIGINT AS i, NULL::BIGINT AS p_partkey, NULL::VARCHAR AS model, NULL::VARCHAR AS id, false AS stays, ['']::VARCHAR[] AS models, ['']::VARCHAR[] AS ids FROM p
    UNION ALL SELECT store, i, p_partkey, model, id, stays, CASE WHEN stays THEN list_append(models, model) ELSE models END, CASE WHEN stays THEN list_append(ids, id) ELSE ids END FROM (
        SELECT s.store, p.i, p.p_partkey, p.model, p.id, s.models, s.ids, NOT list_contains(s.models, p.model) AND NOT list_contains(s.ids, p.id) AS stays FROM s JOIN p ON p.store = s.store AND p.i = s.i + 1))
    SELECT store, p_partkey, model, id FROM s WHERE stays"""
)
def two_key_dedup(spark, sf_dir):
    """The first row of each model and of each id, in order, within a store."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("store"), "p_partkey", F.col("p_name").alias("model"), (F.col("p_partkey") % 77).cast("string").alias("id"))
    return A.keep_first_of_two_keys(p, "store", "p_partkey", "model", "id")


# --- platform mappers: raw shop records made from part, mapped, and compared with what they were made from

_TITLE = f"{sql_at(GARMENTS, 'p_partkey')} || ' ' || p_name"
_CENTS = "cast(round_even(p_retailprice * 100, 0) AS BIGINT)"
_COLOR = sql_at(COLORS, "p_partkey")
_FAMILY = sql_at(("black", "red", "white", "green", "blue", "white", None), "p_partkey")


#: Parts that one task makes into shop records and maps, a millisecond or less each.
_A_TASK = 5000


def _base(spark, sf_dir) -> DataFrame:
    """Parts, dealt out by their number: they have few bytes for the work on them, so that files and shuffles split by size give few tasks."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    dealt = part.repartition(part.count() // _A_TASK + 1, "p_partkey")
    # By `once`, since a mapper's filters would otherwise go below the dealing, with all the parsing that they need.
    return once(dealt, t=F.concat_ws(" ", at(GARMENTS, k), "p_name"), c=at(COLORS, k), price=F.bround("p_retailprice", 2), handle=F.concat(F.lit("item-"), k.cast("string")), ok=k % 3 != 0)


def _digest(mapped: DataFrame) -> DataFrame:
    v = F.col("variants")
    return mapped.select(
        "product_uid", "title", F.col("price_min.amount_cents").alias("low"), F.col("price_max.amount_cents").alias("high"), F.col("price_min.compare_at_cents").alias("listed"), "availability",
        F.size(v).cast("long").alias("n_variants"), v[0]["color"]["normalized"].alias("color"), v[0]["size"]["normalized"].alias("size"), F.array_join("sizes_available", ",").alias("sizes"),
    )


_SIZE_OK = "CASE WHEN p_size < 1 THEN NULL ELSE cast(p_size AS VARCHAR) END"
_STATE = "CASE WHEN p_partkey % 3 <> 0 THEN 'in_stock' ELSE 'out_of_stock' END"
_TWO = f"CASE WHEN p_partkey % 3 <> 0 THEN {_SIZE_OK} ELSE '' END"


@query(
    f"SELECT 'shop:' || p_partkey AS product_uid, {_TITLE} AS title, {_CENTS} AS low, {_CENTS} + 1000 AS high, {_CENTS} + 5000 AS listed, {_STATE} AS availability, 2::BIGINT AS n_variants, {_FAMILY} AS color, {_SIZE_OK} AS size, {_TWO} AS sizes FROM part WHERE p_partkey % 11 <> 0"
)
def map_shopify(spark, sf_dir):
    money = lambda c: F.format_string("%.2f", c)
    v = lambda i, extra, ok: F.struct(
        (F.col("p_partkey") * 10 + i).alias("id"), F.col("c").alias("option1"), F.col("p_size").cast("string").alias("option2"), F.lit(None).cast("string").alias("option3"), F.lit("S").alias("sku"),
        F.struct(F.lit(None).cast("string").alias("src")).alias("featured_image"), ok.alias("available"), money(F.col("price") + extra).alias("price"), F.when(F.lit(i) == 0, money(F.col("price") + 50)).otherwise("0.00").alias("compare_at_price"),
    )
    raw = _base(spark, sf_dir).select(
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_partkey")).alias("id"), F.col("t").alias("title"), "handle", F.lit("<p>hola</p>").alias("body_html"), F.lit("Marca").alias("vendor"), F.lit("").alias("product_type"), F.array(F.lit("a")).alias("tags"),
        F.array(F.struct(F.lit("Color").alias("name")), F.struct(F.lit("Talle").alias("name"))).alias("options"), F.array(v(0, 0, F.col("ok")), v(1, 10, F.lit(False))).alias("variants"), F.array().cast("array<struct<src:string,position:int,width:int,height:int>>").alias("images"),
    )
    landed = raw.select(F.to_json(F.struct("*")).alias("line")).select(F.from_json("line", P.SHOPIFY).alias("r")).select("r.*")
    return _digest(P.shopify(landed.where("id IS NOT NULL"), "shop", "shop.com", "Tienda"))


@query(
    f"SELECT 'vtex:' || p_partkey AS product_uid, {_TITLE} AS title, {_CENTS} AS low, {_CENTS} AS high, {_CENTS} + 5000 AS listed, {_STATE} AS availability, 1::BIGINT AS n_variants, {_FAMILY} AS color, {_SIZE_OK} AS size, {_TWO} AS sizes FROM part"
)
def map_vtex(spark, sf_dir):
    offer = F.struct(F.struct(F.col("price").alias("Price"), (F.col("price") + 50).alias("ListPrice"), F.lit(3).alias("AvailableQuantity"), F.col("ok").alias("IsAvailable")).alias("commertialOffer"))
    item = F.struct(F.col("p_partkey").cast("string").alias("itemId"), F.array(F.lit("Color"), F.lit("Talle")).alias("variations"), F.array("c").alias("Color"), F.array(F.col("p_size").cast("string")).alias("Talle"), F.array(offer).alias("sellers"))
    raw = _base(spark, sf_dir).select(F.to_json(F.struct(F.col("p_partkey").cast("string").alias("productId"), F.col("t").alias("productName"), F.col("handle").alias("linkText"), F.array(F.lit("/Ropa/Varios/")).alias("categories"), F.array(item).alias("items"))).alias("line"))
    return _digest(P.vtex(raw.select(F.from_json("line", P.VTEX).alias("r")).select("r.*"), "vtex", "v.com", "Tienda"))


@query(
    f"SELECT 'mag:k' || p_partkey AS product_uid, {_TITLE} AS title, {_CENTS} AS low, {_CENTS} AS high, CASE WHEN p_partkey % 2 = 0 THEN {_CENTS} + 5000 END AS listed, {_STATE} AS availability, 1::BIGINT AS n_variants, CASE WHEN p_partkey % 4 <> 1 THEN {_FAMILY} END AS color, CASE WHEN p_partkey % 4 <> 1 THEN {_SIZE_OK} END AS size, CASE WHEN p_partkey % 4 <> 1 THEN {_TWO} ELSE '' END AS sizes FROM part"
)
def map_magento(spark, sf_dir):
    """Every fourth is a simple product; variants have no price of their own."""
    own = F.struct(F.struct(F.struct(F.col("price").alias("value")).alias("final_price"), F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("price") + 50).otherwise(F.lit(0.0)).alias("value")).alias("regular_price")).alias("minimum_price"))
    state = F.when(F.col("ok"), "IN_STOCK").otherwise("OUT_OF_STOCK")
    attrs = F.array(F.struct(F.lit("color").alias("code"), F.col("c").alias("label")), F.struct(F.lit("talle").alias("code"), F.col("p_size").cast("string").alias("label")))
    v = F.struct(attrs.alias("attributes"), F.struct(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("sku"), state.alias("stock_status")).alias("product"))
    raw = _base(spark, sf_dir).select(F.to_json(F.struct(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("sku"), F.col("t").alias("name"), F.col("handle").alias("url_key"), state.alias("stock_status"), own.alias("price_range"), F.when(F.col("p_partkey") % 4 != 1, F.array(v)).alias("variants"))).alias("line"))
    return _digest(P.magento(raw.select(F.from_json("line", P.MAGENTO).alias("r")).select("r.*"), "mag", "m.com", "Tienda"))


@query(
    f"SELECT 'zara:' || p_partkey AS product_uid, {_TITLE} AS title, {_CENTS} AS low, {_CENTS} AS high, CASE WHEN p_partkey % 2 = 0 THEN {_CENTS} + 5000 END AS listed, {_STATE} AS availability, 1::BIGINT AS n_variants, CASE WHEN p_partkey % 4 <> 1 THEN {_FAMILY} END AS color, NULL AS size, '' AS sizes FROM part"
)
def map_zara(spark, sf_dir):
    detail = F.struct(F.lit("0354-S2026").alias("reference"), F.when(F.col("p_partkey") % 4 != 1, F.array(F.struct(F.lit("1").alias("id"), F.col("c").alias("name")))).alias("colors"))
    raw = _base(spark, sf_dir).select(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("t").alias("name"), F.bround(F.col("price") * 100).alias("price"), F.when(F.col("p_partkey") % 2 == 0, F.bround(F.col("price") * 100) + 5000).alias("oldPrice"), F.when(F.col("ok"), "in_stock").otherwise("out_of_stock").alias("availability"), F.lit("WOMAN").alias("sectionName"), detail.alias("detail"))).alias("line"))
    return _digest(P.zara(raw.select(F.from_json("line", P.ZARA).alias("r")).select("r.*"), "zara", "https://z.com", "Tienda"))


@query("SELECT s_suppkey, [cast(s_suppkey AS VARCHAR), s_suppkey || 'b', s_suppkey || 'c'] AS ids FROM supplier")
def category_tree(spark, sf_dir):
    """A menu of three levels, with a heading that has no section between."""
    k = F.col("s_suppkey").cast("string")
    tree = F.format_string('[{"id":"%s","sectionName":"W","name":"a","subcategories":[{"id":"x","name":"head","subcategories":[{"id":"%sc","sectionName":"M","name":"c"}]},{"id":"%sb","sectionName":"W","name":"b"}]}]', k, k, k)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.transform(P.flat_categories(tree), lambda n: n["id"]).alias("ids"))


def _pages(spark, sf_dir, html) -> DataFrame:
    url = F.concat(F.lit("https://shop.com/producto/"), F.col("handle"))
    return _base(spark, sf_dir).select(url.alias("url"), html.alias("html"))


_LD = '<html><head><script type="application/ld+json">%s</script></head><body><p>x</p></body></html>'


@query(
    f"SELECT 'gen:sku-' || p_partkey AS product_uid, {_TITLE} AS title, {_CENTS} AS low, {_CENTS} AS high, NULL::BIGINT AS listed, {_STATE} AS availability, 1::BIGINT AS n_variants, CASE WHEN p_partkey % 2 = 0 THEN {_FAMILY} END AS color, CASE WHEN p_partkey % 2 = 0 AND {_COLOR} = '42' THEN '42' END AS size, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN {_COLOR} ELSE '' END AS sizes FROM part WHERE p_partkey % 5 <> 0"
)
def map_generic_pages(spark, sf_dir):
    """A product inside a graph; every fifth page describes something else."""
    offer = F.struct(F.col("price").alias("price"), F.when(F.col("ok"), "https://schema.org/InStock").otherwise("https://schema.org/OutOfStock").alias("availability"), F.when(F.col("p_partkey") % 2 == 0, F.col("c")).otherwise("").alias("name"))
    node = F.to_json(F.struct(F.when(F.col("p_partkey") % 5 != 0, "Product").otherwise("Article").alias("@type"), F.col("t").alias("name"), F.concat(F.lit("SKU "), F.col("p_partkey").cast("string")).alias("sku"), offer.alias("offers")))
    html = F.format_string(_LD, F.concat(F.lit('{"@graph":[{"@type":"WebSite"},'), node, F.lit("]}")))
    return _digest(P.generic_pages(_pages(spark, sf_dir, html), "gen", "Tienda"))


@query(
    f"SELECT 'tn:' || (p_partkey + 1) AS product_uid, {_TITLE} AS title, {_CENTS} AS low, {_CENTS} AS high, {_CENTS} + 5000 AS listed, {_STATE} AS availability, 1::BIGINT AS n_variants, {_FAMILY} AS color, {_SIZE_OK} AS size, {_TWO} AS sizes FROM part WHERE p_partkey % 5 <> 0"
)
def map_tiendanube(spark, sf_dir):
    """Labels name the options; every fifth page is about another address."""
    variants = F.to_json(F.array(F.struct((F.col("p_partkey") + 1).alias("product_id"), F.col("p_partkey").alias("id"), F.col("price").alias("price_number"), F.bround(F.col("price") * 100).cast("long").alias("price_number_raw"), (F.col("price") + 50).alias("compare_at_price_number"), F.col("ok").alias("available"), F.col("p_size").cast("string").alias("option0"), F.col("c").alias("option1"))))
    about = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("https://shop.com/producto/"), "handle")).otherwise("https://shop.com/error/")
    ld = F.to_json(F.struct(F.lit("WebPage").alias("@type"), F.struct(about.alias("@id"), F.col("t").alias("name")).alias("mainEntity")))
    form = '<form><label for="variation_1">Talle</label><label for="variation_2">Color</label></form>'
    html = F.concat(F.lit('<html><script type="application/ld+json">'), ld, F.lit('</script><div data-variants="'), F.replace(variants, F.lit('"'), F.lit("&quot;")), F.lit(f'"></div>{form}</html>'))
    return _digest(P.tiendanube(_pages(spark, sf_dir, html), "tn", "Tienda"))


@query(
    f"SELECT 'ava:' || p_partkey AS product_uid, {_TITLE} AS title, {_CENTS} AS low, {_CENTS} + 200000 AS high, NULL::BIGINT AS listed, {_STATE} AS availability, 1::BIGINT AS n_variants, NULL AS color, NULL AS size, '' AS sizes FROM part"
)
def map_marketplace(spark, sf_dir):
    offers = F.struct(F.col("price").alias("lowPrice"), (F.col("price") + 2000).alias("highPrice"), F.when(F.col("ok"), "https://schema.org/InStock").otherwise("https://schema.org/SoldOut").alias("availability"))
    html = F.format_string(_LD, F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("t").alias("name"), offers.alias("offers"))))
    url = F.concat(F.lit("https://a.com/p/"), F.col("p_partkey").cast("string"), F.lit("-cosa"))
    return _digest(P.marketplace(_base(spark, sf_dir).select(url.alias("url"), html.alias("html")), "ava", "Mercado"))




# --- onboarding


@query(
    f"""WITH {PRODUCT_SQL} SELECT store_slug, count(*) AS products, (2 * count(*))::BIGINT AS variants, (2 * count(*))::BIGINT AS with_color, sum(has_image::INT)::BIGINT AS images, count(category) AS with_category, count(description) AS with_description FROM product GROUP BY 1"""
)
def coverage_by_store(spark, sf_dir):
    p = products(spark, sf_dir).withColumn("variants", F.transform("variants", lambda v: F.struct(v["color"].alias("color"), F.lit(None).cast("string").alias("size"))))
    return O.coverage_by_store(p).drop("with_size")


@query("SELECT count(*) AS sites, count(*) FILTER (WHERE page_id % 3 = 0) AS with_product, count(*) FILTER (WHERE page_id % 6 = 0) AS with_price, count(*) FILTER (WHERE page_id % 2 = 1) AS with_sitemap FROM pages")
def capabilities(spark, sf_dir):
    k = F.col("page_id")
    return O.capabilities(table(spark, sf_dir, "pages").select(F.when(k % 3 == 0, "WebSite,Product").otherwise("WebSite").alias("types"), F.when(k % 2 == 0, k).alias("price"), (k % 2 == 1).alias("sitemap")))


@query(
    """WITH c AS (SELECT s_name AS brand, i AS position, s_suppkey || '-' || i AS domain, CASE WHEN (s_suppkey + i) % 4 = 0 THEN 'vtex' WHEN (s_suppkey + i) % 2 = 0 THEN 'unknown' END AS platform FROM supplier, range(2) t(i)),
    a AS (SELECT brand, arg_min(domain, (CASE WHEN platform = 'vtex' THEN 0 ELSE 1 END, position)) FILTER (WHERE platform IS NOT NULL) AS domain, arg_min(platform, (CASE WHEN platform = 'vtex' THEN 0 ELSE 1 END, position)) FILTER (WHERE platform IS NOT NULL) AS platform FROM c GROUP BY 1)
    SELECT brand, coalesce(domain, '') AS domain, coalesce(platform, '') AS platform, CASE platform WHEN 'vtex' THEN 'ok' WHEN 'unknown' THEN 'plataforma no cubierta' ELSE 'no resuelve' END AS state FROM a"""
)
def brand_resolution(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("brand"), "s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    k = F.col("s_suppkey") + F.col("position")
    return O.resolve_brands(s.select("brand", "position", F.concat_ws("-", "s_suppkey", "position").alias("domain"), F.when(k % 4 == 0, "vtex").when(k % 2 == 0, "unknown").alias("platform")))


@query(
    """SELECT 'mall' || (s_suppkey % 3) AS mall, cast(s_suppkey AS VARCHAR) AS slug, s_name AS name, CASE WHEN s_nationkey % 4 = 0 THEN s_nationkey::VARCHAR ELSE 'Moda ' || s_nationkey END AS trade, s_nationkey % 4 <> 0 AS fashion FROM supplier"""
)
def mall_directory(spark, sf_dir):
    """Suppliers as shops, nations as trades; every fourth trade has no name."""
    mall = F.concat(F.lit("mall"), (F.col("s_suppkey") % 3).cast("string"))
    shops = table(spark, sf_dir, "supplier").select(mall.alias("mall"), F.col("s_suppkey").cast("string").alias("slug"), F.col("s_name").alias("name"), F.array("s_nationkey", "s_nationkey").alias("term_ids"))
    terms = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(F.explode(F.array(*(F.lit(f"mall{i}") for i in range(3)))).alias("mall"), F.col("n_nationkey").alias("id"), F.concat(F.lit("Moda "), F.col("n_nationkey").cast("string")).alias("name"))
    return O.mall_directory(shops, terms)


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND length(trim(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 320))) >= 25 THEN trim(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 320)) END AS description FROM documents"""
)
def generated_descriptions(spark, sf_dir):
    """Documents as generated texts; two thirds begin with a comment or a refusal."""
    k = F.col("doc_id") % 3
    raw = F.concat(F.when(k == 1, "La imagen muestra ").when(k == 2, "NO_ES_PRENDA ").otherwise(""), "text")
    return table(spark, sf_dir, "documents").select("doc_id", O.cleaned_description(raw).alias("description"))


_ANCHORS = " ".join(f"WHEN '{c}' THEN title || ' (es un/a {name})'" for c, name in O.CATEGORY_NAMES.items())


@query(f"WITH {PRODUCT_SQL} SELECT product_uid, CASE category {_ANCHORS} ELSE title END AS anchor FROM product")
def description_anchor(spark, sf_dir):
    return products(spark, sf_dir).select("product_uid", O.anchor(F.col("title"), F.col("category")).alias("anchor"))


@query(f"WITH {PRODUCT_SQL}, s AS (SELECT * FROM product ORDER BY md5(product_uid), product_uid LIMIT 100) SELECT count(*) AS n, avg((title <> '')::INT) AS title, avg((description IS NOT NULL)::INT) AS description FROM s")
def sampled_coverage(spark, sf_dir):
    return O.sampled_coverage(products(spark, sf_dir), 100, {"title": F.col("title") != "", "description": F.col("description").isNotNull()})
