"""Search queries: ranking, de-duplication, relaxation, facets, existence and membership filters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.similarity import cosine_distance, literal_vector
from ..functions.text import fold_literal
from ..operators import requests as R
from ..operators import search as S
from .frames import PRODUCT_SQL, STORE_SQL, products, similarity_sql, stores, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
TEXT = "remera verde"
VECTOR = [round(math.sin(i + 1), 6) for i in range(64)]
VECTOR_SQL = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"
COSINE_SQL = f"list_cosine_distance(embedding::DOUBLE[], {VECTOR_SQL})"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


_JOINED = f"WITH {PRODUCT_SQL}, {STORE_SQL}, row AS (SELECT p.*, s.last_crawl FROM product p JOIN store s ON s.slug = p.store_slug)"
_FRESH = "(last_crawl IS NULL OR scraped_at >= last_crawl - INTERVAL 12 HOURS)"
_SIM = f"1 - {similarity_sql('title_normalized', repr(TEXT))}"


@query(
    f"""{_JOINED}, hit AS (SELECT *, {_SIM} AS distance FROM row WHERE availability = 'in_stock' AND {_FRESH} AND price_min_cents <= 150000 AND category = 'tops'),
    best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY title_normalized, coalesce(brand, '') ORDER BY distance, product_uid) = 1)
    SELECT product_uid, store_slug, title, brand, price_min_cents / 100.0 AS price, round(distance, 4) AS distance FROM best ORDER BY best.distance, product_uid LIMIT 12"""
)
def search_text_topk(spark, sf_dir):
    f = S.Filters(category="tops", max_cents=150000)
    return S.search(products(spark, sf_dir), stores(spark, sf_dir), f, text=TEXT, limit=12).select("product_uid", "store_slug", "title", "brand", "price", "distance")


@query(f"SELECT vec_id, label, round({COSINE_SQL}, 6) AS distance FROM embeddings ORDER BY {COSINE_SQL}, vec_id LIMIT 10")
def search_vector_topk(spark, sf_dir):
    d = cosine_distance(F.col("embedding"), literal_vector(VECTOR))
    return table(spark, sf_dir, "embeddings").withColumn("d", d).orderBy("d", "vec_id").limit(10).select("vec_id", "label", F.round("d", 6).alias("distance"))


@query(f"SELECT vec_id, label, round({COSINE_SQL}, 6) AS distance FROM embeddings WHERE label = 3 ORDER BY {COSINE_SQL}, vec_id LIMIT 12 OFFSET 4")
def search_vector_filtered(spark, sf_dir):
    d = cosine_distance(F.col("embedding"), literal_vector(VECTOR))
    return table(spark, sf_dir, "embeddings").where("label = 3").withColumn("d", d).orderBy("d", "vec_id").offset(4).limit(12).select("vec_id", "label", F.round("d", 6).alias("distance"))


@query(
    f"""{_JOINED}, best AS (SELECT *, {_SIM} AS distance FROM row QUALIFY row_number() OVER (PARTITION BY title_normalized, coalesce(brand, '') ORDER BY {_SIM}, product_uid) = 1),
    picked AS (SELECT * FROM best ORDER BY title_normalized, coalesce(brand, '') LIMIT 48)
    SELECT product_uid, title, round(distance, 4) AS distance FROM picked ORDER BY picked.distance, product_uid LIMIT 12"""
)
def search_candidate_limited(spark, sf_dir):
    f = S.Filters(in_stock=False, fresh_hours=None)
    return S.search(products(spark, sf_dir), stores(spark, sf_dir), f, text=TEXT, limit=12, candidate_limit=48).select("product_uid", "title", "distance")


@query(f"WITH {PRODUCT_SQL} SELECT DISTINCT ON (title_normalized, coalesce(brand, '')) title_normalized, brand, product_uid, price_min_cents FROM product ORDER BY title_normalized, coalesce(brand, ''), price_min_cents, product_uid")
def distinct_on_best(spark, sf_dir):
    return S.best_per_title(products(spark, sf_dir).withColumn("distance", F.col("price_min_cents"))).select("title_normalized", "brand", "product_uid", "price_min_cents")


_RELAX = S.Filters(category="dresses", color="grey", size="700", detalle="tajo", min_cents=100000, fresh_hours=None)
_RELAX_TESTS = {
    "detalle": "(contains(lower(coalesce(title, '')), 'tajo') OR contains(lower(coalesce(description, '')), 'tajo') OR contains(lower(coalesce(description_ia, '')), 'tajo'))",
    "color": "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for c in ("title", "description", "description_ia") for w in V.COLOR_WORDS["grey"]) + ")",
    "size": "list_contains(sizes_available, '700')",
    "category": "coalesce(category = 'dresses', false)",
    "min_cents": "price_min_cents >= 100000",
}
_LEVEL = "greatest(" + ", ".join(f"CASE WHEN NOT {t} THEN {i + 1} ELSE 0 END" for i, t in enumerate(_RELAX_TESTS.values())) + ")"


@query(
    f"""{_JOINED}, levelled AS (SELECT *, {_SIM} AS distance, {_LEVEL} AS level FROM row WHERE availability = 'in_stock'), low AS (SELECT min(level) AS lowest FROM levelled),
    best AS (SELECT l.* FROM levelled l, low WHERE level = lowest QUALIFY row_number() OVER (PARTITION BY title_normalized, coalesce(brand, '') ORDER BY distance, product_uid) = 1)
    SELECT product_uid, title, round(distance, 4) AS distance, level, array_to_string((['detalle=tajo', 'color=grey', 'size=700', 'category=dresses', 'min_cents=100000'])[1:level], ',') AS relaxed
    FROM best ORDER BY best.distance, product_uid LIMIT 12"""
)
def relaxed_search(spark, sf_dir):
    found = S.search_relaxed(products(spark, sf_dir), stores(spark, sf_dir), _RELAX, text=TEXT, limit=12)
    return found.select("product_uid", "title", F.round("distance", 4).alias("distance"), "level", F.array_join("relaxed", ",").alias("relaxed"))


def _facet_sql(source: str, text: str) -> str:
    terms = [(a, i, label, list(dict.fromkeys(map(fold_literal, keys)))) for a in V.AXES for i, (label, keys) in enumerate(V.AXES[a].items())]
    rows = ", ".join(f"({list(V.AXES).index(a)}, '{a}', {i}, '{label}', {'[' + ', '.join(repr(k) for k in keys) + ']'})" for a, i, label, keys in terms)
    return f"""WITH {source}, vocabulary(axis_no, axis, term_no, option, keys) AS (VALUES {rows}),
    hits AS (SELECT axis_no, axis, term_no, option, count(*) FILTER (WHERE len(list_filter(keys, lambda k: contains(t.text, k))) > 0) AS n, count(*) AS total FROM vocabulary, (SELECT {text} AS text FROM src) t GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY n DESC, term_no) AS position, count(*) OVER (PARTITION BY axis) AS terms FROM hits WHERE n > 0 AND n < total),
    ranked AS (SELECT *, dense_rank() OVER (ORDER BY axis_no) AS axis_rank FROM placed WHERE terms >= 2)
    SELECT axis, cast(position AS INTEGER) AS position, option, n FROM ranked WHERE axis_rank <= 2 AND position <= 4"""


@query(_facet_sql(f"{PRODUCT_SQL}, src AS (SELECT * FROM product)", "lower(strip_accents(concat_ws(' ', coalesce(title, ''), coalesce(description, ''))))"))
def facets(spark, sf_dir):
    return S.facets(products(spark, sf_dir))


@query(_facet_sql("src AS (SELECT * FROM documents)", "lower(strip_accents(coalesce(text, '')))"))
def facets_documents(spark, sf_dir):
    return S.facets(table(spark, sf_dir, "documents"), title="text", description=None)


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 49) OR p_name ILIKE '%gear%'")
def exists_or_text(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("t_part")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("t_lineitem")
    return spark.sql("SELECT p_partkey, p_name FROM t_part WHERE EXISTS (SELECT 1 FROM t_lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 49) OR p_name ILIKE '%gear%'")


@query(f"WITH {PRODUCT_SQL} SELECT product_uid, title FROM product WHERE (availability = 'in_stock' AND color = 'negro' AND key % 2 = 0) OR contains(lower(coalesce(title, '')), 'azul')")
def color_variant_or_text(spark, sf_dir):
    """A black variant in stock, or blue in the title."""
    held = F.exists("variants", lambda v: (v["color"]["normalized"] == "black") & (v["availability"] == "in_stock")) & (F.col("availability") == "in_stock")
    return products(spark, sf_dir).where(held | F.contains(F.lower("title"), F.lit("azul"))).select("product_uid", "title")


@query("WITH sizes AS (SELECT l_partkey, list_distinct(list(cast(l_linenumber AS VARCHAR))) AS xs FROM lineitem GROUP BY 1) SELECT p_partkey, p_name FROM part JOIN sizes ON l_partkey = p_partkey WHERE list_contains(xs, '7')")
def array_member_size(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("xs"))
    return table(spark, sf_dir, "part").join(sizes, F.col("l_partkey") == F.col("p_partkey")).where(F.array_contains("xs", "7")).select("p_partkey", "p_name")


@query(f"{_JOINED} SELECT product_uid, store_slug FROM row WHERE {_FRESH}")
def freshness(spark, sf_dir):
    return S.with_store(products(spark, sf_dir), stores(spark, sf_dir)).where(S.fresh(12)).select("product_uid", "store_slug")


@query(f"{_JOINED} SELECT product_uid, gender FROM row WHERE gender NOT IN ('women', 'men', 'kids') AND store_slug <> 'avellaneda' AND price_min_cents BETWEEN 90500 AND 120000")
def gender_channel_price(spark, sf_dir):
    f = S.Filters(genero="sin", canal="marcas", max_cents=120000, min_cents=90500, in_stock=False, fresh_hours=None)
    rows = S.with_store(products(spark, sf_dir), stores(spark, sf_dir))
    return rows.where(S._all([*S.hard_conditions(f), *S.soft_conditions(f).values()])).select("product_uid", "gender")


@query(
    """SELECT l_orderkey, l_linenumber, p_name, s_name, l_extendedprice FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
    WHERE p_size = 40 AND l_returnflag <> 'R' ORDER BY l_extendedprice, l_orderkey, l_linenumber"""
)
def variant_price_join(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_size = 40").select("p_partkey", "p_name")
    line = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    joined = line.join(part, F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.orderBy("l_extendedprice", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "p_name", "s_name", "l_extendedprice")


_MESSAGE = "remera hasta 1.500 pesos"


def _no_vectors(texts):
    raise ConnectionError("no provider here")


@query(
    f"""{_JOINED}, hit AS (SELECT *, 1 - {similarity_sql("title_normalized", repr(_MESSAGE))} AS distance FROM row WHERE availability = 'in_stock' AND {_FRESH} AND price_min_cents <= 150000 AND category = 'tops' AND store_slug <> 'avellaneda'),
    best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY title_normalized, coalesce(brand, '') ORDER BY distance, product_uid) = 1)
    SELECT product_uid, title, round(distance, 4) AS distance, 'words' AS mode FROM best ORDER BY best.distance, product_uid LIMIT 20 OFFSET 2"""
)
def request_search(spark, sf_dir):
    """A request in words with a stated channel; its provider of vectors fails."""
    r = R.search_request(products(spark, sf_dir), stores(spark, sf_dir), _MESSAGE, _no_vectors, limit=20, offset=2, canal="marcas")
    return r.rows.select("product_uid", "title", "distance", F.lit(r.mode).alias("mode"))


def _lengths(texts):
    return [(i, [len(t), t.count("e")]) for i, t in reversed(list(enumerate(texts)))]


@query("SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS first, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::DOUBLE AS second FROM documents")
def embedding_map(spark, sf_dir):
    """A provider that answers out of order."""
    return R.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _lengths).select("doc_id", F.col("embedding")[0].alias("first"), F.col("embedding")[1].alias("second"))
