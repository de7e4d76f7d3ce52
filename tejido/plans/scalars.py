"""Queries over the scalar functions: texts, money, sizes, colors, categories, questions, pages and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, marketplace, money, options, questions, shaping, size, taxonomy, text
from ..functions import vocabulary as V
from ..operators import analytics as A
from ..sources import landed
from .frames import COLORS, PRODUCT_SQL, at, products, sql_at, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


_FOLD = "strip_accents(text)"


@query(f"SELECT doc_id, md5(lower({_FOLD})) AS folded FROM documents")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(text.fold(F.col("text")))).alias("folded"))


@query(f"SELECT doc_id, md5(trim(regexp_replace(lower({_FOLD}), '[^a-z0-9]+', '-', 'g'), '-')) AS slug FROM documents")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.slugify(F.col("text"))).alias("slug"))


@query(f"SELECT doc_id, md5(trim(regexp_replace(lower({_FOLD}), '[^a-z0-9]+', ' ', 'g'))) AS title FROM documents")
def normalize_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_title(F.col("text"))).alias("title"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean(F.col("text"))).alias("cleaned"))


@query("SELECT o_orderkey, cast(round_even(o_totalprice * 100, 0) AS BIGINT) AS plain, cast(round_even(o_totalprice * 100, 0) AS BIGINT) AS grouped, cast(trunc(o_totalprice) AS BIGINT) * 100 AS whole FROM orders")
def parse_money(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), F.col("o_totalprice")
    local = F.translate(F.format_number(p, 2), ",.", ".,")
    spoken = F.translate(F.format_number(F.floor(p), 0), ",", ".")
    return o.select("o_orderkey", money.parse_money(F.replace(F.format_string("%.2f", p), F.lit("."), F.lit(","))).alias("plain"), money.parse_money(F.concat(F.lit("$ "), local)).alias("grouped"), money.parse_money(spoken).alias("whole"))


_SIZE_SQL = "CASE WHEN {n} BETWEEN 32 AND 60 THEN 'ar_numeric' WHEN {n} BETWEEN 20 AND 31 THEN 'shoe_ar' WHEN {n} BETWEEN 1 AND 18 THEN 'kids_numeric' ELSE 'unknown' END"


@query(
    f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN cast(p_size AS VARCHAR) WHEN 1 THEN 'ONE SIZE' WHEN 2 THEN 'XL' ELSE CASE WHEN p_size >= 10 THEN p_size || 'x50' END END AS normalized, "
    f"CASE p_partkey % 4 WHEN 0 THEN {_SIZE_SQL.format(n='p_size')} WHEN 1 THEN 'one_size' WHEN 2 THEN 'alpha' ELSE CASE WHEN p_size >= 10 THEN 'dimension' ELSE 'unknown' END END AS system FROM part"
)
def size_normalize(spark, sf_dir):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("Talle "), n)).when(k == 1, "Talle único").when(k == 2, "XG").otherwise(F.concat(n, F.lit(" X 50")))
    s = F.col("s")
    return table(spark, sf_dir, "part").withColumn("s", size.normalize_size(raw)).select("p_partkey", s["normalized"].alias("normalized"), s["system"].alias("system"))


@query("SELECT p_partkey, p_size BETWEEN 1 AND 60 AND p_size <> 19 AS size_like, p_partkey % 3 = 0 AS odd FROM part")
def size_vs_color(spark, sf_dir):
    n = F.col("p_size").cast("string")
    odd = F.array(n, F.when(F.col("p_partkey") % 3 == 0, F.lit("40x40")).otherwise("Negro"))
    return table(spark, sf_dir, "part").select("p_partkey", size.looks_like_size(F.array(n)).alias("size_like"), size.suspicious_color_set(odd).alias("odd"))


_FAMILY_OF = {"negro": "black", "Bordó": "red", "off white": "white", "verde oliva": "green", "azul": "blue", "crudo": "white", "42": None}


@query(f"SELECT p_partkey, {sql_at(tuple(_FAMILY_OF[c] for c in COLORS), 'p_partkey')} AS family, {sql_at(tuple(color.SHADES.get(_FAMILY_OF[c]) for c in COLORS), 'p_partkey')} AS hex FROM part")
def color_family(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("c", color.normalize_color(F.concat(at(COLORS, F.col("p_partkey")), F.lit(" nº 1")))).select("p_partkey", F.col("c.normalized").alias("family"), F.col("c.hex").alias("hex"))


def _rules_sql(rules: dict, x: str) -> str:
    def escaped(tokens):
        return "|".join(t.replace("'", "''") for t in tokens)

    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '\\b(?:{escaped([t for t in tokens if t.isascii()])})s?\\b') THEN '{name}'" for name, tokens in rules.items()) + " END"


@query(f"WITH {PRODUCT_SQL} SELECT product_uid, coalesce({_rules_sql(taxonomy.CATEGORIES, 'lower(strip_accents(p_type))')}, {_rules_sql(taxonomy.CATEGORIES, 'lower(strip_accents(title))')}) AS category FROM product")
def category_rules(spark, sf_dir):
    return products(spark, sf_dir).select("product_uid", taxonomy.classify_category(F.col("title"), F.array("p_type")).alias("category"))


_CRUMBS = ("Hombres", "Niño y bebé", "MUJER", "Camisas de Xiamen")


@query(
    f"WITH {PRODUCT_SQL}, s AS (SELECT product_uid, category, lower(strip_accents(p_name || ' ' || {sql_at(_CRUMBS, 'key')})) AS source FROM product) "
    f"SELECT product_uid, coalesce({_rules_sql(taxonomy.GENDERS, 'source')}, CASE WHEN category IN ('dresses', 'skirts', 'lingerie') THEN 'women' END, 'unknown') AS gender FROM s"
)
def gender_rules(spark, sf_dir):
    crumb = at(_CRUMBS, F.col("key"))
    return products(spark, sf_dir).select("product_uid", taxonomy.classify_gender(F.col("p_name"), F.array(crumb), category=F.col("category")).alias("gender"))


_SECTIONS = ("Hot-Sale verano", "Otoño 24", "Vestidos")


@query(f"SELECT doc_id, regexp_matches(lower(strip_accents(coalesce(text, '') || ' ' || {sql_at(_SECTIONS, 'doc_id')})), '{'|'.join(taxonomy.CAMPAIGNS)}') AS campaign FROM documents")
def collection_hints(spark, sf_dir):
    """Whole documents as section names, with a section after each."""
    named = F.concat_ws(" ", F.coalesce("text", F.lit("")), at(_SECTIONS, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", taxonomy.is_collection(named).alias("campaign"))


@query(
    """SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 60 AND p_size <> 19 THEN cast(p_size AS VARCHAR) END AS size,
    CASE WHEN p_partkey % 2 = 0 THEN 'pink' WHEN p_size = 19 THEN NULL END AS color, cast(CASE WHEN p_partkey % 2 = 0 AND p_size = 19 THEN 1 ELSE 0 END AS INTEGER) AS extras FROM part"""
)
def option_split(spark, sf_dir):
    """An unnamed size, and a color that is named on even keys only."""
    n = F.col("p_size").cast("string")
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    pairs = F.array(pair("Variante", n), pair("Color", F.when(F.col("p_partkey") % 2 == 0, "Rosa viejo")))
    o = F.col("o")
    return table(spark, sf_dir, "part").withColumn("o", options.split_options(pairs)).select("p_partkey", o["size"]["normalized"].alias("size"), o["color"]["normalized"].alias("color"), F.size(o["extras"]).alias("extras"))


_QUESTIONS = (
    "pollera de jean con bolsillos hasta 20 lucas", "campera bordó talle M para hombre", "vestidos entre 10.000 y 30000 con tajo", "¿y en negro?", "algo de morley desde $5.000 por mayor", "zapatillas para niños no más de 15 mil", "gracias",
)


def _asked(spark, sf_dir):
    """Each turn's own text with a question after it."""
    question = at(_QUESTIONS, F.col("conv_id") + F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(". "), question).alias("text"))


_HEAD, _TAIL = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:[^\p{L}\p{M}\p{N}_]|$)"


def _word_sql(tokens, plural: bool = False, open_end: bool = False) -> str:
    return f"regexp_matches(low, '{_HEAD}(?:{'|'.join(tokens)}){'s?' if plural else ''}{'' if open_end else _TAIL}')"


def _first_sql(choices: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {hit} THEN '{name}'" for name, hit in choices.items()) + " END"


def _cents_sql(text: str, pattern: str, number: int, unit: int | None = None) -> str:
    part = lambda i: f"nullif(regexp_extract({text}, '{pattern.replace('(?iu)', '')}', {i}), '')"
    n = f"try_cast(replace(replace({part(number)}, '.', ''), ',', '.') AS DOUBLE)"
    times = f" * CASE WHEN {part(unit)} IN ('lucas', 'mil', 'k') THEN 1000 ELSE 1 END" if unit else ""
    return f"cast(trunc({n}{times} * 100) AS BIGINT)"


def _own_sql() -> str:
    """The filters of each turn, worked out of its text by regular expressions without look-behind."""
    both = f"regexp_matches(low, '{V.BETWEEN.replace('(?iu)', '')}')"
    bounded = lambda p: f"'{p.replace('(?iuU)', '').replace(chr(92) + 'b', _HEAD, 1).removesuffix(chr(92) + 'b') + _TAIL}'"
    garments = {c: w for c, ws in V.CATEGORY_WORDS.items() if (w := [x for x in ws if x not in V.FABRIC_AND_CATEGORY])}
    plain = "replace(low, 'no más de', '#')"
    fields = {
        "canal": f"CASE WHEN {' OR '.join(f"contains(low, '{w}')" for w in V.WHOLESALE_WORDS)} THEN 'mayorista' END",
        "genero": _first_sql({g: f"regexp_matches(low, {bounded(p)})" for g, p in V.GENDER_PATTERNS.items()}),
        "tela": _first_sql({k: _word_sql(ws, open_end=True) for k, ws in V.AXES["tela"].items()}),
        "detalle": _first_sql({k: _word_sql(ws, open_end=True) for k, ws in V.AXES["detalle"].items()}),
        "max_cents": f"CASE WHEN {both} THEN {_cents_sql('low', V.BETWEEN, 2)} ELSE {_cents_sql('low', V.UPTO, 1, 2)} END",
        "min_cents": f"CASE WHEN {both} THEN {_cents_sql('low', V.BETWEEN, 1)} ELSE {_cents_sql(plain, V.FROM, 1, 2)} END",
        "category": f"coalesce({_first_sql({c: _word_sql(ws, True) for c, ws in garments.items()})}, {_first_sql({c: _word_sql(ws, True) for c, ws in V.CATEGORY_WORDS.items()})})",
        "color": _first_sql({c: _word_sql(ws, True) for c, ws in V.COLOR_WORDS.items()}),
        "size": f"upper(nullif(regexp_extract(low, {bounded(V.SIZE)}, 1), ''))",
    }
    asked = f"lower(coalesce(text, '') || '. ' || {sql_at(_QUESTIONS, '(conv_id + turn)')})"
    return f"low AS (SELECT conv_id, turn, {asked} AS low FROM conversations), own AS (SELECT conv_id, turn, {', '.join(f'{x} AS {f}' for f, x in fields.items())} FROM low)"


@query(f"WITH {_own_sql()} SELECT conv_id, turn, {', '.join(questions.FIELDS)} FROM own")
def parse_query_filters(spark, sf_dir):
    return questions.parse_questions(_asked(spark, sf_dir)).select("conv_id", "turn", *questions.FIELDS)


@query(
    f"WITH {_own_sql()} SELECT conv_id, turn, " + ", ".join(f"last_value({f} IGNORE NULLS) OVER w AS {f}" if f in questions.INHERITED else f for f in questions.FIELDS)
    + " FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"
)
def thread_inheritance(spark, sf_dir):
    return questions.thread_filters(_asked(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", *questions.FIELDS)


@query(
    """WITH t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS text FROM conversations WHERE role = 'user'),
    h AS (SELECT conv_id, turn, text, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS history FROM t),
    b AS (SELECT *, list_filter(coalesce(history, []), lambda p: p <> '') AS before FROM h),
    m AS (SELECT *, list_max(list_transform(before, lambda p: length(p))) AS longest FROM b)
    SELECT conv_id, turn, CASE WHEN len(before) = 0 THEN text WHEN text = '' THEN array_to_string(before, ' | ')
    ELSE array_to_string(before, ' | ') || repeat(' | ' || text, greatest(2, least(3, ceil(longest / length(text))::INT))) END AS asked FROM m"""
)
def query_text(spark, sf_dir):
    from pyspark.sql import Window

    back = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("before", F.collect_list("text").over(back)).select("conv_id", "turn", questions.query_text(F.col("text"), F.col("before")).alias("asked"))


@query(
    f"""WITH {PRODUCT_SQL} SELECT product_uid, concat_ws(' | ', title, category, brand, seller, 'colores ' || color || ' 6', 'talles ' || array_to_string(sizes_available, ' '),
    left(CASE WHEN length(trim(description)) >= 20 THEN description ELSE description_ia END, 280)) AS document FROM product"""
)
def embedding_text(spark, sf_dir):
    c = F.transform("variants", lambda v: v["color"]["raw"])
    return products(spark, sf_dir).select("product_uid", shaping.embedding_text(*(F.col(x) for x in ("title", "category", "brand", "seller")), c, F.col("sizes_available"), F.col("description"), F.col("description_ia")).alias("document"))


@query(
    f"""WITH {PRODUCT_SQL} SELECT product_uid, concat_ws(' · ', '[' || (1 + key % 12) || '] ' || title, '$' || format('{{:,}}', cast(round_even(price_min_cents / 100.0, 0) AS BIGINT)),
    CASE WHEN seller IS NOT NULL THEN 'local: ' || seller END, CASE WHEN seller IS NULL THEN 'marca: ' || brand END, 'talles: ' || array_to_string(sizes_available, ', '), 'colores: ' || color || ', 6') AS line FROM product"""
)
def context_lines(spark, sf_dir):
    none = F.lit(None).cast("string")
    c = F.transform("variants", lambda v: v["color"]["raw"])
    line = shaping.context_line(1 + F.col("key") % 12, F.col("title"), F.bround(F.col("price_min_cents") / 100), F.lit(None).cast("double"), F.col("seller"), none, F.col("brand"), none, F.col("sizes_available"), c)
    return products(spark, sf_dir).select("product_uid", line.alias("line"))


@query(
    f"""WITH {PRODUCT_SQL} SELECT product_uid, left(sha256(title || '|' || '0:' || price_min_cents || ':' || availability || ':None|1:' || (price_min_cents + 1) || ':in_stock:3'), 16) AS content_hash FROM product"""
)
def content_hash(spark, sf_dir):
    p = lambda i, extra, state, stock: F.struct(F.lit(i).alias("external_id"), F.struct((F.col("price_min_cents") + extra).alias("amount_cents")).alias("price"), state.alias("availability"), F.lit(stock).cast("int").alias("stock"))
    variants = F.array(p("1", 1, F.lit("in_stock"), 3), p("0", 0, F.col("availability"), None))
    return products(spark, sf_dir).select("product_uid", shaping.content_hash(F.col("title"), variants).alias("content_hash"))


@query(f"WITH {PRODUCT_SQL} SELECT product_uid, CASE WHEN compare_at_cents > price_min_cents THEN round(100 * (1 - price_min_cents / compare_at_cents), 2) END AS discount, CASE WHEN compare_at_cents > price_min_cents THEN compare_at_cents END AS listed FROM product")
def discounts(spark, sf_dir):
    a, c = F.col("price_min_cents"), F.col("compare_at_cents")
    return products(spark, sf_dir).select("product_uid", money.discount_pct(a, c).alias("discount"), money.higher_or_null(c, a).alias("listed"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'in_stock' WHEN 'purchase' THEN 'out_of_stock' WHEN 'view' THEN 'preorder' ELSE 'unknown' END AS availability FROM events")
def availability_map(spark, sf_dir):
    raw = F.element_at(F.create_map(*(F.lit(x) for kv in {"signup": "https://schema.org/LimitedAvailability", "purchase": "SoldOut", "view": "http://schema.org/BackOrder"}.items() for x in kv)), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", shaping.availability(raw).alias("availability"))


@query(
    "SELECT o_orderkey, cast(o_orderkey % 250 AS INTEGER) BETWEEN 1 AND 200 AS has_qty, CASE WHEN o_orderkey % 250 BETWEEN 1 AND 200 THEN cast(o_orderkey % 250 AS INTEGER) END AS qty, ['curva', 'pares', NULL][1 + o_orderkey % 3] AS unit, "
    "cast(round_even(o_totalprice, 0) AS BIGINT) * 100 AS retail, cast(o_custkey AS INTEGER) AS followers FROM orders"
)
def marketplace_text(spark, sf_dir):
    unit = F.coalesce(at(("(CURVA)", "pares", None), F.col("o_orderkey")), F.lit("surtido"))
    page = F.concat_ws("\n", F.concat(F.lit("Precio por menor: $ "), F.format_string("%d", F.bround("o_totalprice").cast("long"))), F.concat(F.lit("Compra mínima: "), (F.col("o_orderkey") % 250).cast("string"), F.lit(" "), unit), F.concat(F.col("o_custkey").cast("string"), F.lit("\nSeguidores")))
    m = F.col("m")
    rows = table(spark, sf_dir, "orders").withColumn("page", page).withColumn("m", marketplace.least_purchase(marketplace.labelled(F.col("page"), marketplace.MINIMUM)))
    who = marketplace.seller(F.lit("Local"), F.lit(""), F.col("page"))
    return rows.select("o_orderkey", m["qty"].isNotNull().alias("has_qty"), m["qty"].alias("qty"), m["unit"].alias("unit"), marketplace.retail_cents(F.col("page")).alias("retail"), who["followers"].alias("followers"))


@query(
    f"""WITH {PRODUCT_SQL}, w AS (SELECT *, category IS NOT NULL AS fashion, regexp_matches(lower(title), '\\b(sábanas|termo)\\b') AS other FROM product)
    SELECT CASE WHEN fashion THEN 'categoría' WHEN other THEN 'título no-ropa' ELSE 'sin categoría, se conserva' END AS reason, fashion OR NOT other AS keep, count(*) AS n FROM w GROUP BY 1, 2"""
)
def apparel_filter(spark, sf_dir):
    return A.apparel(products(spark, sf_dir)).groupBy("reason", "keep").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 3) AS fashion FROM part")
def mall_trades(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", A.mall_trade(at(("Mujer", "Gastronomía", "", "Bebés y Niños"), F.col("p_partkey"))).alias("fashion"))


@query("SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1))) AS links, len(regexp_extract_all(html, '<li>')) AS items FROM pages")
def html_extract(spark, sf_dir):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), 1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"))


@query(
    """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(?:script\\b.*?</script|style\\b.*?</style|noscript\\b.*?</noscript)\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
    b AS (SELECT page_id, list_transform(regexp_split_to_array(regexp_replace(h, '(?s)<[^>]*>', chr(10), 'g'), '\\r\\n|[\\n\\x0b\\x0c\\r\\x{85}\\x{2028}\\x{2029}]'), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#34;', '"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&amp;', '&'), '[\\s\\x{a0}]+', ' ', 'g'))) AS xs FROM a)
    SELECT page_id, md5(array_to_string(list_filter(xs, lambda x: x <> ''), chr(10))) AS text FROM b"""
)
def html_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.visible_text(F.col("html"))).alias("text"))


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'avellaneda' WHEN 1 THEN 'shopify' WHEN 2 THEN 'tiendanube' ELSE 'unknown' END AS platform FROM pages"""
)
def platform_detect(spark, sf_dir):
    k = F.col("page_id") % 4
    domain = F.when(k == 0, "www.avellanedaauntoque.com").otherwise("x.com")
    signs = F.when(k == 1, F.repeat(F.lit("<img src=//cdn.shopify.com/x>"), 3)).when(k == 2, F.concat(F.repeat(F.lit("nuvemshop "), 2), F.repeat(F.lit("tiendanube "), 2))).otherwise(F.repeat(F.lit("Magento_ "), 2))
    return table(spark, sf_dir, "pages").select("page_id", landed.platform(F.concat("html", signs), domain).alias("platform"))


_URLS = "SELECT p_partkey, 'https://x.com/p/' || (p_partkey % 700) || '-' || replace(p_name, ' ', '-') AS url FROM part"


@query(
    f"""WITH u AS ({_URLS}), i AS (SELECT regexp_extract(url, '/p/(\\d+)-([^/]+)', 1) AS external_id, regexp_extract(url, '/p/(\\d+)-([^/]+)', 2) AS handle, url FROM u)
    SELECT external_id, arg_min(handle, url) AS handle, min(url) AS url FROM i GROUP BY 1"""
)
def url_inventory(spark, sf_dir):
    url = F.concat(F.lit("https://x.com/p/"), (F.col("p_partkey") % 700).cast("string"), F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return landed.inventory(table(spark, sf_dir, "part").select(url.alias("url"))).select("external_id", "handle", "url")


@query("SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name")
def dedup_keep_first(spark, sf_dir):
    return A.keep_first(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_name", "p_partkey", "p_brand")


@query("SELECT url, page_id FROM (SELECT 'https://x.com/' || (['producto', 'blog', 'item', 'otros'])[1 + page_id % 4] || '/' || page_id AS url, page_id FROM pages) WHERE NOT contains(url, '/blog/') ORDER BY NOT (contains(url, '/producto/') OR contains(url, '/item/')), page_id LIMIT 60")
def likely_first(spark, sf_dir):
    url = F.concat(F.lit("https://x.com/"), at(("producto", "blog", "item", "otros"), F.col("page_id")), F.lit("/"), F.col("page_id").cast("string"))
    return landed.likely_first(table(spark, sf_dir, "pages").select(url.alias("url"), "page_id"), position="page_id", most=60)


@query(
    """WITH u AS (SELECT 'https://x/' || (o_custkey % 100) AS url, min(o_orderkey) AS first_order FROM orders GROUP BY 1) SELECT url, first_order FROM u"""
)
def sitemap_scan(spark, sf_dir):
    """Orders as sitemap files of one address each."""
    body = F.concat(F.lit("<url><loc> https://x/"), (F.col("o_custkey") % 100).cast("string"), F.lit(" </loc></url>"))
    return landed.sitemap_urls(table(spark, sf_dir, "orders").select(body.alias("body"), "o_orderkey"), position="o_orderkey").select("url", F.col("first.o_orderkey").alias("first_order"))


@query("SELECT o_orderkey, 'https://x/' || o_orderkey AS url, cast(o_orderdate::DATE AS VARCHAR) AS lastmod, cast(o_orderkey AS BIGINT) AS file_no FROM orders")
def sitemap_lastmod(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit("<url>\n<loc>https://x/"), k, F.lit("</loc>\n<lastmod>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</lastmod></url>"))
    rows = landed.sitemap_entries(table(spark, sf_dir, "orders").select(body.alias("body")))
    number = landed.sitemap_number(F.concat(F.regexp_replace("url", "x/", "x/sitemaps/"), F.lit(".xml")))
    return rows.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("o_orderkey"), "url", "lastmod", number.alias("file_no"))


@query(
    """WITH s AS (SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 9, '0') AS n FROM supplier)
    SELECT s_suppkey, array_to_string(flatten(list_transform(['.com.ar', '.com', '.ar'], lambda e: ['supplier' || n || e, 'supplier-' || n || e])), ' ') AS candidates FROM s"""
)
def brand_candidates(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(landed.domain_candidates(F.col("s_name")), " ").alias("candidates"))


@query("SELECT o_orderpriority, array_to_string(list_distinct(list(o_orderstatus ORDER BY o_orderkey)), '') <> '' AS some, len(list_distinct(list(o_orderstatus))) AS n FROM orders GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    xs = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(xs.alias("xs")).select("o_orderpriority", (F.array_join("xs", "") != "").alias("some"), F.size("xs").cast("long").alias("n"))

