"""Landed shop data to the canonical product, one select per platform.

JSON platforms are parsed by schema and mapped by column expressions. Pages are first read by `pages.fields`,
which gives a struct of plain fields, and mapped by the same expressions. A record without an id, a price or
a variant gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.marketplace import MINIMUM, SHIPPING, TRADE, labelled, least_purchase, retail_cents, seller
from ..functions.money import higher_or_null, number_to_cents, parse_money
from ..functions.options import split_options
from ..functions.shaping import availability, content_hash, distinct_in_stock, numbered_images, short_hash
from ..functions.size import looks_like_size, normalize_size
from ..functions.color import normalize_color
from ..functions.taxonomy import classify_category, classify_gender, is_collection
from ..functions.text import clean, normalize_title, slugify, strip_tags

PRICE = "struct<amount_cents:bigint,currency:string,compare_at_cents:bigint>"
VARIANT = (
    "struct<external_id:string,sku:string,size:struct<raw:string,normalized:string,system:string>,color:struct<raw:string,normalized:string,hex:string>,"
    f"price:{PRICE},availability:string,stock:int,image_url:string,extra_options:map<string,string>>"
)
COLUMNS = {
    "product_uid": "string", "store_slug": "string", "external_id": "string", "url": "string", "handle": "string", "title": "string", "title_normalized": "string", "description": "string",
    "brand": "string", "category_path": "array<string>", "category": "string", "gender": "string", "collections": "array<string>", "tags": "array<string>", "price_min": PRICE, "price_max": PRICE,
    "price_retail": PRICE, "min_purchase": "string", "min_qty": "int", "min_unit": "string", "seller": "struct<external_id:string,name:string,address:string,verified:boolean,followers:int>",
    "availability": "string", "variants": f"array<{VARIANT}>", "sizes_available": "array<string>", "colors_available": "array<string>",
    "images": "array<struct<url:string,position:int,width:int,height:int>>", "content_hash": "string", "source": "string",
}


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def price(amount: Column, compare_at: Column | None = None) -> Column:
    above = higher_or_null(compare_at, amount) if compare_at is not None else F.lit(None)
    return F.struct(amount.cast("long").alias("amount_cents"), F.lit("ARS").alias("currency"), above.cast("long").alias("compare_at_cents")).cast(PRICE)


def in_order(items: Column) -> Column:
    """By place; variants hold maps, which have no order of their own."""
    return F.array_sort(items, lambda a, b: a["_at"] - b["_at"])


def variant(external_id: Column, amount: Column, state: Column, compare_at: Column | None = None, sku: Column | None = None, options: Column | None = None, stock: Column | None = None, image: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        external_id.cast("string").alias("external_id"),
        (sku if sku is not None else none).cast("string").alias("sku"),
        (options["size"] if options is not None else none).alias("size"),
        (options["color"] if options is not None else none).alias("color"),
        price(amount, compare_at).alias("price"),
        state.alias("availability"),
        (stock if stock is not None else none).cast("int").alias("stock"),
        (image if image is not None else none).cast("string").alias("image_url"),
        (options["extras"] if options is not None else F.create_map()).cast("map<string,string>").alias("extra_options"),
    ).cast(VARIANT)


def finish(rows: DataFrame, slug: str, store_name: str, source: str, unless_out: bool = False, default_gender: str = "unknown", any_in_stock: bool = True, gender_terms: Column | None = None) -> DataFrame:
    """The canonical columns from: external_id, url, handle, title, description, brand, category_path, variants, images, and
    optionally any other canonical column, which is then taken as it is."""
    have = set(rows.columns)
    rows = rows.where(F.col("external_id").isNotNull() & (F.col("external_id") != "") & (F.size("variants") > 0))
    rows = rows.withColumn("_category", classify_category(F.col("title"), F.col("category_path"), F.col("handle")))
    by_price = lambda best: best(F.transform("variants", lambda v, i: F.struct(v["price"]["amount_cents"].alias("c"), (-i if best is F.array_max else i).alias("i"), v["price"].alias("p"))))["p"]
    size = lambda v: F.coalesce(v["size"]["normalized"], v["size"]["raw"])
    made = {
        "product_uid": F.concat(F.lit(f"{slug}:"), F.col("external_id")),
        "store_slug": F.lit(slug),
        "title_normalized": normalize_title(F.col("title")),
        "brand": F.coalesce(_blank(clean(F.col("brand"))), F.lit(store_name)),
        "category": F.col("_category"),
        "gender": classify_gender(F.col("title"), F.concat("category_path", gender_terms) if gender_terms is not None else F.col("category_path"), default_gender, F.col("_category")),
        "price_min": by_price(F.array_min),
        "price_max": by_price(F.array_max),
        "availability": F.when(F.exists("variants", lambda v: v["availability"] == "in_stock"), "in_stock").otherwise("out_of_stock"),
        "sizes_available": distinct_in_stock(F.col("variants"), size, unless_out),
        "colors_available": distinct_in_stock(F.col("variants"), lambda v: v["color"]["raw"], unless_out),
        "content_hash": content_hash(F.col("title"), F.col("variants")),
        "source": F.lit(source),
        "collections": F.array(),
        "tags": F.array(),
    }
    out = []
    for name, kind in COLUMNS.items():
        value = F.col(name) if name in have and name != "brand" else made.get(name, F.lit(None))
        out.append(value.cast(kind).alias(name))
    return rows.select(*out)


SHOPIFY = (
    "id bigint, title string, handle string, body_html string, vendor string, product_type string, tags array<string>, options array<struct<name:string>>, "
    "variants array<struct<id:bigint,option1:string,option2:string,option3:string,sku:string,featured_image:struct<src:string>,available:boolean,price:string,compare_at_price:string>>, "
    "images array<struct<src:string,position:int,width:int,height:int>>"
)


def shopify(raw: DataFrame, slug: str, domain: str, store_name: str) -> DataFrame:
    """raw: SHOPIFY columns."""

    def one(v: Column, names: Column) -> Column:
        pairs = F.array(*(F.struct(F.coalesce(F.get(names, F.lit(i)), F.lit(f"option{i + 1}")).alias("name"), v[f"option{i + 1}"].alias("value")) for i in range(3)))
        state = F.when(v["available"], "in_stock").otherwise("out_of_stock")
        return variant(v["id"], parse_money(v["price"]), state, parse_money(v["compare_at_price"]), _blank(clean(v["sku"])), split_options(pairs), image=v["featured_image"]["src"])

    names = F.transform(F.coalesce("options", F.array().cast("array<struct<name:string>>")), lambda o: F.coalesce(o["name"], F.lit("")))
    usable = F.filter("variants", lambda v: v["id"].isNotNull() & parse_money(v["price"]).isNotNull())
    rows = raw.where(F.col("handle") != "").withColumn("_names", names).withColumn("_usable", usable)
    # Variants are mapped as rows: option rules are long, and a row's columns keep the generated code small.
    mapped = rows.select("id", F.posexplode("_usable").alias("_at", "_v"), "_names").withColumn("_variant", one(F.col("_v"), F.col("_names")))
    grouped = mapped.groupBy("id").agg(in_order(F.collect_list(F.struct("_at", "_variant"))).alias("_vs")).select("id", F.transform("_vs", lambda x: x["_variant"]).alias("variants"))
    type_ = clean(F.col("product_type"))
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), clean), lambda t: t != "")
    kept = F.filter(F.coalesce("images", F.array().cast("array<struct<src:string,position:int,width:int,height:int>>")), lambda i: i["src"] != "")
    images = F.slice(F.transform(kept, lambda i, n: F.struct(i["src"].alias("url"), F.coalesce(i["position"], n).alias("position"), i["width"].alias("width"), i["height"].alias("height"))), 1, 12)
    ready = rows.drop("variants").join(grouped, "id").select(
        F.col("id").cast("string").alias("external_id"), F.concat(F.lit(f"https://{domain}/products/"), "handle").alias("url"), "handle", clean(F.col("title")).alias("title"),
        _blank(strip_tags(F.col("body_html"))).alias("description"), F.col("vendor").alias("brand"), F.when(type_ != "", F.array(type_)).otherwise(F.array().cast("array<string>")).alias("category_path"),
        "variants", images.alias("images"), F.slice(tags, 1, 20).alias("tags"), tags.alias("_all_tags"),
    )
    return finish(ready, slug, store_name, "api", gender_terms=F.col("_all_tags"))


MAGENTO_PRICE = "struct<minimum_price:struct<final_price:struct<value:double,currency:string>,regular_price:struct<value:double>>>"
MAGENTO = (
    "sku string, name string, url_key string, stock_status string, image struct<url:string>, media_gallery array<struct<url:string>>, description struct<html:string>, short_description struct<html:string>, "
    f"categories array<struct<name:string>>, price_range {MAGENTO_PRICE}, variants array<struct<attributes:array<struct<code:string,label:string>>,product:struct<sku:string,name:string,stock_status:string,price_range:{MAGENTO_PRICE}>>>"
)


def _magento_price(p: Column) -> tuple[Column, Column]:
    low = p["minimum_price"]
    amount = number_to_cents(low["final_price"]["value"])
    return F.when(amount > 0, amount), number_to_cents(low["regular_price"]["value"])


def magento(raw: DataFrame, slug: str, domain: str, store_name: str) -> DataFrame:
    """raw: MAGENTO columns. Variants without a price take the parent's; a simple product is its own variant."""
    sku = clean(F.col("sku"))
    amount, listed = _magento_price(F.col("price_range"))
    rows = raw.where(sku != "").withColumn("_sku", sku).withColumn("_amount", amount).withColumn("_listed", listed)
    v = F.col("_v")
    own, own_listed = _magento_price(v["product"]["price_range"])
    pairs = F.transform(F.filter(v["attributes"], lambda a: a["label"].isNotNull() & (a["label"] != "")), lambda a: F.struct(clean(a["code"]).alias("name"), clean(a["label"]).alias("value")))
    mapped = (
        rows.select("_sku", "_amount", "_listed", F.posexplode(F.filter("variants", lambda x: x.isNotNull())).alias("_at", "_v"))
        .withColumns({"_id": clean(v["product"]["sku"]), "_own": own, "_own_listed": own_listed})
        .where((F.col("_id") != "") & F.coalesce("_own", "_amount").isNotNull())
    )
    options = split_options(F.coalesce(pairs, F.array().cast("array<struct<name:string,value:string>>")))
    made = variant(F.col("_id"), F.coalesce("_own", "_amount"), availability(F.replace(F.lower(v["product"]["stock_status"]), F.lit("_"), F.lit(""))), F.when(F.col("_own").isNotNull(), F.col("_own_listed")).otherwise(F.col("_listed")), F.col("_id"), options)
    grouped = mapped.withColumn("_variant", made).groupBy("_sku").agg(in_order(F.collect_list(F.struct("_at", "_variant"))).alias("_vs"))
    single = F.array(variant(F.col("_sku"), F.col("_amount"), availability(F.replace(F.lower("stock_status"), F.lit("_"), F.lit(""))), F.col("_listed"), F.col("_sku")))
    title = clean(F.col("name"))
    handle = F.coalesce(_blank(clean(F.col("url_key"))), slugify(title))
    trail = F.filter(F.transform(F.coalesce("categories", F.array().cast("array<struct<name:string>>")), lambda c: clean(c["name"])), lambda c: c != "")
    gallery = F.transform(F.coalesce("media_gallery", F.array().cast("array<struct<url:string>>")), lambda g: g["url"])
    ready = rows.drop("variants").join(grouped, "_sku", "left").where(F.col("_vs").isNotNull() | F.col("_amount").isNotNull()).select(
        F.col("_sku").alias("external_id"), F.concat(F.lit(f"https://{domain}/"), handle, F.lit(".html")).alias("url"), handle.alias("handle"), title.alias("title"),
        F.coalesce(_blank(strip_tags(F.col("description.html"))), _blank(strip_tags(F.col("short_description.html")))).alias("description"), F.lit(None).cast("string").alias("brand"), trail.alias("category_path"),
        F.coalesce(F.transform("_vs", lambda x: x["_variant"]), single).alias("variants"), numbered_images(F.concat(F.array("image.url"), gallery)).alias("images"),
    )
    out = finish(ready, slug, store_name, "api")
    return out.withColumn("content_hash", content_hash(F.col("title"), F.col("variants"), with_stock=False))


VTEX = "productId string, productName string, brand string, linkText string, link string, metaTagDescription string, categories array<string>, productClusters map<string,string>, items array<map<string,string>>"
_OFFER = "array<struct<commertialOffer:struct<Price:double,ListPrice:double,AvailableQuantity:double,IsAvailable:boolean>>>"


def vtex(raw: DataFrame, slug: str, domain: str, store_name: str) -> DataFrame:
    """raw: VTEX columns. Items are maps, since their option columns are named by the item itself."""
    v = F.col("_v")
    offer = F.get(F.from_json(v["sellers"], _OFFER), F.lit(0))["commertialOffer"]
    images_of = lambda item: F.transform(F.from_json(item["images"], "array<struct<imageUrl:string>>"), lambda i: i["imageUrl"])
    names = F.coalesce(F.from_json(v["variations"], "array<string>"), F.array().cast("array<string>"))
    value = lambda n: F.coalesce(F.get(F.from_json(v[n], "array<string>"), F.lit(0)), F.when(~v[n].startswith("["), v[n]))
    rows = raw.where(F.col("productId").isNotNull())
    mapped = (
        rows.select("productId", F.posexplode("items").alias("_at", "_v"))
        .withColumn("_offer", offer)
        .withColumn("_amount", number_to_cents(F.col("_offer.Price")))
        .where(v["itemId"].isNotNull() & (F.col("_amount") > 0))
        .withColumn("_pairs", F.transform(names, lambda n: F.struct(n.alias("name"), value(n).alias("value"))))
    )
    o = F.col("_offer")
    made = variant(v["itemId"], F.col("_amount"), F.when(o["IsAvailable"], "in_stock").otherwise("out_of_stock"), number_to_cents(o["ListPrice"]), _blank(clean(v["ean"])), split_options(F.col("_pairs")), o["AvailableQuantity"].cast("int"), F.get(images_of(v), F.lit(0)))
    grouped = mapped.withColumn("_variant", made).groupBy("productId").agg(in_order(F.collect_list(F.struct("_at", "_variant"))).alias("_vs"))
    trail = F.filter(F.split(F.regexp_replace(F.coalesce(F.get("categories", F.lit(0)), F.lit("")), "^/+|/+$", ""), "/"), lambda c: c != "")
    handle = F.coalesce(_blank(clean(F.col("linkText"))), F.col("productId"))
    ready = rows.join(grouped, "productId").select(
        F.col("productId").alias("external_id"), F.coalesce(F.col("link"), F.concat(F.lit(f"https://{domain}/"), handle, F.lit("/p"))).alias("url"), handle.alias("handle"), clean(F.col("productName")).alias("title"),
        _blank(clean(F.col("metaTagDescription"))).alias("description"), "brand", trail.alias("category_path"), F.transform("_vs", lambda x: x["_variant"]).alias("variants"),
        numbered_images(F.flatten(F.transform("items", lambda i: F.coalesce(images_of(i), F.array().cast("array<string>"))))).alias("images"),
        F.slice(F.transform(F.map_values(F.coalesce("productClusters", F.create_map().cast("map<string,string>"))), clean), 1, 10).alias("collections"),
    )
    return finish(ready, slug, store_name, "api")


ZARA_MEDIA = "array<struct<url:string,extraInfo:struct<deliveryUrl:string>>>"
ZARA = (
    "id bigint, name string, description string, price double, oldPrice double, availability string, reference string, familyName string, subfamilyName string, sectionName string, brand string, "
    f"seo struct<keyword:string,seoProductId:string>, detail struct<reference:string,colors:array<struct<id:string,name:string,reference:string,price:double,xmedia:{ZARA_MEDIA}>>>, xmedia {ZARA_MEDIA}, "
    "category_name string, category_section string"
)
#: Sections of the store to genders.
SECTIONS = {"WOMAN": "women", "MAN": "men", "KID": "kids", "KIDS": "kids"}


def flat_categories(trees: Column, depth: int = 6) -> Column:
    """id, name, section of every node of a JSON category tree that has both id and section, parents before children.

    Trees are as deep as menus are; each level is one parse of the nodes' remaining text."""
    node = "array<struct<id:string,name:string,sectionName:string,subcategories:string>>"
    level = F.from_json(trees, node)
    found = level
    for _ in range(depth - 1):
        level = F.flatten(F.transform(F.filter(level, lambda n: n["subcategories"].isNotNull()), lambda n: F.from_json(n["subcategories"], node)))
        found = F.concat(found, F.coalesce(level, F.array().cast(node)))
    return F.transform(F.filter(found, lambda n: n["id"].isNotNull() & n["sectionName"].isNotNull()), lambda n: F.struct(n["id"].alias("id"), clean(n["name"]).alias("name"), n["sectionName"].alias("section")))


def model_key(raw_reference: Column, detail_reference: Column, id_: Column) -> Column:
    """The model that the colors and seasons of a product share: its reference up to the first dash."""
    return F.coalesce(F.trim(F.split_part(_blank(F.coalesce(_blank(detail_reference), raw_reference)), F.lit("-"), F.lit(1))), id_.cast("string"))


def zara(raw: DataFrame, slug: str, base: str, store_name: str) -> DataFrame:
    """raw: ZARA columns; prices are in cents already. Sizes are not listed."""
    media = lambda m: F.coalesce(F.when(m["url"].startswith("http"), m["url"]), F.when(m["extraInfo"]["deliveryUrl"].startswith("http"), m["extraInfo"]["deliveryUrl"]))
    none = F.array().cast(ZARA_MEDIA)
    cents, old = F.col("price").cast("long"), F.col("oldPrice").cast("long")
    state = availability(F.col("availability"))
    rows = raw.where((F.col("price") > 0) & F.col("id").isNotNull() & (clean(F.col("name")) != "")).withColumns({"_cents": cents, "_old": higher_or_null(old, cents), "_state": state})

    def of_color(c: Column) -> Column:
        own = F.coalesce(F.when(c["price"] > 0, c["price"].cast("long")), F.col("_cents"))
        options = F.struct(F.lit(None).cast("struct<raw:string,normalized:string,system:string>").alias("size"), normalize_color(c["name"]).alias("color"), F.create_map().cast("map<string,string>").alias("extras"))
        return variant(F.concat_ws("-", F.col("id").cast("string"), c["id"]), own, F.col("_state"), F.when(own == F.col("_cents"), F.col("_old")), _blank(clean(c["reference"])), options, image=media(F.get(c["xmedia"], F.lit(0))))

    colors = F.filter("detail.colors", lambda c: c.isNotNull())
    single = F.array(variant(F.col("id"), F.col("_cents"), F.col("_state"), F.col("_old"), _blank(clean(F.col("detail.reference")))))
    title = clean(F.col("name"))
    handle = F.coalesce(_blank(clean(F.col("seo.keyword"))), slugify(title))
    gallery = F.concat(F.flatten(F.transform(F.coalesce(colors, F.array().cast("array<struct<id:string,name:string,reference:string,price:double,xmedia:" + ZARA_MEDIA + ">>")), lambda c: F.transform(F.coalesce(c["xmedia"], none), media))), F.transform(F.coalesce("xmedia", none), media))
    trail = F.filter(F.transform(F.array("familyName", "subfamilyName", "category_name"), clean), lambda x: x != "")
    sections = F.create_map(*(F.lit(x) for kv in SECTIONS.items() for x in kv))
    ready = rows.select(
        F.col("id").cast("string").alias("external_id"), F.concat(F.lit(f"{base}/"), handle, F.when(F.col("seo.seoProductId").isNotNull(), F.concat(F.lit("-p"), "seo.seoProductId")).otherwise(F.lit("")), F.lit(".html")).alias("url"),
        handle.alias("handle"), title.alias("title"), _blank(clean(F.col("description"))).alias("description"), F.col("brand"), trail.alias("category_path"),
        F.when(F.size(colors) > 0, F.transform(colors, of_color)).otherwise(single).alias("variants"), numbered_images(gallery).alias("images"), F.col("_state").alias("availability"),
        F.coalesce(sections[F.upper(F.coalesce("sectionName", "category_section"))], F.lit("unknown")).alias("gender"), price(F.col("_cents"), F.col("_old")).alias("price_min"), price(F.col("_cents"), F.col("_old")).alias("price_max"),
        F.array().cast("array<string>").alias("sizes_available"), "_cents", "_old",
    )
    digest = short_hash(F.concat_ws("|", "title", F.col("_cents").cast("string"), F.coalesce(F.col("_old").cast("string"), F.lit("None")), "availability", F.size("variants").cast("string")))
    return finish(ready.withColumn("content_hash", digest), slug, store_name, "api", unless_out=True)


def generic_pages(pages: DataFrame, slug: str, store_name: str) -> DataFrame:
    """pages (url, html) of shops that describe products by JSON-LD, microdata or OpenGraph."""
    from .pages import fields

    p = F.col("p")
    rows = fields(pages, "generic")
    title = clean(p["name"])
    offers = F.transform(p["offers"], lambda o: F.struct(o.alias("o"), parse_money(o["price"]).alias("cents")))
    cents = F.filter(F.transform("_offers", lambda x: x["cents"]), lambda c: c > 0)
    states = F.filter(F.transform("_offers", lambda x: availability(x["o"]["availability"])), lambda s: s != "unknown")
    rows = rows.where(F.length(title) >= 2).withColumn("_offers", offers).withColumn("_cents", F.array_min(cents)).withColumn("_state", F.coalesce(F.get(states, F.lit(0)), F.lit("unknown"))).where(F.col("_cents") > 0)

    def of_offer(x: Column, i: Column) -> Column:
        o = x["o"]
        name = clean(F.coalesce(_blank(o["name"]), o["sku"]))
        options = F.struct(normalize_size(name).alias("size"), normalize_color(name).alias("color"), F.create_map().cast("map<string,string>").alias("extras"))
        return variant(F.coalesce(_blank(o["sku"]), _blank(o["id"]), i.cast("string")), F.coalesce(F.nullif(x["cents"], F.lit(0)), F.col("_cents")), availability(o["availability"], F.col("_state")), None, _blank(clean(o["sku"])), options)

    tail = F.element_at(F.split(F.regexp_replace(F.coalesce(F.expr("parse_url(url, 'PATH')"), F.lit("")), "/+$", ""), "/"), -1)
    ready = rows.select(
        p["id"].alias("external_id"), "url", F.coalesce(_blank(tail), slugify(title)).alias("handle"), title.alias("title"), _blank(clean(p["description"])).alias("description"), p["brand"].alias("brand"),
        F.transform(p["breadcrumb"], clean).alias("category_path"), F.transform("_offers", of_offer).alias("variants"), numbered_images(p["images"]).alias("images"), F.col("_state").alias("availability"),
        price(F.col("_cents")).alias("price_min"), price(F.array_max(cents)).alias("price_max"), F.col("_cents").alias("_cents"),
    )
    digest = short_hash(F.concat_ws("|", "title", F.col("_cents").cast("string"), "availability", F.size("variants").cast("string")))
    return finish(ready.withColumn("content_hash", digest), slug, store_name, "jsonld", unless_out=True)


def tiendanube(pages: DataFrame, slug: str, store_name: str) -> DataFrame:
    """pages (url, html). Options are positional there: the form's labels name them, else their values do."""
    from .pages import fields

    p = F.col("p")
    rows = fields(pages, "tiendanube")
    values = lambda i: F.filter(F.transform(p["variants"], lambda v: v[f"option{i}"]), lambda x: x != "")
    label = lambda i: F.coalesce(p["labels"][str(i)], F.when(F.size(values(i)) > 0, F.when(looks_like_size(values(i)), "talle").otherwise("color")), F.lit(""))
    rows = rows.withColumns({f"_l{i}": label(i) for i in range(3)})
    v = F.col("_v")
    amount = F.coalesce(F.when(v["price_number_raw"] != 0, v["price_number_raw"].cast("long")), number_to_cents(v["price_number"]))
    is_size, is_color = (lambda i: F.col(f"_l{i}").rlike("talle|size|medida")), (lambda i: F.col(f"_l{i}").contains("color"))
    # of several options of one kind the last one counts
    pick = lambda kind: F.coalesce(*(F.when(kind(i) & (v[f"option{i}"] != ""), v[f"option{i}"]) for i in (2, 1, 0)))
    size_value, color_value = pick(is_size), pick(lambda i: is_color(i) & ~is_size(i))
    extras = F.map_from_entries(F.filter(F.array(*(F.when((v[f"option{i}"] != "") & ~is_size(i) & ~is_color(i), F.struct(F.coalesce(_blank(F.col(f"_l{i}")), F.lit(f"option{i}")), clean(v[f"option{i}"]))) for i in range(3))), lambda e: e.isNotNull()))
    options = F.struct(normalize_size(size_value).alias("size"), normalize_color(color_value).alias("color"), extras.cast("map<string,string>").alias("extras"))
    image = F.when(v["image_url"].startswith("//"), F.concat(F.lit("https:"), v["image_url"])).otherwise(v["image_url"])
    mapped = rows.select("url", "p", "_l0", "_l1", "_l2", F.posexplode(p["variants"]).alias("_at", "_v")).where(v["id"].isNotNull() & amount.isNotNull())
    made = variant(v["id"], amount, F.when(v["available"], "in_stock").otherwise("out_of_stock"), number_to_cents(v["compare_at_price_number"]), _blank(v["sku"]), options, v["stock"], image)
    grouped = mapped.withColumn("_variant", made).groupBy("url").agg(in_order(F.collect_list(F.struct("_at", "_variant"))).alias("_vs"))
    inner = F.when(F.size(p["breadcrumb"]) > 2, F.slice(p["breadcrumb"], F.lit(2), F.size(p["breadcrumb"]) - 2)).otherwise(F.array().cast("array<string>"))
    ready = rows.join(grouped, "url").select(
        p["external_id"].alias("external_id"), "url", F.element_at(F.split(F.regexp_replace(F.expr("parse_url(url, 'PATH')"), "/+$", ""), "/"), -1).alias("handle"), clean(p["title"]).alias("title"),
        _blank(clean(p["description"])).alias("description"), p["brand"].alias("brand"), p["breadcrumb"].alias("category_path"), F.transform("_vs", lambda x: x["_variant"]).alias("variants"),
        F.transform(p["images"], lambda i, n: F.struct(i["url"].alias("url"), n.alias("position"), i["width"].alias("width"), F.lit(None).cast("int").alias("height"))).alias("images"),
        F.filter(inner, is_collection).alias("collections"),
    )
    return finish(ready, slug, store_name, "html+jsonld", default_gender="women")


def marketplace(pages: DataFrame, slug: str, store_name: str) -> DataFrame:
    """pages (url, html) of the wholesale marketplace: JSON-LD for the product, visible text for retail price and terms."""
    from ..functions.text import visible_text
    from .landed import from_url

    from .pages import fields

    d, text = F.col("p"), F.col("text")
    rows = fields(pages, "marketplace").withColumns({"ident": from_url(F.col("url")), "text": visible_text(F.regexp_extract("html", r"(?is)<body\b.*", 0))}).where(F.col("ident").isNotNull())
    wholesale = parse_money(F.coalesce(_blank(F.col("p.offers.lowPrice")), F.col("p.offers.price")))
    high = parse_money(F.col("p.offers.highPrice"))
    rows = rows.withColumn("_cents", wholesale).where(F.col("_cents").isNotNull()).withColumn("_retail", F.coalesce(F.nullif(retail_cents(text), F.lit(0)), F.when((high > 0) & (high != F.col("_cents")), high)))
    title = clean(F.coalesce(_blank(d["name"]), F.col("ident.title_guess")))
    state = availability(F.col("p.offers.availability"))
    who = seller(F.coalesce(_blank(F.col("p.offers.seller.name")), F.col("p.brand.name")), F.col("p.offers.seller.address.streetAddress"), text)
    trade = labelled(text, TRADE)
    images = F.filter(d["images"], lambda u: u.startswith("http"))
    ready = rows.withColumn("_min", labelled(text, MINIMUM)).select(
        F.col("ident.external_id").alias("external_id"), "url", F.coalesce(_blank(F.col("ident.handle")), slugify(title)).alias("handle"), title.alias("title"), _blank(clean(d["description"])).alias("description"),
        F.coalesce(F.col("p.brand.name"), who["name"]).alias("brand"), F.when(F.size("p.breadcrumb") > 0, F.col("p.breadcrumb")).when(trade.isNotNull(), F.array(trade)).otherwise(F.array().cast("array<string>")).alias("category_path"),
        F.array(variant(F.col("ident.external_id"), F.col("_cents"), state)).alias("variants"), numbered_images(images).alias("images"), state.alias("availability"), price(F.col("_cents")).alias("price_min"),
        price(F.coalesce("_retail", "_cents")).alias("price_max"), F.when(F.col("_retail").isNotNull(), price(F.col("_retail"))).alias("price_retail"), F.col("_min").alias("min_purchase"),
        least_purchase(F.col("_min"))["qty"].alias("min_qty"), least_purchase(F.col("_min"))["unit"].alias("min_unit"), who.alias("seller"), F.filter(F.array(labelled(text, SHIPPING)), lambda t: t != "").alias("tags"), "_cents", "_retail",
    )
    digest = short_hash(F.concat_ws("|", "title", F.col("_cents").cast("string"), F.coalesce(F.col("_retail").cast("string"), F.lit("None")), F.size("images").cast("string")))
    return finish(ready.withColumn("content_hash", digest), slug, store_name, "jsonld")
