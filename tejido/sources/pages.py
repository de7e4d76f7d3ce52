"""Pages to plain fields by column expressions: structured data as variants, marked elements as arrays.

`fields(pages, kind)` adds a struct `p` to url and html and leaves out pages that are no product of this kind. Structured
data is parsed into VARIANT columns and looked into by paths. Only what needs a parser of markup (microdata, galleries,
descriptions) goes through one Arrow pass that turns a page into an array of its elements, and only on pages that may
have it; what is taken from them is again an expression.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, slugify, unescape

LD = r"""(?s)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
META = r"""(?i)<meta[^>]+(?:property|name)=["']([^"']+)["'][^>]+content=["']([^"']*)["']"""


# --- structured data


def no_texts() -> Column:
    return F.array().cast("array<string>")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each worked out once a row however often later ones use it: plain selects would be merged."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column) -> Column:
    """STRING, OBJECT<...>, ARRAY<...>, BIGINT and so on; null for nothing."""
    return F.schema_of_variant(v)


def listed(v: Column) -> Column:
    """What a variant lists: its elements, itself where it is no list, none for null."""
    one = F.when(v.isNotNull() & (kind_of(v) != "VOID"), F.array(v)).otherwise(F.array().cast("array<variant>"))
    return F.coalesce(at(v, "$", "array<variant>"), one)


def objects(v: Column) -> Column:
    return F.filter(listed(v), lambda x: kind_of(x).startswith("OBJECT"))


def structured(html: Column) -> Column:
    """The page's JSON-LD blocks; what can't be parsed is left out."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(LD), 1), lambda t: F.try_parse_json(F.trim(t))), lambda v: v.isNotNull())


def nodes(blocks: Column) -> Column:
    """Objects of all blocks with those under @graph and mainEntity, two levels down; of several in one place the last comes first."""
    inner = lambda n: F.reverse(F.concat(objects(at(n, "$['@graph']")), objects(at(n, "$.mainEntity"))))
    with_inner = lambda n: F.concat(F.array(n), inner(n))
    of_top = lambda n: F.concat(F.array(n), F.flatten(F.transform(inner(n), with_inner)))
    return F.flatten(F.transform(blocks, lambda b: F.flatten(F.transform(F.reverse(objects(b)), of_top))))


def first_of(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def typed(name: str) -> Callable[[Column], Column]:
    """Whether a node's @type, one or several, names this type."""
    return lambda n: F.contains(at(n, "$['@type']", "string"), F.lit(name))


def blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def said(v: Column) -> Column:
    """A text given as such, as an object's name or value, or by the first of a list; else empty."""
    def of(x: Column) -> Column:
        named = F.coalesce(F.nullif(at(x, "$.name", "string"), F.lit("")), at(x, "$['@value']", "string"))
        return F.when(kind_of(x) == "STRING", x.try_cast("string")).when(kind_of(x).startswith("OBJECT"), named)

    first = lambda x: F.coalesce(at(x, "$[0]"), x)
    return F.coalesce(let(first(first(v)), of), F.lit(""))


def money_text(v: Column) -> Column:
    """Texts as they are; numbers as the money rules read them, with a decimal comma and no grouping."""
    number = F.translate(F.format_string("%.6f", v.try_cast("double")), ".", ",")
    return F.when(kind_of(v) == "STRING", v.try_cast("string")).when(kind_of(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), number)


def trail(node: Column, key: Callable[[Column], Column]) -> Column:
    """Names of a breadcrumb's elements."""
    return F.transform(objects(at(node, "$.itemListElement")), key)


# --- open graph and addresses


def properties(html: Column) -> Column:
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(META), 1).alias("k"), F.regexp_extract_all(html, F.lit(META), 2).alias("v"))


def open_graph(pairs: Column) -> Callable[[str], Column]:
    """The value of a property by its lower-case name; the last of several, null for none or a blank one."""
    return lambda name: F.nullif(F.try_element_at(F.filter(pairs, lambda x: F.lower(x["k"]) == name), F.lit(-1))["v"], F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit(""))


def last_segment(url: Column) -> Column:
    return F.lower(F.regexp_extract(path_of(url), r"([^/]*)/*$", 1))


def joined(base: Column, address: Column) -> Column:
    """An address as seen from a page."""
    a = F.trim(address)
    origin, scheme = F.regexp_extract(base, r"^([a-z]+://[^/?#]*)", 1), F.regexp_extract(base, r"^([a-z]+:)", 1)
    return (
        F.when(a.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), a).when(a.startswith("//"), F.concat(scheme, a)).when(a.startswith("/"), F.concat(origin, a))
        .otherwise(F.concat(F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:]/)[^/]*$", ""), a))
    )


# --- elements


class _Elements(HTMLParser):
    """Elements with attributes, in document order: tag, attributes, places of the elements around; texts of those that `wanted` picks."""

    CLOSED = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.around: list[tuple[str, int]] = []

    @staticmethod
    def wanted(tag: str, attrs: dict[str, str]) -> bool:
        return tag == "h1" or "itemprop" in attrs or "product-description" in f"{attrs.get('class')} {attrs.get('data-store')}"

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in attrs}
        self.out.append((tag, named, [i for _, i in self.around], [] if self.wanted(tag, named) else None))
        if tag not in self.CLOSED:
            self.around.append((tag, len(self.out) - 1))

    def handle_endtag(self, tag):
        depth = max((d for d, (t, _) in enumerate(self.around) if t == tag), default=None)
        if depth is not None:
            del self.around[depth:]

    def handle_data(self, data):
        for _, i in self.around:
            if self.out[i][3] is not None:
                self.out[i][3].append(data)


ELEMENT = "struct<tag:string,attrs:map<string,string>,around:array<int>,text:string>"


def parsed(page: str | None) -> list[dict] | None:
    if page is None:
        return None
    parser = _Elements()
    parser.feed(page)
    parser.close()
    return [{"tag": t, "attrs": a, "around": up, "text": None if x is None else " ".join("".join(x).split())} for t, a, up, x in parser.out]


def elements(html: Column) -> Column:
    """A page's elements; null for null."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(parsed)

    return F.pandas_udf(run, f"array<{ELEMENT}>")(html)


def place(items: Column, test: Callable[[Column], Column]) -> Column:
    """Where the first element that passes stands; null for none."""
    return F.get(F.filter(F.transform(items, lambda e, i: F.when(test(e), i)), lambda i: i.isNotNull()), F.lit(0))


def microdata(items: Column, top: Column) -> Callable[[str], Column]:
    """The first non-blank value of a property inside the element at a place: content, src, href or text; null for none."""
    value = lambda e: F.coalesce(*(F.nullif(e["attrs"][k], F.lit("")) for k in ("content", "src", "href")), F.nullif(e["text"], F.lit("")))
    return lambda name: F.get(F.filter(F.transform(F.filter(items, lambda e: (e["attrs"]["itemprop"] == name) & F.array_contains(e["around"], top)), value), lambda x: x.isNotNull()), F.lit(0))


# --- kinds of pages


def _offer(price: Column, availability: Column, name: Column, sku: Column, id_: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(price.alias("price"), empty(availability).alias("availability"), empty(name).alias("name"), empty(sku).alias("sku"), empty(id_).alias("id"))


def _with_offers(rows: DataFrame) -> DataFrame:
    """_offers of _node: listed, wrapped in an aggregate, or the aggregate itself, which may have its lowest price only."""
    rows = once(rows, _given=at(F.col("_node"), "$.offers"))
    given = F.col("_given")
    single = kind_of(given).startswith("OBJECT")
    rows = once(rows, _inside=F.when(single, listed(at(given, "$.offers"))))
    wrapped = F.coalesce(F.size("_inside") > 0, F.lit(False))
    rows = once(rows, _some=F.when(wrapped, F.filter("_inside", lambda x: kind_of(x).startswith("OBJECT"))).otherwise(objects(given)), _bare=single & ~wrapped)
    own = lambda o: money_text(at(o, "$.price"))
    low = lambda o: F.when(F.col("_bare") & F.coalesce(own(o).isin("", "0,000000"), F.lit(True)), F.nullif(money_text(at(o, "$.lowPrice")), F.lit("")))
    text = lambda o, k: at(o, k, "string")
    found = F.transform("_some", lambda o: _offer(F.coalesce(low(o), own(o)), text(o, "$.availability"), said(at(o, "$.name")), text(o, "$.sku"), text(o, "$['@id']")))
    nothing = F.lit(None).cast("string")
    rows = once(rows, _found=found)
    return once(rows, _offers=F.when((F.size("_found") > 0) | kind_of(given).startswith("ARRAY"), F.col("_found")).otherwise(F.array(_offer(nothing, nothing, nothing, nothing, nothing))))


def _generic(pages: DataFrame) -> DataFrame:
    """Products by JSON-LD, else by microdata, else by OpenGraph."""
    html, url = F.col("html"), F.col("url")
    rows = once(once(pages, _blocks=structured(html), _og=properties(html)), _nodes=nodes(F.col("_blocks")))
    rows = once(rows, _node=first_of(F.col("_nodes"), typed("Product")), _trail=first_of(F.col("_nodes"), typed("BreadcrumbList")))
    rows = rows.withColumn("_elements", elements(F.when(F.col("_node").isNull() & F.contains(html, F.lit("schema.org/Product")), html)))
    rows = once(rows, _top=place(F.col("_elements"), lambda e: F.contains(e["attrs"]["itemtype"], F.lit("schema.org/Product"))))
    og, micro, node = open_graph(F.col("_og")), microdata(F.col("_elements"), F.col("_top")), F.col("_node")
    nothing = F.lit(None).cast("string")
    image = lambda i: F.coalesce(F.when(kind_of(i) == "STRING", i.try_cast("string")), F.nullif(at(i, "$.url", "string"), F.lit("")), at(i, "$.contentUrl", "string"))
    name_of = lambda i: F.coalesce(F.nullif(said(at(i, "$.name")), F.lit("")), said(at(i, "$.item")))
    given_id = F.coalesce(*(F.when(kind_of(at(node, k)) == "STRING", blank(at(node, k, "string"))) for k in ("$.sku", "$.productID", "$.mpn", "$['@id']")))
    # what each way of description says; the first that says anything counts
    by_items, by_graph = node.isNull() & micro("name").isNotNull(), node.isNull() & og("og:type").startswith("product")
    rows = once(
        _with_offers(rows), _crumbs=trail(F.col("_trail"), name_of), _given_id=given_id, _by_items=F.coalesce(by_items, F.lit(False)), _by_graph=F.coalesce(by_graph, F.lit(False)), _slug=slugify(url),
        _pictures=F.filter(F.transform(listed(at(node, "$.image")), image), lambda u: F.trim(u) != ""), _shown=og("og:image"),
    )
    way = lambda by_node, item, graph: F.when(node.isNotNull(), by_node).when(F.col("_by_items"), item).otherwise(graph)
    text = lambda k, item, graph: F.coalesce(way(said(at(node, k)), item, graph), F.lit(""))
    listed_ = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    images = way(F.col("_pictures"), listed_(micro("image")), listed_(F.col("_shown")))
    tail = lambda c: F.right(c, F.lit(80))
    own_id = F.coalesce(blank(F.left(slugify(F.col("_given_id")), F.lit(80))), tail(F.col("_slug")))
    one = lambda price, state: F.array(_offer(price, state, nothing, nothing, nothing))
    rows = once(
        rows.where(node.isNotNull() | F.col("_by_items") | F.col("_by_graph")), _name=text("$.name", micro("name"), og("og:title")), _description=text("$.description", micro("description"), og("og:description")),
        _brand=text("$.brand", micro("brand"), og("og:site_name")), _images=F.when(F.size(images) > 0, images).otherwise(listed_(F.col("_shown"))),
        _id=F.when(F.col("_given_id").isNotNull(), own_id).otherwise(F.coalesce(blank(tail(slugify(path_of(url)))), tail(F.col("_slug")))),
        _all=way(F.col("_offers"), one(micro("price"), micro("availability")), one(F.coalesce(og("product:price:amount"), og("og:price:amount")), og("product:availability"))),
    )
    p = F.struct(
        F.col("_name").alias("name"), F.col("_description").alias("description"), F.col("_brand").alias("brand"), F.col("_id").alias("id"),
        F.coalesce(F.slice("_crumbs", F.lit(2), F.greatest(F.size("_crumbs") - 2, F.lit(0))), no_texts()).alias("breadcrumb"), F.transform("_images", lambda u: joined(url, u)).alias("images"), F.col("_all").alias("offers"),
    )
    return once(rows, p=p).select("url", "html", "p")


SHOP_VARIANT = "array<struct<product_id:string,id:string,price_number:double,price_number_raw:double,compare_at_price_number:double,stock:int,sku:string,available:boolean,option0:string,option1:string,option2:string,image_url:string>>"
GALLERY = r"(acdn[\w\-.]*\.mitiendanube\.com/stores/[\d/]+/products/([\w\-]+?)-(\d+)-\d+\.(?:webp|jpg|jpeg|png))"


def _gallery(items: Column, most: int = 12) -> tuple[Column, Column]:
    """What is met in the product's part of the page (to be named _met), and of it as (url, width) each image's widest, in the order of meeting."""
    has = lambda name: lambda e: F.array_contains(F.split(F.coalesce(e["attrs"]["class"], F.lit("")), r"\s+"), name)
    places = lambda test: F.filter(F.transform(items, lambda e, i: F.when(test(e), i)), lambda i: i.isNotNull())
    column, whole = places(has("js-product-detail-img-col")), places(has("js-product-detail"))
    tops = F.when(F.size(column) > 0, column).otherwise(whole)
    inside_of = lambda tops: F.filter(F.transform(items, lambda e, i: F.when((F.size(tops) == 0) | F.array_contains(tops, i) | F.arrays_overlap(tops, e["around"]), F.map_values(e["attrs"]))), lambda e: e.isNotNull())
    text = F.array_join(F.flatten(let(tops, inside_of)), "\n")
    part = lambda t, i, name: F.regexp_extract_all(t, F.lit(GALLERY), i).alias(name)
    met = F.transform(let(text, lambda t: F.arrays_zip(part(t, 1, "address"), part(t, 2, "name"), part(t, 3, "width"))), lambda x, i: F.struct(x["width"].cast("int").alias("width"), (-i).alias("order"), x["name"].alias("name"), F.concat(F.lit("https://"), x["address"]).alias("url")))
    names = F.slice(F.array_distinct(F.transform(F.col("_met"), lambda x: x["name"])), 1, most)
    widest = F.transform(names, lambda n: F.array_max(F.filter(F.col("_met"), lambda x: x["name"] == n)))
    return met, F.transform(widest, lambda x: F.struct(x["url"].alias("url"), x["width"].alias("width")))


def _labels(html: Column) -> Column:
    """Names of options by place, from the first form that names any."""
    label = r"""(?s)<label[^>]*for="variation_(\d+)"[^>]*>(.*?)</label>"""
    clean = lambda t: F.lower(F.trim(F.regexp_replace(unescape(F.regexp_replace(t, "<[^>]+>", "")), r"\s+", " ")))
    of = lambda form: F.transform(F.arrays_zip(F.regexp_extract_all(form, F.lit(label), 1).alias("n"), F.regexp_extract_all(form, F.lit(label), 2).alias("t")), lambda x: F.struct((x["n"].cast("int") - 1).cast("string"), clean(x["t"])))
    forms = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<form\b.*?</form>"), 0), of)
    return F.coalesce(F.map_from_entries(first_of(forms, lambda f: F.size(f) > 0)), F.create_map().cast("map<string,string>"))


def _tiendanube(pages: DataFrame) -> DataFrame:
    """Products by a page's variants attribute and its WebPage block; a page about another address is a dead one."""
    html, url = F.col("html"), F.col("url")
    about = lambda b: F.coalesce(at(b, "$.mainEntity['@id']", "string"), F.lit(""))
    webs = F.filter(F.flatten(F.transform(structured(html), objects)), lambda b: at(b, "$['@type']", "string") == "WebPage")
    rows = once(pages, _webs=webs, _asked=last_segment(url)).where((F.col("_asked") == "") | F.exists("_webs", lambda b: last_segment(about(b)) == F.col("_asked")))
    raw = F.regexp_extract(html, r"""(?s)data-variants=(["'])(.*?)\1""", 2)
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    web = F.coalesce(first_of(F.col("_webs"), lambda b: bare(about(b)) == bare(url)), F.get("_webs", F.lit(0)))
    script = F.regexp_extract(html, r"(?s)LS\.product\s*=\s*\{(.*?)\n\s*\}", 1)
    rows = once(rows.withColumn("_elements", elements(html)), _v=F.from_json(unescape(raw), SHOP_VARIANT), _web=web, _script=script)
    items, main = F.col("_elements"), at(F.col("_web"), "$.mainEntity")
    has = lambda e, key, name: F.array_contains(F.split(F.coalesce(e["attrs"][key], F.lit("")), r"\s+"), name)
    text_of = lambda key, name: first_of(items, lambda e: has(e, key, name) & (e["text"] != ""))["text"]
    described = [text_of("class", "js-product-description"), text_of("data-store", "product-description"), text_of("class", "product-description")]
    external = F.coalesce(F.nullif(F.get("_v", F.lit(0))["product_id"], F.lit("0")), F.nullif(F.regexp_extract("_script", r"id\s*:\s*(\d+)", 1), F.lit("")))
    crumbs = F.filter(trail(at(F.col("_web"), "$.breadcrumb"), lambda i: F.trim(F.regexp_replace(at(i, "$.name", "string"), r"\s+", " "))), lambda x: x != "")
    met, pictures = _gallery(items)
    p = F.struct(
        external.alias("external_id"), F.coalesce(F.nullif(at(main, "$.name", "string"), F.lit("")), first_of(items, lambda e: e["tag"] == "h1")["text"], F.lit("")).alias("title"),
        F.coalesce(*described, at(main, "$.description", "string")).alias("description"), F.when(F.col("_script").rlike(r"brand\s*:\s*'"), F.regexp_extract("_script", r"brand\s*:\s*'([^']*)'", 1)).alias("brand"),
        F.coalesce(crumbs, no_texts()).alias("breadcrumb"), pictures.alias("images"), _labels(html).alias("labels"), F.coalesce("_v", F.array().cast(SHOP_VARIANT)).alias("variants"),
    )
    return once(once(rows, _met=met), p=p).select("url", "html", "p").where(F.col("p.external_id").isNotNull())


def _marketplace(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    rows = once(pages, _blocks=F.filter(structured(html), lambda b: kind_of(b).startswith("OBJECT")))
    of = lambda name: first_of(F.col("_blocks"), lambda b: at(b, "$['@type']", "string") == name)
    rows = once(rows, _d=of("Product"), _trail=of("BreadcrumbList")).where(F.col("_d").isNotNull())
    d, text = F.col("_d"), lambda v, k: at(v, k, "string")
    images = F.filter(F.transform(listed(at(d, "$.image")), lambda i: F.when(kind_of(i) == "STRING", i.try_cast("string"))), lambda u: u.isNotNull())
    who = F.struct(text(d, "$.offers.seller.name").alias("name"), F.struct(text(d, "$.offers.seller.address.streetAddress").alias("streetAddress")).alias("address"))
    cost = lambda k: money_text(at(d, k)).alias(k.rsplit(".", 1)[1])
    offers = F.struct(cost("$.offers.lowPrice"), cost("$.offers.highPrice"), cost("$.offers.price"), text(d, "$.offers.availability").alias("availability"), who.alias("seller"))
    crumbs = F.filter(trail(F.col("_trail"), lambda i: F.trim(F.regexp_replace(text(i, "$.name"), r"\s+", " "))), lambda x: x != "")
    p = F.struct(text(d, "$.name").alias("name"), text(d, "$.description").alias("description"), images.alias("images"), F.struct(text(d, "$.brand.name").alias("name")).alias("brand"), offers.alias("offers"), F.coalesce(crumbs, no_texts()).alias("breadcrumb"))
    return once(rows, p=p).select("url", "html", "p")


KINDS = {"generic": _generic, "tiendanube": _tiendanube, "marketplace": _marketplace}


def fields(pages: DataFrame, kind: str) -> DataFrame:
    """url, html, p: the page's fields; pages without an address or content, or that are no product of this kind, are left out."""
    return KINDS[kind](pages.select("url", "html").where("url <> '' and html <> ''"))
