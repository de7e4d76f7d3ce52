"""Derived columns of products: hashes, texts, availability, galleries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The last part of an availability address or a platform's own word.
AVAILABILITY = {
    "instock": "in_stock", "in_stock": "in_stock", "limitedavailability": "in_stock", "outofstock": "out_of_stock", "out_of_stock": "out_of_stock", "soldout": "out_of_stock",
    "preorder": "preorder", "backorder": "preorder",
}


def availability(raw: Column, otherwise: Column | str = "unknown") -> Column:
    known = F.create_map(*(F.lit(x) for kv in AVAILABILITY.items() for x in kv))
    tail = F.lower(F.element_at(F.split(F.coalesce(raw, F.lit("")), "/"), -1))
    return F.coalesce(known[tail], F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def content_hash(title: Column, variants: Column, with_stock: bool = True) -> Column:
    """Changes when the title, or a variant's price, availability or stock does; the order of variants does not matter."""
    parts = F.transform(
        F.array_sort(variants, lambda a, b: F.when(a["external_id"] < b["external_id"], -1).when(a["external_id"] > b["external_id"], 1).otherwise(0)),
        lambda v: F.concat_ws(":", v["external_id"], v["price"]["amount_cents"].cast("string"), v["availability"], *([F.coalesce(v["stock"].cast("string"), F.lit("None"))] if with_stock else [])),
    )
    return short_hash(F.concat(title, F.lit("|"), F.array_join(parts, "|")))


def distinct_in_stock(variants: Column, value, unless_out: bool = False) -> Column:
    """Distinct values of the variants that can be bought, in order of first appearance."""
    there = (lambda v: v["availability"] != "out_of_stock") if unless_out else (lambda v: v["availability"] == "in_stock")
    return F.array_distinct(F.filter(F.transform(F.filter(variants, there), value), lambda x: x.isNotNull() & (x != "")))


def numbered_images(urls: Column, most: int = 12) -> Column:
    kept = F.slice(F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != ""))), 1, most)
    return F.transform(kept, lambda u, i: F.struct(u.alias("url"), i.alias("position"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height")))


def embedding_text(title: Column, category: Column, brand: Column, seller: Column, colors: Column, sizes: Column, description: Column, generated: Column) -> Column:
    """What a product is embedded by. A shop description of fewer than 20 characters gives way to the generated one."""
    own = F.when(F.length(F.trim(description)) >= 20, description).otherwise(generated)
    listed = lambda label, xs, n: F.when(F.size(xs) > 0, F.concat(F.lit(label), F.array_join(F.slice(xs, 1, n), " ")))
    parts = (title, category, brand, seller, listed("colores ", colors, 6), listed("talles ", sizes, 8), F.substring(own, 1, 280))
    return F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in parts))


def context_line(number: Column, title: Column, price: Column, retail: Column, seller: Column, address: Column, brand: Column, minimum: Column, sizes: Column, colors: Column) -> Column:
    """One numbered line of facts about a result."""
    some = lambda c: c.isNotNull() & (c != "")
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    parts = (
        F.concat(F.lit("["), number.cast("string"), F.lit("] "), title),
        money(price),
        F.when(retail > 0, F.concat(F.lit("(por menor "), money(retail), F.lit(")"))),
        F.when(some(seller), F.concat(F.lit("local: "), seller)),
        F.when(some(seller) & some(address), F.concat(F.lit("("), address, F.lit(")"))),
        F.when(~F.coalesce(some(seller), F.lit(False)) & some(brand), F.concat(F.lit("marca: "), brand)),
        F.when(some(minimum), F.concat(F.lit("compra mínima: "), minimum)),
        F.when(F.size(sizes) > 0, F.concat(F.lit("talles: "), F.array_join(F.slice(sizes, 1, 8), ", "))),
        F.when(F.size(colors) > 0, F.concat(F.lit("colores: "), F.array_join(F.slice(colors, 1, 6), ", "))),
    )
    return F.concat_ws(" · ", *parts)
