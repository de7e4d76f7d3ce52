"""Category, gender and collection rules, as one pattern for each rule in the rules' order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, let, word

#: Category words in rule order, campaign words, gender words.
CATEGORIES = {
    "dresses": ("vestido", "dress", "enterito", "mono ", "jumpsuit"),
    "jeans": ("jean", "denim", "mom fit", "wide leg"),
    "pants": ("pantalon", "pants", "pant", "cargo", "jogger", "calza", "legging", "babucha", "palazzo", "sastrero"),
    "skirts": ("pollera", "skirt", "falda", "faldas"),
    "shorts": ("short", "bermuda"),
    "tops": ("top", "remera", "reme", "chomba", "musculosa", "blusa", "camisa", "body", "corset", "shirt", "tee", "crop", "camiseta", "polo"),
    "knitwear": ("sweater", "buzo", "hoodie", "cardigan", "pullover", "sudadera", "jersey", "punto", "chaleco"),
    "outerwear": ("campera", "abrigo", "tapado", "saco", "blazer", "trench", "parka", "chaqueta", "cazadora", "gabardina", "abrigos", "plumifero", "plumífero", "anorak"),
    "swimwear": ("bikini", "malla", "swim", "salida de bano"),
    "lingerie": ("lenceria", "conjunto de ropa interior", "corpino", "bombacha", "pijama", "night"),
    "activewear": ("deportivo", "active", "sport", "training"),
    "shoes": ("zapatilla", "zapato", "calzado", "bota", "sandalia", "sandal", "borcego", "mocasin", "shoes", "footwear", "botineta", "alpargata"),
    "bags": ("cartera", "bolso", "bolsos", "mochila", "riñonera", "rinonera", "bag", "bandolera", "shopper"),
    "jewelry": ("collar", "anillo", "aros", "pulsera", "bracelet", "necklace", "earring"),
    "accessories": ("accesorio", "cinto", "gorra", "bufanda", "pañuelo", "panuelo", "lentes", "medias", "gorro", "cinturon", "cinturón", "guantes", "sombrero", "pashmina"),
    "giftcard": ("gift card", "giftcard", "tarjeta de regalo"),
}
CAMPAIGNS = (
    "new-in", "newin", "sale", "outlet", "2x1", "3x2", "promo", "descuento", "black-friday", "cyber", "hot-sale", "destacado", "lo-mas", "days", "essentials",
    "verano", "invierno", "primavera", "otono", "capsula", "drop", "preventa",
)
GENDERS = {
    "kids": ("nino", "nina", "kids", "infantil", "bebe", "junior"),
    "men": ("hombre", "men", "masculino", "caballero"),
    "women": ("mujer", "women", "femenino", "dama", "womens"),
}
WOMEN_CATEGORIES = ("dresses", "skirts", "lingerie")


def _joined(*parts: Column) -> Column:
    return F.lower(fold(F.concat_ws(" ", *(F.when(p != "", p) for p in parts))))


def category_of(source: Column) -> Column:
    return let(source, _category)


def _category(source: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, tokens in CATEGORIES.items():
        out = out.when(source.rlike(word(tokens, plural=True)), F.lit(name))
    return out


def classify_category(title: Column, breadcrumb: Column, handle: Column | None = None) -> Column:
    """The breadcrumb decides before title and handle; within each, the first rule that has a whole word there."""
    trail = F.lower(fold(F.array_join(F.filter(breadcrumb, lambda x: x != ""), " ")))
    return F.coalesce(category_of(trail), category_of(_joined(title, *([handle] if handle is not None else []))))


def classify_gender(title: Column, breadcrumb: Column, default: str = "unknown", category: Column | None = None) -> Column:
    source = _joined(title, F.array_join(F.filter(breadcrumb, lambda x: x != ""), " "))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, tokens in GENDERS.items():
        out = out.when(source.rlike(word(tokens, plural=True)), F.lit(name))
    if category is not None:
        out = out.when(category.isin(*WOMEN_CATEGORIES), F.lit("women"))
    return out.otherwise(F.lit(default))


def is_collection(segment: Column) -> Column:
    return F.lower(fold(segment)).rlike("|".join(CAMPAIGNS))
