"""What wholesale pages say in plain text lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import parse_money
from .text import clean

#: Labels on the page and units of the least purchase.
RETAIL = r"(?iu)Precio\s+por\s+menor\s*:?\s*\$?\s*([\d.,]+)"
MINIMUM = r"(?iu)Compra\s+m[ií]nima\s*:\s*\n?([^\n]{1,60})"
SHIPPING = r"(?iu)Compra\s+m[ií]nima\s+para\s+env[ií]os\s*:\s*\n?([^\n]{1,60})"
TRADE = r"(?iu)Rubro\s*:\s*\n?([^\n]{1,60})"
FOLLOWERS = r"([\d.]+)\s*\n?\s*Seguidores"
UNITS = ("curva", "pares", "unidades", "prendas", "docena", "art")


def labelled(text: Column, pattern: str) -> Column:
    """The text after a label, cleaned; null where the label is missing."""
    return F.when(text.rlike(pattern), clean(F.regexp_extract(text, pattern, 1)))


def retail_cents(text: Column) -> Column:
    return parse_money(F.regexp_extract(text, RETAIL, 1))


def least_purchase(raw: Column) -> Column:
    """struct(qty, unit): a number of 1 to 200 among the first 40 characters, and the first unit named."""
    low = F.lower(raw)
    number = F.regexp_extract(F.substring(low, 1, 40), r"\b(\d{1,3})\b", 1).try_cast("int")
    unit = F.when(F.lit(False), F.lit(None).cast("string"))
    for u in UNITS:
        unit = unit.when(F.contains(low, F.lit(u)), F.lit(u))
    return F.struct(F.when(number.between(1, 200), number).alias("qty"), unit.alias("unit"))


def seller(name: Column, address: Column, text: Column) -> Column:
    found = F.nullif(clean(name), F.lit(""))
    return F.when(
        found.isNotNull(),
        F.struct(
            F.lit(None).cast("string").alias("external_id"),
            found.alias("name"),
            F.nullif(clean(address), F.lit("")).alias("address"),
            (F.contains(text, F.lit("Verificado por")) | F.contains(text, F.lit("tienda aprobada"))).alias("verified"),
            F.replace(F.regexp_extract(text, FOLLOWERS, 1), F.lit("."), F.lit("")).try_cast("int").alias("followers"),
        ),
    )
