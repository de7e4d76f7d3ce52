"""Prices in text to whole cents. A point groups thousands, a comma starts the decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _cents(number: Column) -> Column:
    return F.bround(number.try_cast("decimal(28,6)") * 100).cast("long")


def parse_money(c: Column) -> Column:
    """Text to cents, half to even; null where it is no number."""
    return let(F.regexp_replace(c, r"[^\d,.\-]", ""), _money)


def _money(s: Column) -> Column:
    whole, part = F.split_part(s, F.lit("."), F.lit(1)), F.split_part(s, F.lit("."), F.lit(2))
    points = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    plain = (
        F.when(F.contains(s, F.lit(",")), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((points == 1) & (F.length(part) == 3) & (F.length(whole) <= 3), F.concat(whole, part))
        .when(points == 1, s)
        .otherwise(F.replace(s, F.lit("."), F.lit("")))
    )
    return _cents(F.when(s != "", plain))


def number_to_cents(c: Column) -> Column:
    return F.bround(c.cast("decimal(28,6)") * 100).cast("long")


def spoken_cents(number: Column, unit: Column) -> Column:
    """A number in a question, with its unit of thousands, truncated to cents; null where it is no number."""
    n = F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    n = F.when(F.lower(unit).isin("lucas", "mil", "k"), n * 1000).otherwise(n)
    return (n * 100).cast("long")


def higher_or_null(compare_at: Column, price: Column) -> Column:
    """A list price only counts when it is above the price."""
    return F.when(compare_at > price, compare_at)


def discount_pct(amount: Column, compare_at: Column) -> Column:
    return F.when((compare_at > 0) & (compare_at > amount), F.round(100 * (1 - amount / compare_at), 2))
