"""Sizes: one canonical value and the system it belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, fold, let

#: Spellings of letter sizes and of one size for all.
LETTERS = {
    "xxs": "XXS", "xs": "XS", "s": "S", "small": "S", "m": "M", "medium": "M", "mediano": "M", "l": "L", "large": "L", "g": "L", "grande": "L",
    "xl": "XL", "xg": "XL", "xxl": "XXL", "xxg": "XXL", "xxxl": "XXXL",
}
ONE_SIZE = ("unico", "talle unico", "u", "tu", "one size", "os", "unitalla", "único", "talle único")
RANGE = r"^(\d{1,2})\s*[-/aA]\s*(\d{1,2})$"
DIMENSION = r"^(\d{2,3})\s*[xX×]\s*(\d{2,3})$"


def normalize_size(raw: Column) -> Column:
    """struct(raw, normalized, system); null for null or blank."""
    return let(clean(raw), lambda original: F.when(original != "", let(F.lower(fold(original)), lambda folded: _size(original, folded))))


def _size(original: Column, folded: Column) -> Column:
    trimmed = F.regexp_replace(folded, r"^[ .:\-]+|[ .:\-]+$", "")
    return let(F.trim(F.regexp_replace(trimmed, r"^(talle|talles|size|t)\b[\s.:-]*", "")), lambda key: _of_key(original, folded, key))


def _of_key(original: Column, folded: Column, key: Column) -> Column:
    letters = F.create_map(*(F.lit(x) for kv in LETTERS.items() for x in kv))
    n = F.when(key.rlike(r"^\d{1,9}$"), key.cast("int"))
    digits = key.rlike(r"^\d+$")
    of = lambda value, system: F.struct(original.alias("raw"), value.cast("string").alias("normalized"), F.lit(system).alias("system"))
    return (
        F.when(key.isin(*ONE_SIZE) | folded.isin(*ONE_SIZE), of(F.lit("ONE SIZE"), "one_size"))
        .when(letters[key].isNotNull(), of(letters[key], "alpha"))
        .when(key.rlike(RANGE), of(F.regexp_extract(key, RANGE, 1), "ar_numeric"))
        .when(key.rlike(DIMENSION), of(F.concat_ws("x", F.regexp_extract(key, DIMENSION, 1), F.regexp_extract(key, DIMENSION, 2)), "dimension"))
        .when(digits & n.between(32, 60), of(key, "ar_numeric"))
        .when(digits & n.between(20, 31), of(key, "shoe_ar"))
        .when(digits & n.between(1, 18), of(key, "kids_numeric"))
        .when(digits, of(key, "unknown"))
        .otherwise(of(F.lit(None), "unknown"))
    )


def looks_like_size(values: Column) -> Column:
    """Whether at least half (rounded down, one at least) of the values are known sizes."""
    known = F.filter(values, lambda v: F.coalesce(normalize_size(v)["system"] != "unknown", F.lit(False)))
    return (F.size(values) > 0) & (F.size(known) >= F.greatest(F.lit(1), F.floor(F.size(values) / 2)))


def suspicious_color_set(values: Column) -> Column:
    """Two or more colors that all look like numbers."""
    filled = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return (F.size(filled) >= 2) & F.forall(filled, lambda v: F.trim(v).rlike(r"^[\d\sxX×.,/-]+$"))
