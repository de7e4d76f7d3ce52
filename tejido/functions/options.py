"""Named shop options to size, color and extras."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import normalize_color
from .size import looks_like_size, normalize_size
from .text import clean, fold, let

#: What option names contain.
SIZE_NAMES = "talle|size|medida|numero|n°|calce"
COLOR_NAMES = "color|colour|tono"


def option_kind(name: Column) -> Column:
    n = F.lower(fold(clean(name)))
    return F.when(n.rlike(SIZE_NAMES), "size").when(n.rlike(COLOR_NAMES), "color").otherwise("extra")


def split_options(pairs: Column) -> Column:
    """array<struct(name, value)> to struct(size, color, extras).

    Options with a telling name are placed first, one each; the others by their value, as a size if it looks like one.
    The order of the options decides among equals, so the leftovers are folded in order.
    """
    filled = F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))
    kinds = F.transform(filled, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"), option_kind(p["name"]).alias("kind")))
    # each step is bound once: a repeated expression would be worked out again wherever it is used
    return let(kinds, lambda k: let(_placed(k), lambda done: F.struct(normalize_size(done["size"]).alias("size"), normalize_color(done["color"]).alias("color"), _as_map(done["extras"]).alias("extras"))))


def _placed(kinds: Column) -> Column:
    """struct(size, color, extras) of raw values."""
    place_of = lambda kind: F.array_position(F.transform(kinds, lambda p: p["kind"]), kind)
    return let(F.struct(place_of("size").alias("size"), place_of("color").alias("color")), lambda first: _leftovers(kinds, first))


def _leftovers(kinds: Column, first: Column) -> Column:
    named = lambda kind: F.when(first[kind] > 0, F.get(kinds, (first[kind] - 1).cast("int"))["value"])
    start = F.struct(named("size").alias("size"), named("color").alias("color"), F.array().cast("array<struct<name:string,value:string>>").alias("extras"))
    rest = F.filter(kinds, lambda p, i: ((i + 1) != first["size"]) & ((i + 1) != first["color"]))

    def place(state: Column, p: Column) -> Column:
        return let(looks_like_size(F.array(p["value"])), lambda is_size: _step(state, p, is_size))

    return F.aggregate(rest, start, place)


def _step(state: Column, p: Column, is_size: Column) -> Column:
    to_size, to_color = state["size"].isNull() & is_size, state["color"].isNull() & ~is_size
    extra = F.struct(F.coalesce(F.nullif(clean(p["name"]), F.lit("")), F.lit("opcion")).alias("name"), clean(p["value"]).alias("value"))
    return F.struct(
        F.when(to_size, p["value"]).otherwise(state["size"]).alias("size"),
        F.when(to_color, p["value"]).otherwise(state["color"]).alias("color"),
        F.when(to_size | to_color, state["extras"]).otherwise(F.concat(state["extras"], F.array(extra))).alias("extras"),
    )


def _as_map(extras: Column) -> Column:
    """Of extras with one name the last counts."""
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(extras, empty, lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["name"]), F.create_map(e["name"], e["value"])))
