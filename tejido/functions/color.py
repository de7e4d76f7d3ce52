"""Shop colors to families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, fold, let, word

#: Words of each family, and the family's shade.
FAMILIES = {
    "black": ("negro", "black", "azabache"),
    "white": ("blanco", "white", "off white", "offwhite", "crudo", "marfil", "hueso", "ivory", "crema", "champagne", "champan"),
    "grey": ("gris", "grey", "gray", "plomo", "melange", "plata", "silver", "plateado"),
    "beige": ("beige", "arena", "nude", "camel", "tostado", "taupe", "tiza", "khaki", "kaki"),
    "brown": ("marron", "brown", "chocolate", "cafe", "tabaco", "cuero", "topo", "choco"),
    "red": ("rojo", "red", "bordo", "burdeos", "vino", "granate", "teja", "borravino", "cherry", "cereza"),
    "pink": ("rosa", "rosado", "pink", "fucsia", "fuchsia", "coral", "salmon", "palo de rosa"),
    "orange": ("naranja", "orange", "mandarina", "ladrillo", "oxido"),
    "yellow": ("amarillo", "yellow", "mostaza", "butter", "manteca", "dorado", "gold", "oro"),
    "green": ("verde", "green", "oliva", "militar", "menta", "lima", "esmeralda", "petroleo"),
    "blue": ("azul", "blue", "celeste", "navy", "marino", "denim", "jean", "aqua", "turquesa"),
    "purple": ("violeta", "lila", "purple", "morado", "malva", "uva"),
    "multi": ("multicolor", "estampado", "print", "animal print", "rayado", "floral", "tie dye"),
}
SHADES = {
    "black": "#000000", "white": "#FFFFFF", "grey": "#8A8A8A", "beige": "#D8C3A5", "brown": "#6F4E37", "red": "#C0392B", "pink": "#E8A0BF",
    "orange": "#E67E22", "yellow": "#F1C40F", "green": "#27AE60", "blue": "#2C6FBB", "purple": "#8E44AD",
}


def color_family(raw: Column) -> Column:
    """The family of the longest known word; words of one length in the order of the table."""
    key = F.trim(F.regexp_replace(F.lower(fold(clean(raw))), r"[^a-z0-9\s]+", " "))
    return let(key, _family)


def _family(key: Column) -> Column:
    by_length: dict[int, list[tuple[str, list[str]]]] = {}
    for family, tokens in FAMILIES.items():
        for t in tokens:
            groups = by_length.setdefault(len(t), [])
            if groups and groups[-1][0] == family:
                groups[-1][1].append(t)
            else:
                groups.append((family, [t]))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for size in sorted(by_length, reverse=True):
        for family, tokens in by_length[size]:
            out = out.when(key.rlike(word(tokens)), F.lit(family))
    return out


def normalize_color(raw: Column) -> Column:
    """struct(raw, normalized, hex); null for null or blank."""
    shades = F.create_map(*(F.lit(x) for kv in SHADES.items() for x in kv))
    named = lambda original: let(color_family(original), lambda f: F.struct(original.alias("raw"), f.alias("normalized"), shades[f].alias("hex")))
    return let(clean(raw), lambda original: F.when(original != "", named(original)))
