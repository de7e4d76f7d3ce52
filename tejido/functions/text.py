"""Text cleaning as column expressions; each takes and returns a Column and stays inside generated code."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signs that count as decoration in titles.
DECORATION = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F000}-\\x{1F0FF}\\x{FE0F}\\x{2764}]+"
SPACES = r"(?U)\s+"


@lru_cache(maxsize=1)
def _accented() -> tuple[str, str]:
    """Letters that decompose into one base letter and marks, and those base letters."""
    plain = {}
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            plain[chr(code)] = base
    return "".join(plain), "".join(plain.values())


def fold(c: Column) -> Column:
    """Without accents, whether letters come composed or with combining marks."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(c, *_accented()), r"\p{Mn}+", "")).otherwise(c)


def fold_literal(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def clean(c: Column) -> Column:
    """Decoration and no-break spaces to spaces, runs of white space to one, trimmed; null to empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), DECORATION, " ")
    return F.trim(F.regexp_replace(F.translate(c, " ", " "), SPACES, " "))


def _plain(c: Column) -> Column:
    """Folded and in lower case; what is no letter or digit of a-z and 0-9 afterwards is the caller's to replace, decoration too."""
    return F.lower(fold(F.replace(F.coalesce(c, F.lit("")), F.lit("\ufe0f"), F.lit(" "))))


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(_plain(c), "[^a-z0-9]+", "-"), F.lit("-"))


def normalize_title(c: Column) -> Column:
    """A title that can be compared between stores: folded, lower case, words of a-z and 0-9."""
    return F.trim(F.regexp_replace(_plain(c), "[^a-z0-9]+", " "))


def strip_tags(c: Column) -> Column:
    return clean(F.regexp_replace(c, "<[^>]+>", " "))


def visible_text(html: Column) -> Column:
    """Text of a page without scripts and styles, one line for each piece of text, blank lines left out."""
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", "")
    lines = F.split(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), "(?s)<[^>]*>", "\n"), r"\R")
    pieces = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(unescape(x), SPACES, " "))), lambda x: x != "")
    return F.array_join(pieces, "\n")


def unescape(c: Column) -> Column:
    """The five entities that markup itself needs, and the no-break space."""
    for name, sign in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: long chains over it would otherwise outgrow a generated method."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word(tokens, plural: bool = False, open_end: bool = False) -> str:
    """A pattern that matches any of the tokens as whole words (or, with an open end, from a word's start)."""
    import re

    alternatives = "|".join(re.escape(t).replace(r"\ ", " ") for t in tokens)
    return rf"(?iuU)\b(?:{alternatives}){'s?' if plural else ''}" + ("" if open_end else r"\b")
