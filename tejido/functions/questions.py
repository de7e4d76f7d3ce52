"""Questions to filters, for a whole column of questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vocabulary as V
from .money import spoken_cents
from .text import word

INHERITED = ("category", "color", "size", "max_cents", "min_cents", "tela", "detalle")
NOTED = ("category", "color", "size", "tela", "detalle")
FIELDS = ("canal", "genero", "tela", "detalle", "max_cents", "min_cents", "category", "color", "size")


def _first(choices: dict[str, Column]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, hit in choices.items():
        out = out.when(hit, F.lit(name))
    return out


def _first_of(low: Column, words: dict[str, tuple], **how: bool) -> Column:
    """The first choice that a text has a word of. One pattern of all words comes first: most texts have none, and need no other."""
    choices = {name: low.rlike(word(ws, **how)) for name, ws in words.items()}
    return F.when(low.rlike(word([w for ws in words.values() for w in ws], **how)), _first(choices))


def own_filters(question: Column, fix_no_more: bool = True) -> dict[str, Column]:
    """The filters that one question names.

    fix_no_more: "no mas de" only sets the upper price; without it, it sets the lower one as well.
    """
    low = F.lower(F.coalesce(question, F.lit("")))
    group = lambda pattern, i: F.nullif(F.regexp_extract(low, pattern, i), F.lit(""))
    both = low.rlike(V.BETWEEN)
    lower = V.FROM.replace("(?:más de", "(?:(?<!no )más de") if fix_no_more else V.FROM
    garments = {c: w for c, ws in V.CATEGORY_WORDS.items() if (w := tuple(x for x in ws if x not in V.FABRIC_AND_CATEGORY))}
    size = group(V.SIZE, 1)
    begins = lambda axis: _first_of(low, V.AXES[axis], open_end=True)
    return {
        "canal": F.when(F.greatest(*(F.contains(low, F.lit(w)) for w in V.WHOLESALE_WORDS)), "mayorista"),
        "genero": _first({g: low.rlike(p) for g, p in V.GENDER_PATTERNS.items()}),
        "tela": begins("tela"),
        "detalle": begins("detalle"),
        "max_cents": F.when(both, spoken_cents(group(V.BETWEEN, 2), F.lit(None).cast("string"))).otherwise(spoken_cents(group(V.UPTO, 1), group(V.UPTO, 2))),
        "min_cents": F.when(both, spoken_cents(group(V.BETWEEN, 1), F.lit(None).cast("string"))).otherwise(spoken_cents(group(lower, 1), group(lower, 2))),
        "category": F.coalesce(_first_of(low, garments, plural=True), _first_of(low, V.CATEGORY_WORDS, plural=True)),
        "color": _first_of(low, V.COLOR_WORDS, plural=True),
        "size": F.upper(size),
    }


def notes(own: dict[str, Column], inherited: Column | None = None) -> Column:
    """What was applied, in words, in the order of reading."""
    money = lambda c: F.format_number(c / 100, 0)
    genders = F.create_map(*(F.lit(x) for kv in {"men": "hombre", "women": "mujer", "kids": "niños"}.items() for x in kv))
    both = own["between"]
    parts = [
        *([F.when(F.size(inherited) > 0, F.concat(F.lit("del hilo: "), F.array_join(inherited, ", ")))] if inherited is not None else []),
        F.when(both, F.concat(F.lit("precio entre $"), money(own["min_cents"]), F.lit(" y $"), money(own["max_cents"]))),
        F.when(~both, F.concat(F.lit("precio hasta $"), money(own["max_cents"]))),
        F.when(~both, F.concat(F.lit("precio desde $"), money(own["min_cents"]))),
        F.concat(F.lit("talle "), own["size"]),
        F.concat(F.lit("categoría "), own["category"]),
        F.concat(F.lit("color "), own["color"]),
        F.concat(F.lit("tela "), own["tela"]),
        own["detalle"],
        genders[own["genero"]],
        F.when(own["canal"].isNotNull(), F.lit("solo mayoristas")),
    ]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def parse_questions(df: DataFrame, question: str = "text", fix_no_more: bool = True) -> DataFrame:
    """df with one column for each of FIELDS, and `applied`."""
    own = own_filters(F.col(question), fix_no_more)
    between = F.lower(F.coalesce(F.col(question), F.lit(""))).rlike(V.BETWEEN)
    named = df.withColumns(own)
    return named.withColumn("applied", notes({f: F.col(f) for f in FIELDS} | {"between": between}))


def thread_filters(df: DataFrame, thread: str, position: str, question: str = "text", fix_no_more: bool = True) -> DataFrame:
    """Per question the filters in force: its own, else the latest that an earlier question of the thread named.

    Gender, channel and store are never inherited. One window over the thread; the frame only looks back.
    """
    own = parse_questions(df, question, fix_no_more).drop("applied")
    back = Window.partitionBy(thread).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    earlier = {f"_{f}": F.last(f, ignorenulls=True).over(back) for f in INHERITED}
    out = own.withColumns(earlier)
    between = F.lower(F.coalesce(F.col(question), F.lit(""))).rlike(V.BETWEEN)
    inherited = F.filter(F.array(*(F.col(f"_{f}") for f in NOTED)), lambda x: x.isNotNull())
    out = out.withColumn("applied", notes({f: F.col(f) for f in FIELDS} | {"between": between}, inherited))
    return out.withColumns({f: F.coalesce(F.col(f), F.col(f"_{f}")) for f in INHERITED}).drop(*earlier)


def query_text(message: Column, thread: Column, turns: int = 3, most: int = 3) -> Column:
    """What is embedded: the last turns, then the message two or three times, until it is as long as the longest turn."""
    now = F.trim(F.coalesce(message, F.lit("")))
    kept = F.slice(thread, F.greatest(F.size(thread) - (turns - 1), F.lit(1)), F.lit(turns))
    before = F.filter(F.transform(kept, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))
    longest = F.aggregate(before, F.lit(0), lambda m, p: F.greatest(m, F.length(p)))
    times = F.greatest(F.lit(2), F.least(F.lit(most), F.ceil(longest / F.length(now)).cast("int")))
    alone = F.coalesce(F.size(before), F.lit(0)) <= 0
    return (
        F.when((now == "") & alone, F.lit(""))
        .when(now == "", F.array_join(before, " | "))
        .when(alone, now)
        .otherwise(F.array_join(F.concat(before, F.array_repeat(now, times)), " | "))
    )
