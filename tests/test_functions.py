"""Golden cases of the scalar rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tejido.functions import color, marketplace, money, options, questions, shaping, similarity, size, taxonomy, text


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("out")).orderBy("i").collect()
    return [r["out"] for r in rows]


def test_money(spark):
    cases = {"$36.500,00": 3650000, "36.500": 3650000, "23725": 2372500, "$ 12.000": 1200000, "1.234.567,89": 123456789, None: None, "": None, "consultar": None, "1.5": 150, "-": None}
    assert column(spark, list(cases), money.parse_money) == list(cases.values())
    assert column(spark, [10000.0, 1.005, None], money.number_to_cents, "double") == [1000000, 100, None]


def test_size(spark):
    cases = {
        "38": ("38", "ar_numeric"), "Talle 40": ("40", "ar_numeric"), "6": ("6", "kids_numeric"), "l": ("L", "alpha"), "XG": ("XL", "alpha"), "Talle único": ("ONE SIZE", "one_size"), "40x40": ("40x40", "dimension"),
        "70X50": ("70x50", "dimension"), "25": ("25", "shoe_ar"), "2-4": ("2", "ar_numeric"), "003": ("003", "kids_numeric"), "S00": (None, "unknown"), "99": ("99", "unknown"),
    }
    assert [(r["normalized"], r["system"]) for r in column(spark, list(cases), size.normalize_size)] == list(cases.values())
    assert column(spark, [None, "  "], size.normalize_size) == [None, None]


def test_sets_of_sizes_and_colors(spark):
    sets = [["4", "6", "8"], ["40x40", "50x50"], ["Negro", "Azul"], ["Negro"], []]
    assert column(spark, sets, size.suspicious_color_set, "array<string>") == [True, True, False, False, False]
    assert column(spark, sets, size.looks_like_size, "array<string>") == [True, True, False, False, False]


def test_color(spark):
    cases = {"Off white": "white", "NEGRO": "black", "salmón": "pink", "palo de rosa": "pink", "animal print": "multi", "xyz": None, None: None}
    assert column(spark, list(cases), color.color_family) == list(cases.values())


def test_category_and_gender(spark):
    rows = [("ZAPATILLA KITTY BALLOON H.", ["Calzado", "Zapatillas"], "shoes"), ("MOCASIN SMART", ["BOTAS Y ZAPATOS"], "shoes"), ("Crocs Soho Y-Strap Sandal", ["Shoes"], "shoes"), ("Calza deportiva", ["Mujer"], "pants"), ("REME ANABELLA", [], "tops"), ("REME XIAMEN", [], "tops")]
    df = spark.createDataFrame(rows, "t string, b array<string>, want string")
    got = df.select(taxonomy.classify_category(F.col("t"), F.col("b")).alias("c"), "want", "t", taxonomy.classify_gender(F.col("t"), F.col("b")).alias("g")).collect()
    assert all(r["c"] == r["want"] for r in got)
    assert {r["t"]: r["g"] for r in got}["REME XIAMEN"] == "unknown"
    assert {r["t"]: r["g"] for r in got}["Calza deportiva"] == "women"


QUESTIONS = {
    "pollera de jean con bolsillos": ("skirts", "denim"), "campera de jean": ("outerwear", "denim"), "camisa de jean": ("tops", "denim"), "vestido de jean": ("dresses", "denim"), "un jean wide leg": ("jeans", "denim"), "jeans azules": ("jeans", "denim"),
}


def test_garment_beats_fabric(spark):
    df = spark.createDataFrame([(q,) for q in QUESTIONS], "text string")
    assert {r["text"]: (r["category"], r["tela"]) for r in questions.parse_questions(df).collect()} == QUESTIONS


def test_color_synonyms_and_prices(spark):
    colors = {"campera bordó": "red", "campera borgoña": "red", "pantalón oliva": "green", "saco camel": "beige", "remera terracota": "brown"}
    df = spark.createDataFrame([(q,) for q in colors], "text string")
    assert {r["text"]: r["color"] for r in questions.parse_questions(df).collect()} == colors
    prices = {"no más de 20000": (2000000, None), "hasta, 20000": (None, None), "entre 10 y 20 lucas": (2000, 1000), "desde 5 mil hasta $8.000": (800000, 500000)}
    df = spark.createDataFrame([(q,) for q in prices], "text string")
    assert {r["text"]: (r["max_cents"], r["min_cents"]) for r in questions.parse_questions(df).collect()} == prices
    literal = questions.parse_questions(df, fix_no_more=False).where("text = 'no más de 20000'").first()
    assert (literal["max_cents"], literal["min_cents"]) == (2000000, 2000000)


def test_thread(spark):
    rows = [(1, 0, "vestido negro hasta 30000 para mujer"), (1, 1, "¿y en rojo?"), (1, 2, "algo más barato"), (2, 0, "hola")]
    df = spark.createDataFrame(rows, "c int, t int, text string")
    got = {(r["c"], r["t"]): r for r in questions.thread_filters(df, "c", "t").collect()}
    assert (got[1, 1]["category"], got[1, 1]["color"], got[1, 1]["max_cents"], got[1, 1]["genero"]) == ("dresses", "red", 3000000, None)
    assert got[1, 2]["color"] == "red" and got[1, 2]["applied"] == ["del hilo: dresses, red"]
    assert got[2, 0]["applied"] == []


def test_query_text(spark):
    df = spark.createDataFrame([("sí", ["a" * 40, "b", "c", "d"]), ("hola", None), (None, ["x", " "]), ("", [])], "m string, t array<string>")
    got = [r[0] for r in df.select(questions.query_text(F.col("m"), F.col("t"))).collect()]
    assert got == ["b | c | d | sí | sí", "hola", "x", ""]


def test_text(spark):
    assert column(spark, ["DRESS JAMIE 💌", "  Ñandú  ", None], text.normalize_title) == ["dress jamie", "nandu", ""]
    assert column(spark, ["¡Hola, Mundo!", "a--b"], text.slugify) == ["hola-mundo", "a-b"]
    assert column(spark, ["<p>a</p><script>x</script><!-- c --> b&amp;c"], text.visible_text) == ["a\nb&c"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=10))
def test_fold_is_idempotent(spark, values):
    once = column(spark, values, text.fold)
    assert column(spark, once, text.fold) == once


def test_options(spark):
    pairs = "array<struct<name:string,value:string>>"
    got = column(spark, [[("Color", "Rosa"), ("Talle", "35")], [("a", "38"), ("b", "Negro"), ("c", "z")], []], options.split_options, pairs)
    assert [(o["size"] and o["size"]["normalized"], o["color"] and o["color"]["normalized"], o["extras"]) for o in got] == [("35", "pink", {}), ("38", "black", {"c": "z"}), (None, None, {})]


def test_marketplace(spark):
    page = "Precio por menor: $ 1.200\nCompra mínima: 4 (CURVA)\n2.359\nSeguidores"
    assert column(spark, [page], marketplace.retail_cents) == [120000]
    (least,) = column(spark, [page], lambda c: marketplace.least_purchase(marketplace.labelled(c, marketplace.MINIMUM)))
    assert (least["qty"], least["unit"]) == (4, "curva")


def test_similarity_and_discount(spark):
    row = spark.range(1).select(similarity.trigram_similarity(F.lit("word"), F.lit("two words")).alias("s"), money.discount_pct(F.lit(2372500), F.lit(3650000)).alias("d"), money.discount_pct(F.lit(5), F.lit(0)).alias("none")).first()
    assert row["s"] == pytest.approx(4 / 11) and row["d"] == 35.0 and row["none"] is None


def test_embedding_text_uses_own_description_first(spark):
    make = lambda d: shaping.embedding_text(F.lit("T"), F.lit(None), F.lit("B"), F.lit(""), F.array().cast("array<string>"), F.array(F.lit("S")), d, F.lit("generated"))
    assert column(spark, ["a description of its own", "short", None], make) == ["T | B | talles S | a description of its own", "T | B | talles S | generated", "T | B | talles S | generated"]
