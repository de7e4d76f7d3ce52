"""Brand resolution, mall directories, coverage, descriptions, paged sources, sinks and the onboarding job."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tejido.operators import onboarding as O
from tejido.operators.quality import Refused, baseline
from tejido.sources import paged, sinks


def test_brands(spark):
    rows = [("a", 0, "a.com", "unknown"), ("a", 1, "a.ar", "vtex"), ("b", 0, "b.com", "unknown"), ("b", 1, "b.ar", None), ("c", 0, "c.com", None)]
    got = {r["brand"]: (r["domain"], r["platform"], r["state"]) for r in O.resolve_brands(spark.createDataFrame(rows, "brand string, position int, domain string, platform string")).collect()}
    assert got == {"a": ("a.ar", "vtex", "ok"), "b": ("b.com", "unknown", "plataforma no cubierta"), "c": ("", "", "no resuelve")}


def test_mall(spark):
    shops = spark.createDataFrame([("m", "x", "<b>X</b>", [2, 1, 2]), ("m", "y", "Y", [9]), ("m", "z", "Z", [])], "mall string, slug string, name string, term_ids array<int>")
    terms = spark.createDataFrame([("m", 1, "Mujer"), ("m", 2, "Calzado")], "mall string, id int, name string")
    got = {r["slug"]: (r["name"], r["trade"], r["fashion"]) for r in O.mall_directory(shops, terms).collect()}
    assert got == {"x": ("X", "Calzado / Mujer", True), "y": ("Y", "9", False), "z": ("Z", "", False)}


def test_descriptions(spark):
    raw = ["Chaleco  tipo knitwear beige, de punto grueso y con botones", "Esta imagen muestra una remera lisa de algodón", "corta", "NO_ES_PRENDA porque es otra cosa distinta", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").orderBy("i").select(O.cleaned_description(F.col("x"))).collect()]
    assert got == ["Chaleco beige, de punto grueso y con botones", None, None, None, None]
    row = spark.range(1).select(O.anchor(F.lit("X"), F.lit("dresses")).alias("a"), O.anchor(F.lit("X"), F.lit(None)).alias("b")).first()
    assert tuple(row) == ("X (es un/a vestido)", "X")


def test_plans():
    assert len(paged.plan("shopify")) == 20 and paged.plan("magento", 120)[0].starts == [1, 2, 3]
    blocks = paged.plan("vtex", 2630, {"a": 2600, "b": 30}, beyond="leave")
    assert {b.scope for b in blocks} == {"", "a", "b"} and max(s for b in blocks for s in b.starts) < 2500
    with pytest.raises(ValueError, match="2600"):
        paged.plan("vtex", 2630, {"a": 2600, "b": 30})


@pytest.mark.parametrize("kind, options, n", [("shopify", {}, 600), ("magento", {"total": "120"}, 120), ("vtex", {"total": "70"}, 70), ("vtex", {"total": "2630", "scopes": "a=2600,b=30", "beyond": "leave", "fetcher": "tests.paged_double:fetch_large"}, 5030)])
def test_paged_source(spark, kind, options, n):
    spark.dataSource.register(paged.PagedSource)
    got = spark.read.format("shop_pages").options(**{"kind": kind, "fetcher": "tests.paged_double:fetch"} | options).load()
    assert got.count() == n and got.select("scope", "position").distinct().count() == n
    assert json.loads(got.first()["line"])


def test_sinks(spark, tmp_path):
    sinks.jsonl(spark.range(3).withColumn("raw", F.lit("x")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).columns == ["id"]
    sinks.csv(spark.range(3), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    start = sinks.run_started(spark.range(0), "r", "s", F.lit(datetime.datetime(2026, 1, 1)))
    assert sinks.run_finished(start, "r", 5, 1, F.lit(datetime.datetime(2026, 1, 2))).first()["ok"] == 5


def test_onboarding_job(spark):
    from tests.test_operators import batch

    price = F.struct(F.lit(100).cast("long").alias("amount_cents"), F.lit(None).cast("long").alias("compare_at_cents"))
    variants = F.array(F.struct(F.lit("0").alias("external_id"), F.struct(F.lit("Negro").alias("raw")).alias("color"), price.alias("price"), F.lit("in_stock").alias("availability"), F.lit(None).cast("int").alias("stock")))
    new = batch(spark, 40, variants=variants, content_hash=F.lit("h"))
    old = new.limit(0).select("product_uid", "title", "content_hash").withColumns({c: F.lit(None).cast("timestamp") for c in ("first_seen_at", "description_ia_at", "embedding_ia_at")}).withColumns({"description_ia": F.lit(None).cast("string"), "embedding": F.lit(None).cast("string")})
    points = spark.createDataFrame([], "product_uid string, variant_external_id string, observed_at timestamp")
    now = F.lit(datetime.datetime(2026, 1, 1))
    out = O.onboard(new, old, points, now)
    assert (out["products"].count(), out["points"].count(), out["changed"].count()) == (40, 40, 40)
    with pytest.raises(Refused):
        O.onboard(new.limit(0), old, points, now)
    assert json.loads(sinks.one_row_json(baseline(new)))["n_products"] == 40


def test_coverage(spark):
    from tests.test_operators import batch

    b = batch(spark).withColumn("store_slug", F.lit("s")).withColumn("variants", F.array(F.struct(F.lit(None).cast("string").alias("size"), F.lit("x").alias("color"))))
    row = O.coverage_by_store(b).first()
    assert (row["products"], row["with_size"], row["with_color"]) == (40, 0, 40)
    assert O.sampled_coverage(b, 10, {"title": F.col("title") != ""}).first()["n"] == 10
    probes = spark.createDataFrame([("Product", 1.0, True), ("Product", None, False), ("WebSite", None, True)], "types string, price double, sitemap boolean")
    assert tuple(O.capabilities(probes).first()) == (3, 2, 1, 2)
