"""Search, relaxation, quality gate, storage and streams on small frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from tejido.operators import analytics as A
from tejido.operators import quality as Q
from tejido.operators import search as S
from tejido.operators import storage as K
from tejido.plans.frames import products, stores
from tejido.sources import landed, pages, platforms
from tejido.streaming import price_stream as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shop(spark):
    return products(spark, SF).cache(), stores(spark, SF)


@pytest.mark.parametrize("f", [
    S.Filters(category="dresses", color="grey", size="700", detalle="tajo", fresh_hours=None), S.Filters(category="tops", fresh_hours=None), S.Filters(store="none", min_cents=10**9, fresh_hours=None), S.Filters(max_cents=1, tela="lino", fresh_hours=None),
])
def test_one_pass_relaxation_is_the_loop(shop, f):
    rows, gone = S.relaxed_by_loop(*shop, f, text="remera")
    one = S.search_relaxed(*shop, f, text="remera").collect()
    assert [r["product_uid"] for r in one] == [r["product_uid"] for r in rows.collect()]
    if one:
        assert one[0]["relaxed"] == gone


def test_limits(shop):
    with pytest.raises(ValueError):
        S.search(*shop, S.Filters(), limit=49)


def test_vector_search_leaves_rows_without_vectors_out(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 1.0])], "product_uid string, embedding array<double>").withColumns({"title_normalized": F.col("product_uid"), "brand": F.lit(None).cast("string")})
    assert [r["product_uid"] for r in S.page(S.ranked(rows, [0.1, 1.0]), 5).collect()] == ["c", "a"]


def batch(spark, n=40, **change):
    base = spark.range(n).select(F.concat(F.lit("s:"), "id").alias("product_uid"), F.concat(F.lit("Remera "), "id").alias("title"), F.concat(F.lit("remera "), "id").alias("title_normalized"), F.lit("https://x").alias("url"), F.lit("tops").alias("category"), F.lit("una remera").alias("description"), (123400 + F.col("id") * 10).alias("price_min_cents"), F.lit(None).cast("long").alias("compare_at_cents"), F.array(F.struct(F.lit("u").alias("url"))).alias("images"), F.array(F.struct(F.struct(F.lit("Negro").alias("raw")).alias("color"))).alias("variants"))
    return base.withColumns(change)


def checks(found):
    return {(r["check"], r["severity"]) for r in found.collect()}


def test_quality_gate(spark):
    assert checks(Q.validate(batch(spark))) == set()
    numeric = batch(spark, variants=F.array(*(F.struct(F.struct(F.lit(x).alias("raw")).alias("color")) for x in ("4", "6"))))
    assert ("semantica:color-numerico", "block") in checks(Q.validate(numeric))
    assert ("contenido:no-decodificado", "block") in checks(Q.validate(batch(spark, title=F.concat(F.lit("x\x01"), "title"))))
    before = {"n_products": 40, "median_price_cents": 1236, "coverage": {}}
    assert ("deriva:precio", "block") in checks(Q.validate(batch(spark), before))
    assert ("completitud", "block") in checks(Q.validate(batch(spark), expected=1000))
    assert ("vacio", "block") in checks(Q.validate(batch(spark, 0)))
    assert ("identidad:duplicados", "block") in checks(Q.validate(batch(spark).unionByName(batch(spark, 1))))
    with pytest.raises(Q.Refused):
        Q.gate(Q.validate(batch(spark, 0)))
    Q.gate(Q.validate(batch(spark, 0)), force=True)


def test_upsert_keeps_what_an_update_must_not_touch(spark):
    now = F.lit(datetime.datetime(2026, 1, 1))
    columns = "product_uid string, title string, first_seen_at timestamp, description_ia string, description_ia_at timestamp, embedding string, embedding_ia_at timestamp"
    old = spark.createDataFrame([("a", "old", datetime.datetime(2025, 1, 1), "d", None, "v", None), ("b", "stays", None, None, None, None, None)], columns)
    new = spark.createDataFrame([("a", "new"), ("c", "added")], "product_uid string, title string")
    got = {r["product_uid"]: r for r in K.upsert_products(old, new, now).collect()}
    assert (got["a"]["title"], got["a"]["description_ia"], got["a"]["embedding"], got["a"]["first_seen_at"].year) == ("new", "d", "v", 2025)
    assert got["b"]["title"] == "stays" and got["c"]["first_seen_at"].year == 2026


def test_restore_refuses_to_overwrite(spark, tmp_path):
    K.restore(spark.range(2), str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exist"):
        K.restore(spark.range(2), str(tmp_path / "t"))


def test_append_points_by_month(spark, tmp_path):
    rows = spark.sql("SELECT 'p' AS product_uid, 'v' AS variant_external_id, ts AS observed_at FROM VALUES (TIMESTAMP '2026-08-02'), (TIMESTAMP '2026-09-01') t(ts)")
    K.append_points(rows, str(tmp_path / "pp"))
    assert spark.read.parquet(str(tmp_path / "pp")).where("month = DATE '2026-08-01'").count() == 1


def test_two_key_dedup_is_sequential(spark):
    rows = spark.createDataFrame([("s", 1, "m1", "i1"), ("s", 2, "m1", "i2"), ("s", 3, "m2", "i2"), ("s", 4, "m3", "i1"), ("s", 5, "", "i9")], "store string, at int, model string, id string")
    assert sorted(r["at"] for r in A.keep_first_of_two_keys(rows, "store", "at", "model", "id").collect()) == [1, 3]


def test_landed_files(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert landed.jsonl(spark, str(tmp_path / "p.jsonl"), "id int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id"\n')
    from pyspark.sql.types import IntegerType, StructField, StructType

    good, broken = landed.jsonl_tolerant(spark, str(tmp_path / "bad.jsonl"), StructType([StructField("id", IntegerType())]))
    assert (good.count(), broken.count()) == (1, 1)
    (tmp_path / "brands.txt").write_text("# list\nUno=uno.com\nDos # note\n")
    assert {(r["brand"], r["domain"]) for r in landed.brand_list(spark, str(tmp_path / "brands.txt")).collect()} == {("Uno", "uno.com"), ("Dos", None)}
    (tmp_path / "d.sql").write_text("x\nCOPY public.product (a) FROM stdin;\n1\n2\n\\.\nCOPY public.store (a) FROM stdin;\n\\.\n")
    assert {(r["table"], r["n"]) for r in landed.dump_rows(spark, str(tmp_path / "d.sql")).collect()} == {("public.product", 2), ("public.store", 0)}


def fields(spark, kind, *rows):
    return {r["url"]: r["p"] for r in pages.fields(spark.createDataFrame(rows, "url string, html string"), kind).collect()}


def test_generic_pages_prefer_structured_data(spark):
    ld = '<script type="application/ld+json">{"@graph":[{"@type":["Thing","Product"],"name":"A","image":["/a.jpg",{"url":"b.jpg"}],"brand":[{"name":"M"}],"sku":"S 1","offers":{"@type":"AggregateOffer","lowPrice":10}},{"@type":"BreadcrumbList","itemListElement":[{"name":"Home"},{"item":{"name":"Ropa"}},{"name":"A"}]}]}</script>'
    micro = '<div itemscope itemtype="https://schema.org/Product"><h1 itemprop="name">B <b>c</b></h1><meta itemprop="price" content="5"></div><i itemprop="brand">outside</i>'
    og = '<meta property="og:type" content="product.item"><meta property="og:title" content="C"><meta property="product:price:amount" content="7">'
    several = '<script type="application/ld+json">[{"@type":"Product","name":"first","offers":[{"price":"1","name":"x"},{"price":2.5}]},{"@type":"Product","name":"last","offers":{"offers":[{"price":3}]}}]</script><script type="application/ld+json">{broken</script>'
    got = fields(spark, "generic", ("https://x/p/a?q=1", ld), ("https://x/p/b", micro), ("https://x/p/c", og), ("https://x/p/d", "<p>nothing</p>"), ("https://x/p/e", several), (None, ld), ("https://x/p/f", None))
    a = got["https://x/p/a?q=1"]
    assert (a["name"], a["brand"], a["id"], a["breadcrumb"], a["images"], a["offers"][0]["price"]) == ("A", "M", "s-1", ["Ropa"], ["https://x/a.jpg", "https://x/p/b.jpg"], "10,000000")
    b = got["https://x/p/b"]
    assert (b["name"], b["brand"], b["id"], b["offers"][0]["price"]) == ("B c", "", "p-b", "5")
    assert (got["https://x/p/c"]["name"], got["https://x/p/c"]["offers"][0]["price"]) == ("C", "7")
    assert (got["https://x/p/e"]["name"], [o["price"] for o in got["https://x/p/e"]["offers"]]) == ("last", ["3,000000"])
    assert len(got) == 4


def test_shop_pages_give_labels_gallery_and_variants(spark):
    image = "//acdn-us.mitiendanube.com/stores/001/2/products/{}-{}-0.webp"
    html = f"""<script type="application/ld+json">{{"@type":"WebPage","breadcrumb":{{"itemListElement":[{{"name":"Inicio"}},{{"name":" Ropa  x "}}]}},"mainEntity":{{"@id":"https://s.com/productos/vestido/","name":"Vestido","description":"corta"}}}}</script>
    <div data-variants='[{{"product_id":7,"id":9,"price_number":10.5,"price_number_raw":1050,"available":true,"option0":"Negro"}}]'></div>
    <img src="{image.format("other", 999)}"><div class="js-product-detail-img-col x"><img srcset="{image.format("uno", 240)} 1x, {image.format("uno", 640)} 2x"><a href="{image.format("dos", 50)}"></a></div>
    <form><label for="variation_1">Color <b>del</b> g&eacute;nero</label></form><div class="js-product-description user"><div>larga</div> y <p>completa</p></div>"""
    got = fields(spark, "tiendanube", ("https://s.com/productos/vestido", html), ("https://s.com/productos/otro", html))
    (p,) = got.values()
    assert (p["external_id"], p["title"], p["description"], p["breadcrumb"], p["variants"][0]["option0"], p["variants"][0]["price_number_raw"]) == ("7", "Vestido", "larga y completa", ["Inicio", "Ropa x"], "Negro", 1050)
    assert [(i["url"].rsplit("/", 1)[1], i["width"]) for i in p["images"]] == [("uno-640-0.webp", 640), ("dos-50-0.webp", 50)]
    assert list(p["labels"]) == ["0"] and p["labels"]["0"].startswith("color del")


def test_page_without_price_is_no_product(spark):
    html = '<script type="application/ld+json">{"@type":"Product","name":"Algo"}</script>'
    df = spark.createDataFrame([("https://x/p/a", html)], "url string, html string")
    assert platforms.generic_pages(df, "g", "G").count() == 0


def test_controller():
    s = {}
    for _ in range(80):
        s = T.control(s, 200, 0.1)
    assert (s["concurrency"], s["peak"]) == (6, 6)
    s = T.control(s, 429, 0.1)
    assert (s["concurrency"], s["cooldown"]) == (3, 5.0)
    for _ in range(40):
        s = T.control(s, 200, 1.0)
    assert s["concurrency"] == 3  # latency grew


def test_gated_stream(spark, tmp_path):
    b = batch(spark).withColumn("content_hash", F.lit("h"))
    b.write.parquet(str(tmp_path / "in"))
    got = []
    empty = b.limit(0)
    run = T.upsert_batches(T.landed(spark, str(tmp_path / "in"), b.schema), lambda: empty, lambda new, old, i: got.append(new.count()), str(tmp_path / "cp"))
    run.awaitTermination()
    assert sum(got) == 40


def test_requests_have_limits_overrides_and_a_thread(spark):
    from tejido.operators import requests as R

    shop = products(spark, SF), stores(spark, SF)
    for bad in (lambda: R.search_request(*shop, " "), lambda: R.search_request(*shop, "x" * 601), lambda: R.search_request(*shop, "x", offset=601), lambda: R.chat_request(*shop, "x", limit=21)):
        with pytest.raises(ValueError):
            bad()
    f = R.understood(spark, "y en negro?", ("vestido con tajo para hombre hasta 20 lucas",), canal="marcas")
    assert (f.category, f.color, f.detalle, f.max_cents, f.genero, f.canal) == ("dresses", "black", "tajo", 2000000, None, "marcas")
    assert R.understood(spark, "campera para hombre", genero="women").genero == "women"
    assert R.vector_of("a", lambda ts: [(0, [1, 2])]) == [1.0, 2.0] and R.vector_of("a", lambda ts: 1 / 0) is None
    r = R.chat_request(*shop, "y en gris con tajo?", ("vestidos talle 700",), limit=5)
    rows = r.rows.collect()
    assert r.mode == "words" and 0 < len(rows) <= 5 and len({x["level"] for x in rows}) == 1 and "detalle" not in {x["axis"] for x in r.facets.collect()}


def test_a_provider_must_answer_for_every_text(spark):
    from tejido.operators import requests as R

    rows = spark.createDataFrame([("a",), (None,), ("ccc",)], "t string").coalesce(1)
    assert [x["embedding"] for x in R.embedded(rows, "t", lambda ts: [(i, [len(t)]) for i, t in enumerate(ts)][::-1], 2).collect()] == [[1.0], [0.0], [3.0]]
    with pytest.raises(Exception, match="not answered"):
        R.embedded(rows, "t", lambda ts: [(0, [1.0])]).collect()
