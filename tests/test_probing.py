"""Platforms by asking, hosts of catalogues, and what else a shop's care needs."""

import datetime

import pytest
from pyspark.sql import functions as F

from tejido.operators import requests as R
from tejido.operators import storage
from tejido.operators.snapshot import Occupied, Tables
from tejido.sources import probing


def test_platforms_by_markup_and_by_asking(spark):
    rows = [("shop.com", ""), ("v.com", None), ("m.com", "<p>"), ("t.com", "x"), ("bad.com", ""), ("down.com", ""), ("none.com", ""), ("seen.com", "woocommerce " * 3), ("shop.com", "again"), (None, "")]
    got = probing.detected(spark.createDataFrame(rows, "domain string, html string"), "tests.probe_double:fetch").collect()
    assert len(got) == len(rows)
    assert {r["domain"]: (r["platform"], r["evidence"]) for r in got} == {
        "shop.com": ("shopify", "answer"), "v.com": ("vtex", "answer"), "m.com": ("magento", "answer"), "t.com": ("tiendanube", "answer"), "bad.com": ("unknown", None), "down.com": ("unknown", None),
        "none.com": ("unknown", None), "seen.com": ("woocommerce", "markup"), None: ("unknown", None),
    }


def test_the_host_that_has_the_catalogue(spark):
    df = spark.createDataFrame([("v.com",), ("hidden.com",), ("none.com",), ("down.com",)], "domain string")
    assert {r["domain"]: r["host"] for r in probing.hosts(df, "tests.probe_double:fetch").collect()} == {"v.com": "v.com", "hidden.com": "acme2.vtexcommercestable.com.br", "none.com": "none.com", "down.com": "down.com"}


def test_descriptions_are_saved_with_their_time(spark):
    old, now = datetime.datetime(2025, 1, 1), datetime.datetime(2026, 1, 1)
    products = spark.createDataFrame([("a", None, None), ("b", "x", old), ("c", "y", old)], "product_uid string, description_ia string, description_ia_at timestamp")
    pairs = spark.createDataFrame([("a", "new"), ("b", None), ("c", "q"), ("c", "p"), ("d", "nobody")], "product_uid string, description_ia string")
    got = {r["product_uid"]: (r["description_ia"], r["description_ia_at"]) for r in storage.set_descriptions(products, pairs, F.lit(now)).collect()}
    assert got == {"a": ("new", now), "b": ("x", old), "c": ("p", now)}


def test_a_reset_has_to_be_confirmed(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    t.restore({"a": spark.range(3)}, {"a": "id"})
    with pytest.raises(Occupied):
        t.reset()
    assert t.reset(confirmed=True) == 2 and t.manifest() == {"tables": {}} and t.last_number("a") == 0
    assert len(t.vacuum()) == 1 and t.restore({"a": spark.range(1)}) == 3


def test_a_reply_says_why_it_went_by_words():
    def broken(texts):
        raise TimeoutError

    assert R.vector_or_reason("x", broken) == (None, "no vector (TimeoutError), searching by words")
    assert R.vector_or_reason("x", None) == (None, None) and R.vector_or_reason("x", lambda texts: [(0, [1, 2])]) == ([1.0, 2.0], None)
