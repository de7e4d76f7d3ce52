"""Plans, filters, limits and fallbacks of the paged source."""

import json
import math
import os

import pytest
from tejido.sources import paged
from tests import paged_double


@pytest.fixture
def noted():
    """What the doubles were asked for while the test ran."""
    open(paged_double.LOG, "w").close()
    yield lambda: [json.loads(x) for x in open(paged_double.LOG)]
    os.remove(paged_double.LOG)


def test_rows_beyond_the_cap_are_an_error_before_anything_is_fetched():
    for scopes in (None, {"a": 10}, {"a": 2600, "b": 30}, [{"path": "a", "n": 2700, "children": [{"path": "b", "n": 100}]}]):
        with pytest.raises(paged.Incomplete):
            paged.plan("vtex", 5600, scopes)
    blocks = paged.plan("vtex", 3000, beyond="leave")
    assert {b.scope for b in blocks} == {""} and sum(len(b.starts) for b in blocks) == 50
    assert {b.scope for b in paged.plan("vtex", 3000, {"a": 500})} == {"", "a"}


def test_the_tree_is_split_until_scopes_are_under_the_cap():
    blocks = paged.plan("vtex", 6000, paged_double.TREE)
    turns = {b.scope: b.turn for b in blocks}
    assert list(turns) == ["", "deep", "deep/x", "deep/x/1", "deep/x/2", "deep/y", "deep/y/1", "deep/y/2", "flat"]
    assert max(s for b in blocks for s in b.starts) < paged.VTEX_CAP
    # A category under the cap needn't be split.
    small = [{"path": "a", "n": 2000, "children": [{"path": "a/b", "n": 1000}]}, {"path": "c", "n": 1500}]
    assert {b.scope for b in paged.plan("vtex", 3000, small)} == {"", "a", "c"}
    assert [b.scope for b in paged.plan("vtex", 2400, small)] == [""] * 3


def test_overlapping_scopes_give_each_product_once_from_the_first(spark):
    rows = paged.pages(spark, kind="vtex", fetcher="tests.paged_double:shop", total=6000, scopes=paged_double.TREE)
    found = paged.whole(paged.first_by_id(rows), 6000)
    got = {int(r["id"]): (r["scope"], r["position"]) for r in found.collect()}
    want = {}
    for scope in ["", *(b for b in dict.fromkeys(b.scope for b in paged.plan("vtex", 6000, paged_double.TREE)) if b)]:
        for at, i in enumerate(paged_double.SHOP[scope][: paged.VTEX_CAP]):
            want.setdefault(i, (scope, at))
    assert got == want and len(got) == 6000
    with pytest.raises(paged.Incomplete, match="6000 products of 6001"):
        paged.whole(paged.first_by_id(rows), 6001)
    assert paged.whole(found, 6001, "leave").count() == 6000


@pytest.mark.parametrize(
    "kind, options, limit, pages",
    [("shopify", {}, 10, [1]), ("shopify", {}, 251, [1, 2]), ("magento", {"total": 120}, 60, [1, 2]), ("vtex", {"total": 70}, 50, [0]), ("magento", {"total": 120}, 5000, [1, 2, 3])],
)
def test_a_limit_asks_for_no_more_pages(spark, noted, kind, options, limit, pages):
    rows = paged.pages(spark, kind=kind, fetcher="tests.paged_double:fetch", limit=limit, **options)
    assert rows.count() == min(limit, 600 if kind == "shopify" else 120 if kind == "magento" else 70)
    assert sorted(x[1] for x in noted()) == pages


def test_a_limit_under_the_cap_needs_no_categories():
    assert {b.scope for b in paged.plan("vtex", 6000, paged_double.TREE, limit=100)} == {""}
    assert len({b.scope for b in paged.plan("vtex", 6000, paged_double.TREE, limit=2501)}) == 9


@pytest.mark.parametrize(
    "condition, asked, n",
    [
        ("scope = 'deep/x/2'", {("deep/x/2", i) for i in range(0, 1300, 50)}, 1300),
        ("scope in ('flat', 'deep/x/2') and position < 100", {(s, i) for s in ("flat", "deep/x/2") for i in (0, 50)}, 200),
        ("position >= 120 and position <= 149 and scope = 'flat' and length(line) > 0", {("flat", 100)}, 30),
        ("position = 2499", {(s, 2450) for s in ("", "deep", "deep/x", "deep/y")}, 4),
        ("position > 5 and scope = 'nowhere'", set(), 0),
    ],
)
def test_filters_keep_pages_from_being_asked_for(spark, noted, condition, asked, n):
    rows = paged.pages(spark, kind="vtex", fetcher="tests.paged_double:shop", total=6000, scopes=paged_double.TREE).where(condition)
    assert rows.count() == n
    assert {(x[2], x[1]) for x in noted()} == asked


def test_failed_pages_are_asked_for_again_in_small(spark, noted):
    source = lambda **o: paged.pages(spark, kind="magento", fetcher="tests.paged_double:heavy", total=400, **o)
    rows = source(fallback="tests.paged_double:small", errors="rows").collect()
    good = [json.loads(r["line"]) for r in rows if r["error"] is None]
    assert sorted(x["id"] for x in good) == [i for i in range(400) if not 250 <= i < 300]
    # The first page comes in full; from the page that failed on the small query goes on alone.
    assert {x["id"] for x in good if x["full"]} == set(range(50))
    assert [(r["position"], r["line"], r["error"]) for r in rows if r["error"]] == [(250, None, "TimeoutError: page 6")]
    assert [x[1] for x in noted() if x[0] == "heavy"] == [1, 2] and [x[1] for x in noted() if x[0] == "small"] == [2, 3, 4, 5, 6, 7, 8]
    alone = source(errors="rows").collect()
    assert [(r["position"] // 50 + 1, r["error"].split(":")[0]) for r in alone if r["error"]] == [(2, "TimeoutError"), (4, "Incomplete"), (6, "TimeoutError")]
    assert sum(r["error"] is None for r in alone) == 250
    with pytest.raises(Exception, match="page 2"):
        source().count()


def test_blocks_cover_each_page_once():
    for kind, total in (("magento", 5001), ("shopify", None), ("vtex", 2500)):
        starts = [s for b in paged.plan(kind, total, block=7) for s in b.starts]
        assert len(starts) == len(set(starts)) == {"magento": math.ceil(5001 / 50), "shopify": 400, "vtex": 50}[kind]
