"""Stands in for shop APIs in tests. What is asked for is noted in LOG, if that file is there."""

import json
import os

LOG = f"/tmp/paged_double_{os.getuid()}.log"
HAVE = {"shopify": 600, "magento": 120}
#: A shop of 6,000 products whose categories overlap and hold all of it; `deep` is over the cap and has children, one of them over the cap again.
SHOP = {"": range(6000), "deep": range(5200), "deep/x": range(2700), "deep/x/1": range(1500), "deep/x/2": range(1400, 2700), "deep/y": range(2600, 5200), "deep/y/1": range(2600, 4000), "deep/y/2": range(4000, 5200), "flat": range(5000, 6000)}
TREE = [
    {"path": "deep", "n": 5200, "children": [
        {"path": "deep/x", "n": 2700, "children": [{"path": "deep/x/1", "n": 1500}, {"path": "deep/x/2", "n": 1300}]},
        {"path": "deep/y", "n": 2600, "children": [{"path": "deep/y/1", "n": 1400}, {"path": "deep/y/2", "n": 1200}]}]},
    {"path": "flat", "n": 1000},
]


def _noted(*what):
    if os.path.exists(LOG):
        with open(LOG, "a") as f:
            f.write(json.dumps(what) + "\n")


def fetch(kind, start, scope):
    _noted("fetch", start, scope)
    if kind == "vtex":
        n = {"": 70, "a": 2600, "b": 30}[scope]
        return [json.dumps({"productId": f"{scope}{i}"}) for i in range(start, min(start + 50, n))]
    size = {"shopify": 250, "magento": 50}[kind]
    return [json.dumps({"id": i}) for i in range((start - 1) * size, min(start * size, HAVE[kind]))]


def fetch_large(kind, start, scope):
    """More in all than the cap."""
    n = {"": 2630, "a": 2600, "b": 30}[scope]
    return [json.dumps({"productId": f"{scope}{i}"}) for i in range(start, min(start + 50, n))]


def shop(kind, start, scope):
    _noted("shop", start, scope)
    assert start < 2500
    return [json.dumps({"productId": str(i), "seen": scope}) for i in SHOP[scope][start : start + 50]]


def heavy(kind, start, scope):
    """The full query: page 2 breaks, page 4 comes empty, page 6 breaks for both."""
    _noted("heavy", start, scope)
    if start in (2, 6):
        raise TimeoutError(f"page {start}")
    return [] if start == 4 else [json.dumps({"id": i, "full": True}) for i in range((start - 1) * 50, start * 50)]


def small(kind, start, scope):
    _noted("small", start, scope)
    if start == 6:
        raise TimeoutError(f"page {start}")
    return [json.dumps({"id": i, "full": False}) for i in range((start - 1) * 50, start * 50)]
