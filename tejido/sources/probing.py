"""What shop platform answers under a domain, and under which host: by asking, where markup says nothing.

The fetcher is given by name (`module:function`) and maps (method, url, body) to (status, content type, body). A domain is asked in
order and no longer than until something is proved; all domains are asked in parallel, one row each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .landed import platform
from .paged import _named

#: Where platforms answer, the query that one of them is asked, the signs of an account name and of an internal host.
PROBES = {"shopify": ("GET", "/products.json?limit=1"), "vtex": ("GET", "/api/catalog_system/pub/products/search?_from=0&_to=0"), "magento": ("POST", "/graphql"), "tiendanube": ("GET", "/sitemap.xml")}
MAGENTO_QUERY = '{products(search:"" pageSize:1 currentPage:1){total_count items{sku}}}'
ACCOUNT = re.compile(r'"account"\s*:\s*"([a-z0-9][a-z0-9-]{1,22})"', re.I)
INTERNAL = "{}.vtexcommercestable.com.br"

Fetcher = Callable[[str, str, str | None], tuple[int, str, str]]


def _asked(fetch: Fetcher, method: str, url: str, body: str | None = None) -> tuple[str, str]:
    """(content type, body) of a good answer, else nothing."""
    try:
        status, kind, text = fetch(method, url, body)
    except Exception:  # noqa: BLE001  a host that can't be had proves nothing
        return "", ""
    return (kind or "", text or "") if status in (200, 206) else ("", "")


def _json(answer: tuple[str, str]):
    try:
        return json.loads(answer[1]) if "json" in answer[0] else None
    except ValueError:
        return None


def proved(domain: str, fetch: Fetcher) -> str | None:
    """The first platform whose own address answers as only it does."""
    for name, (method, path) in PROBES.items():
        answer = _asked(fetch, method, f"https://{domain}{path}", json.dumps({"query": MAGENTO_QUERY}) if name == "magento" else None)
        said = _json(answer)
        match name, said:
            case "shopify", {"products": [*_]}:
                return name
            case "vtex", [*_]:
                return name
            case "magento", {"data": {"products": found}} if found:
                return name
            case "tiendanube", _ if "/productos/" in answer[1]:
                return name
    return None


def catalogue_host(domain: str, fetch: Fetcher) -> str:
    """The host that serves a vtex catalogue: the public one, else the first internal one of the accounts that the home page names; the public one if none does."""
    has_rows = lambda host: bool(_json(_asked(fetch, "GET", f"https://{host}{PROBES['vtex'][1]}")))
    if has_rows(domain):
        return domain
    accounts = dict.fromkeys(ACCOUNT.findall(_asked(fetch, "GET", f"https://{domain}/")[1]))
    return next((h for a in accounts if has_rows(h := INTERNAL.format(a))), domain)


def _mapped(domains: DataFrame, fetcher: str, answer: Callable[[str, Fetcher], str | None], name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = _named(fetcher)
        for b in batches:
            found = [None if d is None else answer(d, fetch) for d in b.column("domain").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("domain"), pa.array(found, pa.string())], ["domain", name])

    return domains.select("domain").distinct().mapInArrow(run, f"domain string, {name} string")


def hosts(domains: DataFrame, fetcher: str) -> DataFrame:
    """domain, host: see catalogue_host."""
    return _mapped(domains, fetcher, catalogue_host, "host")


def detected(sites: DataFrame, fetcher: str) -> DataFrame:
    """sites (domain, html) with `platform`, by host and markup, and by asking where these say nothing; `evidence` is markup or answer."""
    named = sites.withColumn("platform", platform(F.coalesce("html", F.lit("")), F.col("domain")))
    asked = _mapped(named.where("platform = 'unknown'"), fetcher, proved, "proved")
    known = F.col("platform") != "unknown"
    out = named.join(asked, "domain", "left").withColumn("evidence", F.when(known, "markup").when(F.col("proved").isNotNull(), "answer"))
    return out.withColumn("platform", F.when(known, F.col("platform")).otherwise(F.coalesce("proved", "platform"))).drop("proved")
