"""Hosts that answer as shop platforms do, or otherwise."""

import json


def fetch(method, url, body):
    host, _, path = url.removeprefix("https://").partition("/")
    if host == "down.com":
        raise ConnectionError(host)
    if host == "shop.com" and path.startswith("products.json"):
        return 200, "application/json", '{"products": []}'
    if host in ("v.com", "acme2.vtexcommercestable.com.br") and path.startswith("api/"):
        return 206, "application/json; charset=utf-8", '[{"productId": "1"}]'
    if host == "acme.vtexcommercestable.com.br" and path.startswith("api/"):
        return 200, "application/json", "[]"
    if host == "m.com" and path == "graphql":
        assert method == "POST" and "total_count" in json.loads(body)["query"]
        return 200, "application/json", '{"data": {"products": {"total_count": 3}}}'
    if host == "bad.com" and path == "graphql":
        return 200, "application/json", '{"data": {"products": null}}'
    if host == "t.com" and path == "sitemap.xml":
        return 200, "text/xml", "<loc>https://t.com/productos/x</loc>"
    if host == "hidden.com" and path == "":
        return 200, "text/html", '{"account": "acme"} {"account":"acme2"} {"account":"acme"}'
    # A shell that gives its page for every address.
    return (200, "text/html", "<html>") if host in ("hidden.com", "bad.com") else (404, "text/html", "")
