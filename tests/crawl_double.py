"""A shop's list of addresses and its pages. The list repeats addresses; fetches are noted, and the list can be made to break once."""

import os

LOG, BREAK = (f"/tmp/crawl_double_{os.getuid()}.{x}" for x in ("log", "break"))
URLS = [f"https://shop/p/{i % 70}" for i in range(100)]


def listed(start, end):
    if start >= 40 and os.path.exists(BREAK):
        raise ConnectionError("the list can't be had")
    return URLS[start:end]


def page(url):
    with open(LOG, "a") as f:
        f.write(url + "\n")
    number = int(url.rpartition("/")[2])
    if number % 10 == 7 and not os.path.exists(LOG + ".calm"):
        return 503, ""
    if number % 10 == 8:
        return 404, ""
    if number == 9:
        raise OSError("no route")
    return 200, f"<p>{number}</p>"
