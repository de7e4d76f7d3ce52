"""Paged shop APIs as a Spark data source: pages are planned on the driver and fetched by tasks.

The fetcher is given by name (`module:function`) and maps (kind, page number or offset, scope) to a list of JSON texts, so
that landed files, a test double or an HTTP client can stand behind it. Rows are (scope, turn, position, line, error): turn is the
scope's place in the plan, position the row's in its scope.

Plans: `shopify` reads pages of 250, up to 400, and a block of pages ends at its first short page. `magento` reads pages of 50
until the total. `vtex` reads offsets of 50 up to 2,500; with more in total, the flat catalogue is read as far as it goes, and
then the tree of categories: each category, and where one has more than the cap, its children too. Scopes overlap, so a product
can come several times: `first_by_id` keeps what the earliest scope has, and `whole` refuses what doesn't reach the total.
What can't be reached is an error before anything is fetched, unless the option `beyond` is "leave".

`limit` plans no more pages than the first so many rows take. Filters on scope and position reach the plan (shop_pages_filtered),
and pages that they rule out aren't fetched. With `fallback`, a second fetcher is asked for a page that fails or comes
empty, and goes on for the rest of a block once it was needed. With `errors` set to "rows" a page that fails for good gives a row with what went wrong.
"""

from __future__ import annotations

import importlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Page sizes and caps of the platforms.
SIZE = {"shopify": 250, "vtex": 50, "magento": 50}
SHOPIFY_PAGES, VTEX_CAP = 400, 2500
SCHEMA = "scope string, turn int, position long, line string, error string"


class Incomplete(ValueError):
    """Rows that the platform has can't be or weren't reached."""


@dataclass
class Block(InputPartition):
    """Pages of one scope. rows: how many the scope is known to have (None: unknown); low, high: positions wanted."""

    scope: str
    turn: int
    starts: list[int]
    size: int
    stop_short: bool
    rows: int | None = None
    low: int = 0
    high: float = math.inf


@dataclass
class Scope:
    """A category: its path, its number of rows, its children."""

    path: str
    n: int
    children: list[Scope] = field(default_factory=list)


def tree(nodes: dict | list | None) -> list[Scope]:
    """Scopes from {path: n}, or from a list of {"path", "n", "children"}."""
    if isinstance(nodes, dict):
        return [Scope(k, int(v)) for k, v in nodes.items()]
    return [Scope(x["path"], int(x["n"]), tree(x.get("children"))) for x in nodes or ()]


def _reach(scope: Scope) -> int:
    """Rows of a scope that can be reached at most, through itself and what is below."""
    return scope.n if scope.n <= VTEX_CAP else min(scope.n, VTEX_CAP + sum(map(_reach, scope.children)))


def split(scope: Scope) -> Iterator[Scope]:
    """The scopes to read for all of a scope: itself, and its children where it has more than the cap."""
    yield scope
    if scope.n > VTEX_CAP:
        for child in scope.children:
            yield from split(child)


def plan(kind: str, total: int | None = None, scopes: dict | list | None = None, block: int = 20, beyond: str = "raise", limit: int | None = None) -> list[Block]:
    """Blocks of pages. total: rows of the whole catalogue where the platform tells; scopes: see tree(); limit: rows wanted."""
    size, high = SIZE[kind], math.inf if limit is None else limit
    if kind == "vtex":
        whole = Scope("", total or 0, tree(scopes))
        enough = whole.n <= VTEX_CAP or high <= VTEX_CAP
        parts = [Scope("", whole.n)] if enough else [s for i, s in enumerate(split(whole)) if s.n]
        short = {s.path: s.n for s in ([] if enough else split(whole)) if _reach(s) < s.n}
        if short and beyond != "leave":
            raise Incomplete(f"more rows than can be reached in {short}: give narrower scopes, or beyond=leave")
        seen: dict[str, Scope] = {}
        for s in parts:
            seen.setdefault(s.path, s)
        pages = [(s.path, list(range(0, min(s.n, VTEX_CAP), size)), s.n) for s in seen.values()]
    elif kind == "magento":
        pages = [("", list(range(1, math.ceil((total or 0) / size) + 1)), total or 0)]
    else:
        pages = [("", list(range(1, SHOPIFY_PAGES + 1)), None)]
    high = high if len(pages) == 1 else math.inf
    out = []
    for turn, (scope, starts, n) in enumerate(pages):
        wanted = [s for s in starts if _position(kind, s, size) < high]
        out += [Block(scope, turn, wanted[i : i + block], size, kind != "magento", n, high=high) for i in range(0, len(wanted), block)]
    return out


def _position(kind: str, start: int, size: int) -> int:
    return start if kind == "vtex" else (start - 1) * size


def _named(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.kind = options["kind"]
        self.fetcher = options["fetcher"]
        self.fallback = options.get("fallback", "")
        self.as_rows = options.get("errors", "raise") == "rows"
        self.beyond = options.get("beyond", "raise")
        self.total = int(options.get("total", "0"))
        self.limit = int(options["limit"]) if "limit" in options else None
        said = options.get("scopes", "")
        self.scopes = json.loads(said) if said.startswith(("[", "{")) else dict((k, int(v)) for k, _, v in (x.partition("=") for x in said.split(",") if x))
        self.paths: set[str] | None = None
        self.low, self.high = 0, math.inf

    def partitions(self):
        blocks = plan(self.kind, self.total, self.scopes, beyond=self.beyond, limit=self.limit)
        out = []
        for b in blocks:
            b.low, b.high = max(b.low, self.low), min(b.high, self.high)
            inside = lambda s, b=b: (at := _position(self.kind, s, b.size)) < b.high and at + b.size > b.low
            b.starts = [s for s in b.starts if inside(s)]
            if b.starts and (self.paths is None or b.scope in self.paths):
                out.append(b)
        # A plan without pages still is a plan: one empty block.
        return out or [Block("", 0, [], SIZE[self.kind], True)]

    def read(self, partition: Block) -> Iterator[tuple]:
        b, asked = partition, [_named(self.fetcher), *([_named(self.fallback)] if self.fallback else [])]
        for start in b.starts:
            base = _position(self.kind, start, b.size)
            lines, error = [], None
            for i, fetch in enumerate(asked):
                try:
                    lines = fetch(self.kind, start, b.scope)
                except Exception as e:
                    error = e
                    continue
                if lines:
                    # What the first can't give here it hardly gives for the next page.
                    asked = asked[i:]
                    break
            if not lines and error is None and b.rows is not None and base < min(b.rows, VTEX_CAP if self.kind == "vtex" else b.rows):
                error = Incomplete(f"page {start} of {b.scope or 'the catalogue'} is empty, though there are {b.rows} rows")
            if not lines and error is not None:
                if not self.as_rows:
                    raise error
                yield b.scope, b.turn, base, None, f"{type(error).__name__}: {error}"
                continue
            for i, line in enumerate(lines):
                if b.low <= base + i < b.high:
                    yield b.scope, b.turn, base + i, line, None
            if b.stop_short and len(lines) < b.size:
                return
            if self.kind == "shopify" and start == SHOPIFY_PAGES and self.beyond != "leave":
                raise Incomplete(f"page {start} is full: there may be more than can be fetched; beyond=leave takes what there is")


class FilteredReader(PagedReader):
    """Takes filters on scope and position over from Spark; all others stay with it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case EqualTo(("scope",), str(value)):
                    self.paths = {value} if self.paths is None else self.paths & {value}
                case In(("scope",), values):
                    self.paths = set(values) if self.paths is None else self.paths & set(values)
                case EqualTo(("position",), int(value)):
                    self.low, self.high = max(self.low, value), min(self.high, value + 1)
                case LessThan(("position",), int(value)):
                    self.high = min(self.high, value)
                case LessThanOrEqual(("position",), int(value)):
                    self.high = min(self.high, value + 1)
                case GreaterThan(("position",), int(value)):
                    self.low = max(self.low, value + 1)
                case GreaterThanOrEqual(("position",), int(value)):
                    self.low = max(self.low, value)
                case _:
                    yield f


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("shop_pages").options(kind=..., fetcher="module:function").load()"""

    @classmethod
    def name(cls) -> str:
        return "shop_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class FilteredSource(PagedSource):
    """The same, taking filters over; Spark asks that spark.sql.python.filterPushdown.enabled be set for such a source."""

    @classmethod
    def name(cls) -> str:
        return "shop_pages_filtered"

    def reader(self, schema) -> DataSourceReader:
        return FilteredReader(self.options)


def pages(spark: SparkSession, **options) -> DataFrame:
    """Rows of a shop; filters on scope and position are pushed to the plan."""
    spark.dataSource.register(FilteredSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("shop_pages_filtered").options(**{k: json.dumps(v) if isinstance(v, (dict, list)) else v for k, v in options.items()}).load()


def first_by_id(rows: DataFrame, key: Column | str = "$.productId") -> DataFrame:
    """rows with `id`: of each product what the earliest scope and position have; rows without an id are left out, as are errors."""
    named = rows.withColumn("id", F.get_json_object("line", key) if isinstance(key, str) else key).where("id <> ''")
    first = F.min_by(F.struct("scope", "turn", "position", "line"), F.struct("turn", "position"))
    return named.groupBy("id").agg(first.alias("r")).select("id", "r.*")


def whole(products: DataFrame, total: int, beyond: str = "raise") -> DataFrame:
    """products, if they are as many as the platform has."""
    if beyond != "leave" and (n := products.count()) < total:
        raise Incomplete(f"{n} products of {total} were reached")
    return products
