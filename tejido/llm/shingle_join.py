"""Jaccard join of word-shingle sets by token-combination prefixes.

Two documents link if the sets of their k-word shingles (fewer words: the whole sequence) are as similar as `percent`. A set
of n shingles can lack e = n - ceil(percent * n / 100) of them and still link. Shingles are split into classes by their exact
counts over sets: rare ones are in FREQUENT sets at most. A set's prefix are its first e + 1 rare shingles, each a key by
itself. If it has fewer, the prefix goes on with its frequent shingles, of which only combinations are keys: they are dealt
to groups by their hash, and all that a set has in a group make one key.

No pair is lost. If one of two similar sets has e + 1 rare shingles, one of these is in the other, and in its prefix. If neither
has, all their rare ones are keys; if they share none of these, their r1 + r2 rare ones all count as differences, of which
there may be d, so with d - r1 - r2 + 1 groups or more they are the same in one of them. A set gives keys for 1, 2, 4 ... groups, as many as
it can need with any partner, and a pair meets only under the number of groups that it needs. So sets that a few changes keep
below the threshold seldom meet, although they share nearly all shingles with thousands of others.

This goes in two rounds. The first counts the shingles of a fixed share of the hash space (LOW), which nearly always hold a
prefix of rare ones. The second takes the sets whose prefix isn't filled so, with all their shingles, counted over these sets.

Equal sets are one class from the start, however many documents have them. Under each key all classes are first compared with a few
of them (HEADS, those with the fewest rare shingles); what that leaves in different components is then compared, only classes outside a key's largest component
looking for partners. All candidates of fitting sizes are verified with the complete sets, from the
texts asked for (a bit filter of a fixed size tells most others apart where they are read).

Null, empty and blank texts: no shingles, linked with nothing, their own component. A row is known by its text: repeated ids
give one row each, with the component of the row's own text. A component without any id has a null component_id. An empty table gives no rows.
Further columns are ignored. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bits as filters
from .common import small_batches, trim, written
from .components import components

#: The share of the hash space from which rare shingles are taken, and the sets that one may be in.
LOW, FREQUENT = 0.18, 48
#: Classes of a key that all others under it are compared with at first.
HEADS = 2
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 19
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


class Shingler(dict):
    """Shingle sets of texts as ascending 64-bit hashes; keeps the hashes of words."""

    def __init__(self, k: int) -> None:
        super().__init__()
        self.k = k

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h

    def set_of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = max(len(words) - self.k + 1, min(1, len(words)))
        out = _mixed(h[:n] + np.uint64(min(self.k, len(words))))
        for j in range(1, min(self.k, len(words))):
            out = _mixed(out * _A + h[j : j + n])
        return np.unique(out)


def lacking(n, percent: int):
    """Shingles that a set of n may lack."""
    return n - -(-percent * n // 100)


def differing(n, m, percent: int):
    """Shingles that are in one only of two sets of n and m that link, at most."""
    return (100 - percent) * (n + m) // (100 + percent)


def combinations(shingles: np.ndarray, groups: int) -> np.ndarray:
    """For each of so many groups (a power of two) a key: which of the shingles are in it."""
    h = _mixed(shingles * _A)
    order = np.argsort(at := (h >> np.uint64(40)) & np.uint64(groups - 1), kind="stable")
    ends = np.searchsorted(at[order], np.arange(groups + 1, dtype=np.uint64))
    sums = np.append(np.uint64(0), np.cumsum(_mixed(h + _B)[order], dtype=np.uint64))
    return _mixed(_mixed((np.arange(groups, dtype=np.uint64) + np.uint64(groups)) * _B) + sums[ends[1:]] - sums[ends[:-1]])


def _lists(arrays: list) -> pa.ListArray:
    """Nones are null lists."""
    ends = pa.array(np.cumsum([0, *(0 if a is None else len(a) for a in arrays)]), pa.int32(), mask=np.array([*(a is None for a in arrays), False]))
    flat = [np.zeros(0, np.uint64), *(a for a in arrays if a is not None)]
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(flat).view(np.int64), pa.int64()))


def _longs(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, np.uint64).view(np.int64), pa.int64())


def marked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, _row (a hash of id and text), fp (of the set), n, and low: of a set that its task hasn't met yet, the shingles that are counted first."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("_row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        shingles, met, edge = Shingler(k), set(), np.uint64(int(LOW * 2**64))
        for b in batches:
            fps, ns, lows = [], [], []
            for text in b.column("text"):
                s = shingles.set_of(text.as_py())
                n, fp = len(s), xxh3_64_intdigest(s.tobytes())
                low = None
                # The smallest sets link with equal ones only.
                if n and fp not in met and 100 * n // percent > n:
                    met.add(fp)
                    low = s[: int(np.searchsorted(s, edge))]
                fps.append(fp)
                ns.append(n)
                lows.append(low)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_row"), _longs(fps), pa.array(ns, pa.int32()), _lists(lows)], ["doc_id", "_row", "fp", "n", "low"])
        trim()

    return written(rows.mapInArrow(run, "doc_id long, _row long, fp long, n int, low array<long>"), "shingle-sets")


def _read_again(docs: DataFrame, rows: DataFrame, took: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """took() of the rows (_row, text) of docs that are asked for by _row, and of few others (those that the bit filter lets through)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters.filter_of(rows, "_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            yield took(b.filter(pa.array(filters.found(bits, b.column("_row").to_numpy().view(np.uint64)))))
        trim()

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("_row"), text.alias("text")).mapInArrow(run, schema)


def _whole(docs: DataFrame, sets: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """fp, n, s: the complete sets of the classes asked for (fp), and of few others; a set may come twice."""
    first = sets.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("_row").alias("_row"))

    def took(b: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh3_64_intdigest

        shingles = Shingler(k)
        found = [shingles.set_of(t) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([_longs([xxh3_64_intdigest(s.tobytes()) for s in found]), pa.array(map(len, found), pa.int32()), _lists(found)], ["fp", "n", "s"])

    return written(_read_again(docs, first, took, "fp long, n int, s array<long>").where("n > 0"), "shingle-whole")


INDEX = "key long, groups int, fp long, n int, rare int, alone int"


def prefixes(sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """INDEX: the keys of sets (fp, n, s). groups: 0 for a rare shingle, else the number of groups of a combination.

    alone: shingles that no other set has. A set with more of them than it may lack links with nothing and has no keys, two
    sets with more of them than they may differ in don't link. Without `whole`, s is part of a set; one whose prefix isn't filled gives a row of -1 groups instead of combinations.
    """
    shingles = sets.select("fp", F.posexplode("s").alias("at", "h"))
    # Shingles of one set alone can't be shared; they only count as places in the order.
    common = written(shingles.groupBy("h").count().where("count > 1").select("h", (F.col("count") > FREQUENT).alias("often")), "shingle-counts")
    hits = shingles.join(common, "h").groupBy("fp").agg(F.sort_array(F.collect_set(F.struct("at", "h", "often"))).alias("hits"))
    column = lambda c, kind: F.coalesce(F.transform("hits", lambda x: x[c]), F.array().cast(f"array<{kind}>")).alias(c)
    met = sets.select("fp", "n", F.size("s").alias("size")).join(hits, "fp", "left").select("fp", "n", "size", column("at", "int"), column("h", "long"), column("often", "boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i, (n, size) in enumerate(zip(b.column("n").to_pylist(), b.column("size").to_pylist())):
                at, h, often = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("at", "h", "often"))
                h, often, alone = h.view(np.uint64), often.astype(bool), size - len(h)
                if alone > lacking(n, percent):
                    continue
                rare, prefix = size - int(often.sum()), lacking(n, percent) + 1
                single = h[~often & (at - np.cumsum(often) < prefix)]
                found.append((i, 0, rare, alone, single))
                if rare < prefix and not whole:
                    found.append((i, -1, rare, alone, np.zeros(1, np.uint64)))
                elif rare < prefix:
                    most, groups = differing(n, 100 * n // percent, percent) - rare + 1, 1
                    while groups < 2 * most:
                        found.append((i, groups, rare, alone, combinations(h[often], groups)))
                        groups *= 2
            at, groups, rare, alone = (np.array([x[j] for x in found], np.int64) for j in range(4))
            times = np.array([len(x[4]) for x in found], np.int64)
            keys = np.concatenate([np.zeros(0, np.uint64), *(x[4] for x in found)]).view(np.int64)
            own = [pa.array(np.repeat(x, times)) for x in (groups, b.column("fp").to_numpy()[at], b.column("n").to_numpy()[at], rare, alone)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(x if i == 1 else x.cast(pa.int32()) for i, x in enumerate(own))], ["key", "groups", "fp", "n", "rare", "alone"])

    # A set that several tasks have met gives the same keys again.
    return written(met.mapInArrow(run, INDEX).distinct(), "shingle-keys")


def indexed(docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """INDEX of all classes: by the shingles that are counted first, and of those that lack a prefix there by all."""
    first = prefixes(sets.where("low is not null").select("fp", "n", F.col("low").alias("s")), percent, False)
    lacking_one = first.where("groups = -1").select("fp")
    rest = prefixes(_whole(docs, sets, lacking_one, k), percent, True)
    return first.where("groups >= 0").unionByName(rest)


def _may(a: str, b: str, percent: int) -> Column:
    """Whether two rows of a key can link, and meet under as many groups as they need; a and b: what their columns end in."""
    one = lambda c: (F.col(f"{c}{a}"), F.col(f"{c}{b}"))
    (n, m), (r, s), (x, y) = one("n"), one("rare"), one("alone")
    most = F.floor((100 - percent) * (n + m) / (100 + percent))
    need = most - r - s + 1
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (x + y <= most) & ((F.col("groups") == 0) | (need <= F.col("groups")) & (2 * need > F.col("groups")))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


#: Sets that a task keeps while pairs are verified.
_KEPT = 64


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link. Compressed texts meet, which are a quarter of their sets in size."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    rows = written(sets.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("_row").alias("_row")), "shingle-asked")

    def took(b: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3).compress
        return pa.RecordBatch.from_arrays([b.column("_row"), pa.array([press(t.encode()) for t in b.column("text").to_pylist()], pa.binary())], ["_row", "z"])

    texts = written(_read_again(docs, rows, took, "_row long, z binary"), "shingle-texts")
    row = lambda i: rows.select(F.col("fp").alias(i), F.col("_row").alias(f"_row_{i}"))
    text = lambda i: texts.select(F.col("_row").alias(f"_row_{i}"), F.col("z").alias(f"z_{i}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, kept, open_ = Shingler(k), {}, zstandard.ZstdDecompressor().decompress

        def whole(fp: int, z: bytes) -> np.ndarray:
            if fp not in kept:
                if len(kept) >= _KEPT:
                    kept.clear()
                kept[fp] = shingles.set_of(open_(z).decode())
            return kept[fp]

        for batch in batches:
            hit = []
            for a, b, z_a, z_b in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "z_a", "z_b"))):
                x, y = whole(a, z_a), whole(b, z_b)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    met = pairs.join(row("a"), "a").join(row("b"), "b").join(text("a"), "_row_a").join(text("b"), "_row_b")
    return met.select("a", "b", "z_a", "z_b").mapInArrow(run, "a long, b long").distinct()


def linked(index: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int, more: DataFrame | None = None) -> DataFrame:
    """(node, component) of the classes that link with others. more: pairs (a, b) of classes to be compared first as well."""
    named = lambda df, end: df.select("key", "groups", *(F.col(c).alias(c + end) for c in ("fp", "n", "rare", "alone")))
    # The sets with the fewest rare shingles are the likeliest to be near to all others of a key.
    first = Window.partitionBy("key", "groups").orderBy("rare", "fp")
    heads = named(index.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= HEADS), "_head")
    star = index.join(heads, ["key", "groups"]).where((F.struct("rare", "fp") > F.struct("rare_head", "fp_head")) & _may("", "_head", percent)).select(*_pair("fp", "fp_head"))
    star = written((star if more is None else star.unionByName(more)).distinct(), "shingle-star")
    links = written(verify(star), "shingle-links")

    of = index.join(components(links), F.col("fp") == F.col("node"), "left").select(*index.columns, F.coalesce("component", "fp").alias("of"))
    several = of.groupBy("key", "groups", "of").count().groupBy("key", "groups").agg(F.max_by("of", "count").alias("most"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    apart = written(of.join(several, ["key", "groups"]), "shingle-apart")
    outside = apart.where("of <> most").select("key", "groups", F.col("fp").alias("fp_x"), F.col("n").alias("n_x"), F.col("rare").alias("rare_x"), F.col("alone").alias("alone_x"), F.col("of").alias("of_x"))
    partner = (F.col("of") != F.col("of_x")) & ((F.col("of") == F.col("most")) | (F.col("fp") > F.col("fp_x"))) & _may("", "_x", percent)
    crossed = apart.join(outside, ["key", "groups"]).where(partner).select(*_pair("fp", "fp_x")).distinct().join(star, ["a", "b"], "left_anti")
    return components(links.unionByName(verify(written(crossed, "shingle-crossed"))))


def linked_documents(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that a document's links lead to, itself included."""
    if not 50 < percent <= 100:
        raise ValueError("percent is above 50 and 100 at most")
    sets = marked(docs, k, percent)
    found = linked(indexed(docs, sets, k, percent), lambda pairs: verified(pairs, docs, sets, k, percent), percent)
    ids = sets.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("id"))
    of = ids.join(found, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("of"))
    least = of.groupBy("of").agg(F.min("id").alias("component_id"))
    # Written, so that Spark can split a set that very many documents have.
    named = written(of.join(least, "of").select("fp", "component_id"), "shingle-components")
    full = sets.where("n > 0").select("doc_id", "fp", F.col("n").cast("long").alias("n_shingles")).join(named, "fp").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(sets.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
