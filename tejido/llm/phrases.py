"""Collocations by SON partitioning: phrases that are frequent somewhere are found first, and only these are counted.

All is per language. The documents' partitions are dealt to SHARDS shards. A phrase that is frequent in a language
(`support` occurrences or more) has its share in at least one shard: ceil(support * the shard's words / the language's words)
occurrences or more there. So each shard is mined completely for all phrases of 1 to `longest` words that reach its lowered
support, what any shard finds goes into one union, and one further pass counts everything in the union exactly, by the words
themselves. The number of shards is fixed, so the lowered support doesn't fall to one as the corpus grows; a shard is as
many tasks as it has partitions.

Mining: each task hashes its phrases (40 bits; phrases that collide only add to what is counted later), counts them in chunks
of a bounded number of words, and sends each range of hashes as a packed row (2.5 bytes a phrase or so). The task of a
range has its part of all shards, adds up each shard's counts and holds them against the shard's support; every row names the
words of its chunk, so each range knows all totals. Ranges grow in number with the corpus. The union is a bit filter of a
fixed size (bits.py), the only thing that goes through the driver: a collision costs work, never a phrase. Counting looks
at a phrase only if its parts without the last and without the first word passed; a task adds up what it has counted and sends
it packed, by ranges of phrases, to be added up once more.

Only phrases that reach the support are kept from there; scoring, ranking and the search for longer phrases that hold a
phrase are joins and aggregations over these.

Null text: as the empty text. Null lang: "und" (as that lang). A lang without candidates gives no rows. Repeated rows count each; ids aren't read.
An empty table gives no rows. Further columns are ignored. One text is held whole by a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import bits as filters
from .common import small_batches, trim, written
from .packed import pack, unpack

#: Shards: the lowered support of an even one is ceil(support / SHARDS).
SHARDS = 8
#: Words of a chunk that a task counts at once, phrases of a range at most (about), and the least number of ranges.
CHUNK, RANGE, LEAST_RANGES = 1 << 20, 4 << 20, 64
#: Bits of a phrase's hash while shards are mined.
HASH_BITS = 40
#: Words that a task remembers between chunks.
REMEMBERED = 1 << 21
#: Phrases whose counts a task adds up before they become rows (and those of one chunk more).
HELD = 1 << 20
#: Lower-cases A-Z; what ends a piece becomes a line end, a tab a space.
SIGNS = bytes(ord("\n") if chr(c) in ".,;:!?\n\v\f\r" else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


class Words(dict):
    """A number for each word; 0 ends a piece, -1 is what stands between two blanks."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": -1})
        self.words, self.hashes = [b"\n"], [0]

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(xxh64_intdigest(word))
        return n

    def numbers(self, text: str) -> np.ndarray:
        """The words' numbers, each piece followed by 0."""
        found = text.encode().translate(SIGNS).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, found), np.int32, len(found))
        return np.append(ids[ids >= 0], np.int32(0))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, Words]]:
    """(lang, word numbers, their words) of chunks of texts, CHUNK words or one text more."""
    words, held, size = Words(), {}, 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            ids = words.numbers(text.as_py())
            held.setdefault(lang, []).append(ids)
            size += len(ids)
            if size >= CHUNK:
                yield from ((k, np.concatenate(v), words) for k, v in held.items())
                held, size = {}, 0
                words = words if len(words) < REMEMBERED else Words()
                trim()
    yield from ((k, np.concatenate(v), words) for k, v in held.items())


class Hashes:
    """Hashes of the phrases of a chunk: by length, one word longer each time."""

    def __init__(self, lang: str, ids: np.ndarray, words: Words) -> None:
        from xxhash import xxh64_intdigest

        self.word = np.array(words.hashes, np.uint64)[ids]
        self.hash = _mixed(self.word + np.uint64(xxh64_intdigest(lang.encode())))
        self.n = 1

    def extend(self, at: np.ndarray) -> None:
        """The hashes at these places take in the next word."""
        self.hash[at] = _mixed(self.hash[at] * _A + self.word[at + self.n])
        self.n += 1


def _packed(ids: np.ndarray, hashes: Hashes, longest: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """For each of 2^bits ranges: the distinct hashes of all phrases of a chunk from the range's first on, and their counts."""
    alive, found = ids > 0, []
    for n in range(1, longest + 1):
        if n > 1:
            alive = alive[:-1] & (ids[n - 1 :] > 0)
            hashes.extend(np.flatnonzero(alive))
        found.append(hashes.hash[: len(alive)][alive] >> np.uint64(64 - HASH_BITS))
    distinct, counts = np.unique(np.concatenate(found), return_counts=True)
    width = HASH_BITS - bits
    ends = np.searchsorted(distinct, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(width))
    for r, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        inside = distinct[a:b].astype(np.int64) - (r << width)
        yield r, pack(np.diff(inside, prepend=0), counts[a:b] - 1)


def _summed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [unpack(x) for x in parts]
    hashes, counts = (np.concatenate(x) for x in zip(*((np.cumsum(d), c + 1) for d, c in found)))
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def _ranges(docs: DataFrame, longest: int) -> int:
    """Bits of the number of ranges into which phrases are dealt while shards are mined."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word and the sign after it are seldom under four bytes.
    bits = max(LEAST_RANGES, longest * size // 4 // RANGE).bit_length() - 1
    return min(bits, filters.BITS - 3)


def locally_frequent(docs: DataFrame, support: int, longest: int, bits: int) -> bytes:
    """The bit filter of all phrases that reach the lowered support of a shard; docs: lang, text; bits: see _ranges."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % SHARDS
        for lang, ids, words in chunks(batches):
            n = int((ids > 0).sum())
            for r, data in _packed(ids, Hashes(lang, ids, words), longest, bits) if n else ():
                yield pa.RecordBatch.from_pylist([{"range": r, "shard": shard, "lang": lang, "n": n, "data": data}], pa.schema([("range", pa.int32()), ("shard", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("data", pa.binary())]))

    width = filters.BITS - bits

    def union(rows: pa.Table) -> pa.Table:
        kind = lambda r: (r["lang"], r["shard"])
        held = sorted(rows.to_pylist(), key=kind)
        totals: dict[str, int] = {}
        for r in held:
            totals[r["lang"]] = totals.get(r["lang"], 0) + r["n"]
        hit = np.zeros(1 << width, bool)
        for (lang, _), own in groupby(held, kind):
            own = list(own)
            need = -(-support * sum(r["n"] for r in own) // totals[lang])
            hashes, counts = _summed([r["data"] for r in own])
            hit[hashes[counts >= need] >> (HASH_BITS - filters.BITS)] = True
        trim()
        number, data = filters.part(held[0]["range"], hit)
        return pa.table({"range": pa.array([number], pa.int32()), "bits": [data]})

    mined = docs.mapInArrow(mine, "range int, shard int, lang string, n long, data binary")
    return filters.joined((r["range"], r["bits"]) for r in mined.groupBy("range").applyInArrow(union, "range int, bits binary").collect())


def _counted(lang: str, ids: np.ndarray, words: Words, bits: np.ndarray, longest: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Phrases of a chunk that are in the filter, one length after the other, and their counts."""
    hashes = Hashes(lang, ids, words)
    alive, dense = ids > 0, ids.astype(np.int64)
    for n in range(1, longest + 1):
        if n > 1:
            alive[:-1] &= alive[1:]
            alive[-1:] = False
        at = np.flatnonzero(alive)
        if n > 1:
            hashes.extend(at)
        inside = filters.found(bits, hashes.hash[at])
        alive[at[~inside]] = False
        at = at[inside]
        if not len(at):
            return
        # Told apart by the words themselves: the phrase without its last word has a number, and so has that word.
        key = dense[at] if n == 1 else dense[at] * len(words.words) + ids[at + n - 1]
        _, first, dense[at], counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        yield [b" ".join([words.words[w] for w in ids[p : p + n].tolist()]) for p in at[first].tolist()], counts


def _rows(held: dict[str, dict[bytes, int]], ranges: int) -> Iterator[pa.RecordBatch]:
    """A packed row for each lang and range of phrases; a line end is in no phrase."""
    from xxhash import xxh32_intdigest

    press = zstandard.ZstdCompressor(level=1).compress
    for lang, own in held.items():
        dealt: dict[int, list[bytes]] = {}
        for phrase in sorted(own):
            dealt.setdefault(xxh32_intdigest(phrase) % ranges, []).append(phrase)
        for r, phrases in dealt.items():
            counts = pack(np.array([own[x] for x in phrases], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([lang], pa.string()), pa.array([press(b"\n".join(phrases))], pa.binary()), pa.array([counts], pa.binary())], ["range", "lang", "phrases", "counts"])


def frequent(docs: DataFrame, support: int, longest: int) -> DataFrame:
    """lang, phrase, f of all phrases with f >= support, and of the empty phrase: f is all words of the lang."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bits = _ranges(texts, longest)
    shared = docs.sparkSession.sparkContext.broadcast(locally_frequent(texts, support, longest, bits))
    # What is counted is a small part of what is mined.
    ranges = max(LEAST_RANGES, (1 << bits) // 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, held = np.frombuffer(shared.value, np.uint8), {}
        for lang, ids, words in chunks(batches):
            own = held.setdefault(lang, {})
            own[b""] = own.get(b"", 0) + int((ids > 0).sum())
            for found, counts in _counted(lang, ids, words, passed, longest):
                for phrase, n in zip(found, counts.tolist()):
                    own[phrase] = own.get(phrase, 0) + n
            if sum(map(len, held.values())) > HELD:
                yield from _rows(held, ranges)
                held.clear()
        yield from _rows(held, ranges)

    def add(rows: pa.Table) -> pa.Table:
        sums: dict[str, dict[bytes, int]] = {}
        for r in rows.to_pylist():
            own = sums.setdefault(r["lang"], {})
            for phrase, n in zip(zstandard.decompress(r["phrases"]).split(b"\n"), unpack(r["counts"])[0].tolist()):
                own[phrase] = own.get(phrase, 0) + n
        out = [(lang, phrase, n) for lang, own in sums.items() for phrase, n in own.items() if n >= support or not phrase]
        trim()
        langs, phrases, counts = zip(*out) if out else ((), (), ())
        return pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "f": pa.array(counts, pa.int64())})

    packed = texts.mapInArrow(count, "range int, lang string, phrases binary, counts binary")
    return written(packed.groupBy("range").applyInArrow(add, "lang string, phrase string, f long"), "phrases")


def lift(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), by decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n), wide(left) * wide(right))


#: Parts of a lang's total, so that its phrases meet it in as many tasks.
_SALTS = 64


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first `top` phrases by their lowest-scoring cut."""
    all_f = frequent(docs, support, longest)
    f = all_f.where("phrase <> ''")
    words = f.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("ws")).withColumn("m", F.size("ws")).where("m > 1")
    joined = lambda start, length: F.array_join(F.slice("ws", start, length), " ")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda j: F.transform(F.sequence(F.lit(1), F.col("m") - j + 1), lambda s: joined(s, j))))
    held = words.where("m > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = words.join(held, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")

    part = lambda name, to: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(to))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.struct(k.alias("k"), joined(F.lit(1), k).alias("left"), joined(k + 1, F.col("m") - k).alias("right"))))
    cuts = own.select("lang", "phrase", "a", cut.alias("c")).select("lang", "phrase", "a", "c.*").join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    totals = all_f.where("phrase = ''").select("lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    scored = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)).cast("int")).join(totals, ["lang", "salt"])
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(lift(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
