"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; two link at `distance` or fewer differing bits. It is held as two segments of 32 bits, and
with distance 3 one of the two differs in at most one bit. So each distinct fingerprint stands in a table of either
segment, enumerates the Hamming ball of radius one of each of its segments, fetches what stands there and has the complete
distance verified. Of two segments that differ in one bit only the one with the bit unset needs to look for the other.

Documents with the same fingerprint are one class from the start, however many, and stand in the index once, by their
smallest doc_id. Where very many distinct fingerprints share a segment, the other segment is cut once more (within three
bits, one of its halves differs in one bit at most), so that no bucket gives all its pairs. Classes that link, directly
or by others, form a component.

Null, empty and blank texts: fingerprint zero, linked like any other. Repeated rows and ids give one result row each. An id
with several texts stands for all of them, so they are in one component. A text that only rows
without an id have is a component of its own, with a null id. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, texts, written
from .components import components

SEED = 42
#: Distinct fingerprints in a segment bucket from which its other segment is cut too.
CROWDED = 512


def shingle_hashes(text: str, k: int = 3) -> np.ndarray:
    """XXH64 of the space-joined k-word shingles of a text whose A-Z are lowered; fewer words: the whole sequence."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxh64_intdigest(joined, SEED)], "<u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())), "<u8", len(starts))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16_384):
        bits = np.unpackbits(hashes[at : at + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([majority(shingle_hashes(t, k)) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _field(c: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(c, shift).bitwiseAND((1 << bits) - 1)


def _upward(key: Column, bits: int) -> Column:
    """The key and those of its neighbours that have one more bit set."""
    masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(bits)))
    return F.transform(F.filter(masks, lambda m: key.bitwiseAND(m) == 0), lambda m: key.bitwiseOR(m))


def _ball(key: Column, bits: int) -> Column:
    masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(bits)))
    return F.transform(masks, lambda m: key.bitwiseXOR(m))


def linked(classes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of class ids whose fingerprints differ in at most `distance` bits; classes: (fp, id), fp distinct."""
    if distance > 3:
        raise ValueError("two segments with balls of radius one find all pairs up to distance 3 only")
    # A segment's number is kept above its 32 bits, so that one long is the key.
    two = F.explode(F.array(*(F.struct(F.lit(s << 32).bitwiseOR(_field(F.col("fp"), 32 * s, 32)).alias("key"), _field(F.col("fp"), 32 - 32 * s, 32).alias("rest")) for s in (0, 1))))
    held = classes.select("fp", two.alias("s")).select("fp", "s.*")
    crowded = written(held.groupBy("key").count().where(F.col("count") > CROWDED).select("key"), "simhash-crowded")
    probe = held.select(F.explode(_upward(F.col("key"), 32)).alias("key"), F.col("fp").alias("fp1"), F.col("rest").alias("rest1"))
    near = (F.col("fp") != F.col("fp1")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp1"))) <= distance)
    # Both sides are dealt by the key at every size: the table is never sent to all tasks.
    if crowded.isEmpty():
        pairs = held.select("key", "fp").hint("merge").join(probe.select("key", "fp1"), "key").where(near).select("fp", "fp1")
    else:

        def marked(bit: int):
            return lambda x: x.bitwiseOR(bit)

        def quarters(rest: Column, ball: bool) -> Column:
            parts = [(h, _field(rest, 16 * h, 16)) for h in (0, 1)]
            return F.explode(F.flatten(F.array(*(F.transform(_ball(q, 16) if ball else F.array(q), marked(h << 16)) for h, q in parts))))

        plain = held.select("key", "fp").join(crowded, "key", "left_anti").hint("merge").join(probe.select("key", "fp1"), "key")
        full = held.join(crowded, "key", "left_semi").select("key", "fp", quarters(F.col("rest"), False).alias("quarter"))
        asked = probe.join(crowded, "key", "left_semi").select("key", "fp1", quarters(F.col("rest1"), True).alias("quarter"))
        fine = full.hint("merge").join(asked, ["key", "quarter"])
        pairs = plain.where(near).select("fp", "fp1").unionByName(fine.where(near).select("fp", "fp1"))
    pairs = written(pairs.distinct(), "simhash-pairs")
    name = lambda old, new: classes.select(F.col("fp").alias(old), F.col("id").alias(new))
    return pairs.join(name("fp", "a"), "fp").join(name("fp1", "b"), "fp1").select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that a document's links lead to."""
    marked = written(fingerprints(docs, k), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-classes")
    roots = components(linked(classes.where(F.col("id").isNotNull()), distance))
    named = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _row, a number of each row's own once they are written."""
    return docs.withColumn("_row", F.monotonically_increasing_id())


def first_rows(rows: DataFrame, named: DataFrame, columns: list[str]) -> DataFrame:
    """Of each component the row of the smallest doc_id, nulls last; named: (_row, doc_id, component)."""
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    return rows.join(first.select("first._row"), "_row", "left_semi").select(columns)


def keep(docs: DataFrame, k: int = 3, distance: int = 3) -> DataFrame:
    """The row of each component's smallest doc_id, with all columns of docs; texts without an id: one row of each fingerprint."""
    small_batches(docs.sparkSession)
    rows = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([majority(shingle_hashes(t or "", k)) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], [*b.schema.names, "_fp"])

    marked = written(rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_fp", T.LongType())])), "simhash-marked")
    # Fingerprints are the nodes here: one id can have several.
    classes = written(marked.where(F.col("doc_id").isNotNull()).select(F.col("_fp").alias("fp")).distinct().withColumn("id", F.col("fp")), "simhash-classes")
    found = marked.select("_row", "doc_id", F.col("_fp").alias("node")).join(components(linked(classes, distance)), "node", "left")
    return first_rows(marked, found.withColumn("component", F.coalesce("component", "node")), docs.columns)
