"""Near copies by SimHash and the exact similarity of their word shingles: what the SimHash operator does in the pipeline.

Two documents link if the sets of their five-word shingles (fewer words: the whole sequence) have a Jaccard similarity of
0.8 or more; documents that link, directly or by others, form a component. No pair is missed.

Documents with equal sets are one class from the start. Candidates come from two sources. The multi-index search of SimHash
fingerprints (simhash.linked, over these shingles, three bits) gives the nearest pairs. Pairs of similarity 0.8 are about ten of
64 bits apart, which no multi-index of such short fingerprints can enumerate; they come from the keys of the shingle join
(shingle_join.py): rare shingles by exact counts over all sets, and frequent ones only in combinations. So a line that very many
documents have is no key by itself, and no shingle's documents are gathered in one row: keys are rows throughout. All
candidates are verified with their complete sets.

A component keeps the row of its smallest doc_id (nulls last, the first of several). Rows are told apart by a number of their own,
so repeated and null ids lose nothing. Null, empty and blank texts have the empty set, and are one class. Shingles and
sets are held as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingle_join, simhash
from .common import small_batches, trim, written
from .simhash import first_rows, numbered

#: Words of a shingle, and the least similarity.
WORDS, PERCENT = 5, 80
#: The share of the hash space whose shingles are counted first: a set may lack a fifth of its shingles, and some are frequent.
LOW = 0.28


def marked(docs: DataFrame) -> DataFrame:
    """docs with _row, _key (a hash of id and text), _fp (a hash of the shingle set), _n (its size), _sim (its fingerprint) and _low: of a set that its task hasn't met yet, the shingles that are counted first."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        shingles, met, edge = shingle_join.Shingler(WORDS), set(), np.uint64(int(LOW * 2**64))
        for b in batches:
            fps, sims, ns, lows = [], [], [], []
            for text in b.column("text"):
                s = shingles.set_of(text.as_py() or "")
                fp, low = xxh3_64_intdigest(s.tobytes()), None
                # The smallest sets link with equal ones only.
                if len(s) and fp not in met and 100 * len(s) // PERCENT > len(s):
                    met.add(fp)
                    low = s[: int(np.searchsorted(s, edge))]
                fps.append(fp)
                sims.append(simhash.majority(s))
                ns.append(len(s))
                lows.append(low)
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, longs(fps), longs(sims), pa.array(ns, pa.int32()), shingle_join._lists(lows)], [*b.schema.names, "_fp", "_sim", "_n", "_low"])
        trim()

    rows = numbered(docs).withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    own = [T.StructField("_fp", T.LongType()), T.StructField("_sim", T.LongType()), T.StructField("_n", T.IntegerType()), T.StructField("_low", T.ArrayType(T.LongType()))]
    return written(rows.mapInArrow(run, T.StructType([*rows.schema.fields, *own])), "near-copies-marked")


def by_fingerprint(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a, b): classes of one fingerprint with the smallest of them, and these across fingerprints three bits apart."""
    classes = rows.where("_n > 0").select("_fp", "_sim").distinct()
    one = written(classes.groupBy(F.col("_sim").alias("fp")).agg(F.min("_fp").alias("id")), "near-copies-fingerprints")
    same = classes.join(one, F.col("_sim") == F.col("fp")).where("_fp <> id").select(F.least("_fp", "id").alias("a"), F.greatest("_fp", "id").alias("b"))
    return same.unionByName(simhash.linked(one).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def linked(rows: DataFrame) -> DataFrame:
    """(node, component) of the classes of marked rows that have a near copy."""
    docs = rows.select("doc_id", "text")
    sets = rows.select(F.col("_key").alias("_row"), F.col("_fp").alias("fp"), F.col("_n").alias("n"), F.col("_low").alias("low"))
    index = shingle_join.indexed(docs, sets, WORDS, PERCENT)
    verify = lambda pairs: shingle_join.verified(pairs, docs, sets, WORDS, PERCENT)
    return shingle_join.linked(index, verify, PERCENT, by_fingerprint(rows))


def keep(docs: DataFrame) -> DataFrame:
    """The row of each component's smallest doc_id, with all columns of docs."""
    rows = marked(docs)
    named = rows.select("_row", "doc_id", F.col("_fp").alias("node")).join(linked(rows), "node", "left")
    return first_rows(rows, named.withColumn("component", F.coalesce("component", "node")), docs.columns)
