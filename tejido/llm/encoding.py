"""BPE encoding and decoding of whole texts by prefix-sharing tries (see bpe.py).

Distinct words of a chunk of texts are put into a trie, whose nodes get their last-token state once, depth first. Texts
are then put together from the words' ids. The work is a plain map over the scan: no shuffle, and memory is bounded by
one Arrow batch and the word memo.

Null text: encoded as the empty text (no ids). Repeated rows and ids give one result each; an empty table gives no rows;
of further columns only those named in `keep` are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Encoder, Merges, RoundTrip, in_worker
from .common import texts


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = in_worker(Encoder, vocabulary)
        for b in batches:
            ids = list(encoder.encode_batch(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text: special tokens as their strings, bytes that are no UTF-8 as U+FFFD. Null ids: null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = in_worker(Merges, vocabulary)
        for b in batches:
            out = [None if ids is None else merges.decode(ids) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of a text's ids and of what they decode to, without moving ids between processes."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = in_worker(RoundTrip, vocabulary)
        for b in batches:
            n, a, d = [], [], []
            for decimal, count, decoded in encoder.round_trips(b.column("text").to_pylist()):
                n.append(count)
                a.append(sha256(decimal.encode()).hexdigest())
                d.append(sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], DIGEST.names)

    return texts(docs).select(F.col("doc_id"), F.col("text")).mapInArrow(run, DIGEST)
