"""Exact token counts by prefix dynamic programming (see bpe.py).

For every prefix of a word the count is the count of the prefix before its last token, plus one; a text's count is the
sum over its words. `Table` answers truncation and budget questions of one text from the stored counts, without a second
encoding; here the budget's answer is given per document: how many characters fit into `limit` tokens.

Null text: as the empty text (0 tokens). Repeated rows and ids give one result each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Counter, in_worker
from .common import texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """SCHEMA; fit_chars: code points of the longest prefix within the limit (the whole text where it is not over)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = in_worker(Counter, vocabulary)
        for b in batches:
            texts = b.column("text").to_pylist()
            counts, fits = [], []
            for text, table in zip(texts, counter.tables(texts)):
                counts.append(table.total)
                fits.append(len(text) if table.total <= limit else table.fit(limit))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(fits, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return texts(docs).mapInArrow(run, SCHEMA)
