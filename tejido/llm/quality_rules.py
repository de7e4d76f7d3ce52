"""Quality rules with line labels from a conditional random field.

Counts (words, characters, signs, repeated lines, words in repeated windows) settle the base rule. For texts that pass it,
Viterbi decoding of a linear-chain CRF marks each line with a word as content or boilerplate, and the share of words that
stand in content lines decides retention. The CRF is trained by likelihood on weakly labelled lines (crf.seed_labels), that
is, on rules about single lines, to which it adds what lines say about their neighbours. The sample is bounded: the
documents with the `sample_docs` smallest hashes of their id, of these the `SAMPLE_PIECES` pieces of at most `PIECE_LINES`
lines with the smallest hashes. Tasks make the features; two bytes for each line come to the driver, no text.

Null and empty texts: all counts zero, base_failed, not kept. Repeated rows and ids give one result row each. An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts
from .crf import FEATURES, LineCRF, line_features, seed_labels
from .textstats import repeated_words

SAMPLE_DOCS, SAMPLE_PIECES, PIECE_LINES = 600, 1200, 200
CONTENT_SHARE = 0.5
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
SPACE = re.compile(r"[\x20\x09-\x0D]")
SYMBOL = re.compile(r"[#*$%&|<>]")


def lines_of(text: str) -> tuple[list[bytes], list[bool]]:
    """The lines with a word, and whether each equals an earlier line."""
    lines, again, met = [], [], set()
    for line in text.encode().split(b"\n"):
        if line.strip():
            lines.append(line)
            again.append(line in met)
            met.add(line)
    return lines, again


def line_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most PIECE_LINES lines, each line's indicators as the bits of a number."""
    weights = 1 << np.arange(len(FEATURES))
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            lines, again = lines_of(text.as_py())
            pieces = []
            for at in range(0, len(lines), PIECE_LINES):
                f = line_features(lines[at : at + PIECE_LINES], again[at : at + PIECE_LINES])
                pieces.append((f.astype(np.int64) @ weights).astype("<u2").tobytes())
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["doc_id", "piece", "bits"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LineCRF:
    picked = [r[0] for r in docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]
    if not picked:
        return LineCRF.fit([])
    pieces = texts(docs.where(F.col("doc_id").isin(picked))).mapInArrow(line_bits, "doc_id long, piece int, bits binary")
    rows = pieces.orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "bits").limit(SAMPLE_PIECES).collect()
    sequences = []
    for r in rows:
        f = (np.frombuffer(r["bits"], "<u2")[:, None].astype(np.int64) >> np.arange(len(FEATURES)) & 1).astype(float)
        sequences.append((f, seed_labels(f)))
    return LineCRF.fit(sequences)


def judge(text: str, crf: LineCRF, content_share: float) -> tuple:
    words = text.encode().split()
    n = len(words)
    lines, again = lines_of(text)
    repeats = repeated_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    labels = crf.decode(line_features(lines, again)) if lines else []
    weights = [len(x.split()) for x in lines]
    share = sum(w for w, y in zip(weights, labels) if y) / n if n else 0.0
    return n, len(text) - len(SPACE.findall(text)), len(SYMBOL.findall(text)), sum(again), repeats, failed, not failed and share >= content_share, len(lines), sum(labels), share


def apply_rules(docs: DataFrame, crf: LineCRF | None = None, content_share: float = CONTENT_SHARE) -> DataFrame:
    """SCHEMA: one row per row of docs."""
    model = crf or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]
        for b in batches:
            columns = list(zip(*(judge(t, model, content_share) for t in b.column("text").to_pylist()))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], NAMES)

    return texts(docs).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, judged where they stand: no join."""
    model = train(docs)
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [judge(t or "", model, CONTENT_SHARE)[6] for t in b.column(names.index("text")).to_pylist()]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
