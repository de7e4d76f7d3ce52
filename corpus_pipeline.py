"""The corpus pipeline: documents go through each stage in turn, and what a stage returns is written before the next reads it.

Quality classifier and quality rules drop what they reject, of each group of near copies (five-word shingles, similarity 0.8
or more, every pair found) one document stays, the suffix sort cuts repeated passages out, and packing cuts the rest into sequences of token ids, one row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tejido.llm import near_copies as copies
from tejido.llm import packing, quality_pu, quality_rules, suffix_dedup
from tejido.llm.common import table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_pu.keep(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return copies.keep(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.keep(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1, with_ids=True)


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("simhash_near_dedup", near_copies), ("suffix_array_dedup", passages), ("packing", pack)]

#: Training, Viterbi decoding, fingerprints and tokenizers are not expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
