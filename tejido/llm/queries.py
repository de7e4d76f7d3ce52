"""The queries and the pipeline, as __spark_entry__ registers them; each is a thin digest over its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import table


def op3_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import search

    return search(table(spark, sf_dir, "embeddings"), 10, 100)


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_pu import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_rows", "capacity"
    )


def op1_hpylm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hpylm import score

    return score(table(spark, sf_dir, "documents"), 7, 2)


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .encoding import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup

    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_crf_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"))


def op8_multi_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), 3, 3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 2048, 1).drop("text_ids")


def op10_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .counting import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), 1024)


def op11_son_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), 100, 5, 2000)


def op12_token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shingle_join import linked_documents

    return linked_documents(table(spark, sf_dir, "documents"), 3, 90)


def op13_filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit, failure_masks

    return audit(*failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hpylm_scores, op2_trie_bpe, op3_one_bit_neighbours, op4_pu_quality, op5_minimax_sharding, op6_suffix_dedup, op7_crf_line_rules, op8_multi_index_simhash, op9_harmonic_packing,
        op10_prefix_token_counts, op11_son_phrases, op12_token_combination_join, op13_filter_diagrams,
    )
}
ORACLE_SQL: dict[str, str] = {"op11_son_phrases": sql.PHRASES, "op12_token_combination_join": sql.SHINGLE_JOIN, "op13_filter_diagrams": sql.FILTER_AUDIT}
