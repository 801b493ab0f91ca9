"""The ``opN_<name>`` queries: each operator over its whole table, as digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytepairs, langid, licenses, pii
from .common import ship_package, table
from .neardup import near_duplicates
from .oracles import ORACLES  # noqa: F401
from .packing import pack_documents
from .preference import crossed_pairs, format_pairs, mask_text
from .quality import quality
from .ranked_search import search
from .sentencepieces import encode_decode
from .suffixes import remove_repeats
from .turn_trie import conversation_turns, prefix_trie, share_heads
from .vectors import near_vectors


def op1_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op3_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.language_digest(docs, langid.train(docs))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.pii_digest(docs, pii.train(docs))


def op6_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = format_pairs(crossed_pairs(table(spark, sf_dir, "conversations")))
    return pairs.select("pair_id", "n_prompt_turns", "prompt", "chosen", mask_text(F.col("chosen_mask")).alias("chosen_mask"),
                        "rejected", mask_text(F.col("rejected_mask")).alias("rejected_mask"))


def op8_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(share_heads(conversation_turns(table(spark, sf_dir, "conversations"))))


def op13_byte_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.encode_decode(table(spark, sf_dir, "documents"))


_ALL = [op1_license_classifier, op2_quality_divergence, op3_string_kernel_langid, op4_best_fit_packing, op5_pii_boosted, op6_metric_range_join,
        op7_preference_format, op8_sentencepiece_chunks, op9_minhash_near_dedup, op10_suffix_dedup, op11_nra_search,
        op12_conversation_trie, op13_byte_bpe_prefix]


def _shipped(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {fn.__name__: _shipped(fn) for fn in _ALL}
