"""Conversation-level reshaping.

A conversation is the natural group: collecting its turns is bounded by the
conversation length, never by the table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivalry.operators.quantiles import exact_quantiles

ROLE_TO_FROM = {"user": "human", "assistant": "gpt"}


def conversation_messages(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) → conv_id, messages array<struct<role, content>> in turn order."""
    sorted_turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return conv.groupBy("conv_id").agg(F.transform(sorted_turns, lambda s: F.struct(
        s["role"].alias("role"), s["text"].alias("content"))).alias("messages"))


def conversation_collect(conv: DataFrame, sep: str = "\n") -> DataFrame:
    """All turns of a conversation as ``role: text`` lines, in turn order."""
    sorted_turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return conv.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(sorted_turns, lambda s: F.concat(s["role"], F.lit(": "), s["text"])), sep)
        .alias("text"))


def role_filter(conv: DataFrame) -> DataFrame:
    """F8: human / gpt turns in the nested-corpus vocabulary."""
    return conv.filter(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn", F.when(F.col("role") == "user", "human").otherwise("gpt").alias("from"),
        F.col("text").alias("value"))


def qa_pairs(conv: DataFrame) -> DataFrame:
    """K-th user turn paired with the k-th assistant turn of the same conversation."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    t = conv.filter(F.col("role").isin("user", "assistant")).withColumn("k", F.row_number().over(w).cast("bigint"))
    u = t.filter(F.col("role") == "user").select("conv_id", "k", F.col("text").alias("prompt"))
    a = t.filter(F.col("role") == "assistant").select("conv_id", "k", F.col("text").alias("response"))
    return u.join(a, ["conv_id", "k"])


def length_stats(df: DataFrame, col: str) -> DataFrame:
    """mean/min/max and exact linear-interpolated p90/p95/p99."""
    s = df.agg(F.avg(col).alias("mean_len"), F.min(col).alias("min_len"), F.max(col).alias("max_len"))
    ranks = dict(zip(("p90", "p95", "p99"), exact_quantiles(df, col, [0.9, 0.95, 0.99])))
    return s.select("*", *[F.lit(v).cast("double").alias(k) for k, v in ranks.items()])
