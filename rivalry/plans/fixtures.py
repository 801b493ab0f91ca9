"""Derived input tables built from the given parquet tables.

The reference works on battle tables (conversation + two answers + winner
flags) that the test data does not ship; these views derive equivalents from
``orders``, ``conversations``, ``embeddings`` and ``events`` so every query's
work grows with the input.  Each has a DuckDB twin in ``oracle_fixtures``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.functions import templates as T
from rivalry.functions.lists import parse_list_strict
from rivalry.operators.ordered import ordered_index
from rivalry.session import table


def _logit(k, label, m: int, a: int, cls: int, mod: int):
    bonus = F.when((label == cls) & (k % mod != 0), F.lit(1.5)).otherwise(F.lit(0.0))
    return ((k * m + a) % 1000) / F.lit(500.0) - 1 + bonus


def battles_big(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric battles, one per order: models, label, two models' logits, length."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    label = (F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
             .otherwise(2)).cast("int")
    return o.select(
        k.alias("id"),
        F.concat(F.lit("m"), (ck % 20).cast("string")).alias("model_a"),
        F.concat(F.lit("m"), ((k * 7 + ck) % 23 % 20).cast("string")).alias("model_b"),
        label.alias("label"),
        (label == 0).cast("int").alias("winner_model_a"),
        (label == 1).cast("int").alias("winner_model_b"),
        (label == 2).cast("int").alias("winner_tie"),
        _logit(k, label, 37, 0, 0, 3).alias("z0"),
        _logit(k, label, 91, 13, 1, 3).alias("z1"),
        _logit(k, label, 53, 7, 2, 3).alias("z2"),
        _logit(k, label, 17, 0, 0, 4).alias("g0"),
        _logit(k, label, 71, 3, 1, 4).alias("g1"),
        _logit(k, label, 29, 11, 2, 4).alias("g2"),
        ((k * 7919) % 4096 + 1).alias("len"),
    )


def conversation_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Per conversation: user texts and assistant texts, each in turn order.

    One group per conversation: its size is the conversation length, which is
    bounded by the conversation itself, not by the table.
    """
    c = table(spark, sf, "conversations")

    def ordered(role):
        return F.transform(
            F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))),
            lambda s: s["text"])
    return c.groupBy("conv_id").agg(ordered("user").alias("prompts"), ordered("assistant").alias("answers"))


def battles_text(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-turn battles: own answers vs. the partner conversation's answers.

    Lists are serialised with ``to_json`` (as the reference stores them in
    CSV); every 11th battle gets a JSON ``null`` element in ``response_b``.
    """
    per = conversation_lists(spark, sf)
    a = per.alias("a")
    b = per.select(F.col("conv_id").alias("b_id"), F.col("answers").alias("b_answers"))
    cid = F.col("conv_id")
    partner = F.when(cid % 2 == 0, cid + 1).otherwise(cid - 1)
    j = a.join(b, partner == F.col("b_id"))
    lab = (cid * 5 + F.expr("conv_id div 3")) % 3
    resp_b = F.when(cid % 11 == 0, F.concat(F.col("b_answers"), F.array(F.lit(None).cast("string")))) \
        .otherwise(F.col("b_answers"))
    return j.select(
        cid.alias("id"),
        F.concat(F.lit("m"), (cid % 7).cast("string")).alias("model_a"),
        F.concat(F.lit("m"), ((cid * 3 + F.expr("conv_id div 7") + 1) % 7).cast("string")).alias("model_b"),
        F.to_json("prompts").alias("prompt"),
        F.to_json("answers").alias("response_a"),
        F.to_json(resp_b).alias("response_b"),
        (lab == 0).cast("int").alias("winner_model_a"),
        (lab == 1).cast("int").alias("winner_model_b"),
        (lab == 2).cast("int").alias("winner_tie"),
    )


def battles_extra(spark: SparkSession, sf: str, bt: DataFrame | None = None) -> DataFrame:
    """A second corpus: copies of every 4th battle (same text) and battles whose
    ``model_a`` was never seen in the main corpus."""
    bt = bt if bt is not None else battles_text(spark, sf)
    dup = bt.filter(F.col("id") % 4 == 0)
    unseen = bt.filter(F.col("id") % 4 == 1).withColumn("model_a", F.concat(F.lit("new-"), F.col("model_a")))
    return dup.unionByName(unseen).withColumn("id", F.col("id") + 1000000)


def battles_synth(spark: SparkSession, sf: str, bt: DataFrame | None = None) -> DataFrame:
    """Synthetic battles: only prompt, answers, label and a string id (no flags, models, fold)."""
    bt = (bt if bt is not None else battles_text(spark, sf)).filter(F.col("id") % 3 == 0)
    return bt.select(
        "prompt", "response_a", "response_b",
        (F.when(F.col("winner_model_a") == 1, 0).when(F.col("winner_model_b") == 1, 1).otherwise(2))
        .cast("int").alias("label"),
        F.concat(F.lit("syn-"), F.col("id").cast("string")).alias("id"))


def parsed_battles(spark: SparkSession, sf: str) -> DataFrame:
    """battles_text with label and strictly parsed lists."""
    from rivalry.operators.labels import label_from_flags
    bt = label_from_flags(battles_text(spark, sf))
    return bt.select("id", "model_a", "model_b", "label",
                     parse_list_strict("prompt").alias("p"),
                     parse_list_strict("response_a").alias("a"),
                     parse_list_strict("response_b").alias("b"))


def retrieval_corpus(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.filter(F.col("vec_id") % 5 != 0).select(F.col("vec_id").alias("id"), "embedding")


def retrieval_queries(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.filter(F.col("vec_id") % 5 == 0).select(F.col("vec_id").alias("q_id"), "embedding")


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Pooling fixture: one sequence per embedding label, positions by vec_id, a pad mask."""
    e = table(spark, sf, "embeddings")
    seq = ordered_index(e.select("vec_id", "label", "embedding"), ["vec_id"], ["label"], name="pos")
    return seq.select(F.col("label").alias("seq_id"), "pos", "vec_id", "embedding",
                      (F.col("vec_id") % 7 != 0).cast("int").alias("mask"))


def metrics_log(spark: SparkSession, sf: str) -> DataFrame:
    """Training-metrics log: (fold, epoch, step, loss, lr) from ``events``."""
    ev = table(spark, sf, "events")
    return ev.select(
        (F.col("user_id") % 4).cast("int").alias("fold"),
        (F.dayofmonth("ts") % 3).cast("int").alias("epoch"),
        F.col("event_id").alias("step"),
        F.col("value").alias("loss"),
        (F.lit(1e-4) / (1 + F.dayofmonth("ts") % 3)).alias("lr"),
    )


def result_content(p, a, b, drop_first_b):
    """Model output wrapping every zipped turn in tags; ``drop_first_b`` omits the
    first turn's ``<response_b>`` block (a malformed answer)."""
    p, a, b = F.col(p), F.col(a), F.col(b)
    idx = F.array_repeat(F.lit(0), T.n_turns(p, a, b))

    def block(_x, i):
        tail = F.when(drop_first_b & (i == 0), F.lit("")).otherwise(
            F.concat(F.lit("<response_b>"), F.get(b, i), F.lit("</response_b>\n")))
        return F.concat(F.lit("<prompt>"), F.get(p, i), F.lit("</prompt>\n<response_a>"), F.get(a, i),
                        F.lit("</response_a>\n"), tail)
    return F.array_join(F.transform(idx, block), "")


def results_table(spark: SparkSession, sf: str) -> DataFrame:
    """Batch-API results as rows (custom_id, content, usage) before serialisation."""
    pb = parsed_battles(spark, sf)
    r = pb.select(
        F.concat(F.lit("request-"), F.col("id").cast("string")).alias("custom_id"),
        F.col("id"),
        result_content("p", "a", "b", F.col("id") % 10 == 0).alias("content"))
    return r.withColumns({"prompt_tokens": (200 + F.col("id") % 50).cast("long"),
                          "completion_tokens": F.floor(F.length("content") / 4).cast("long")})


def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval result: one row per prompt occurrence (``row`` orders them), with
    its own sample prompt/response and similarity, so a repeated prompt has
    several differing rows.  A prompt whose md5 starts with c-f is stored under an
    altered key: its lookups miss."""
    pb = parsed_battles(spark, sf)
    d = pb.select("id", F.posexplode("p").alias("pos", "prompt"))
    d = d.withColumn("row", F.col("id").cast("long") * 1024 + F.col("pos"))
    h = F.md5(F.concat("prompt", F.lit(":"), F.col("row").cast("string")))
    miss = F.substr(F.md5("prompt"), F.lit(1), F.lit(1)) >= "c"
    return d.select(
        F.when(miss, F.concat("prompt", F.lit(" #"))).otherwise(F.col("prompt")).alias("prompt"),
        F.concat(F.lit("Sample: "), F.col("prompt")).alias("similar_prompt"),
        F.concat(F.lit("Ideal answer "), F.substr(h, F.lit(3), F.lit(6))).alias("similar_response"),
        (F.conv(F.substr(h, F.lit(2), F.lit(2)), 16, 10).cast("int") / F.lit(255.0)).alias("similarity"), "row")
