"""Retrieval context injection.

Each prompt turn is looked up in a retrieval table keyed by prompt text
(``posexplode`` → left join); the per-battle context list is regrouped in
turn order (bounded by the battle's own turns) and rendered next to the
turns whose similarity passes the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.functions import templates as T

THRESHOLD = 0.75


def last_per_prompt(ctx: DataFrame, order: str = "row") -> DataFrame:
    """The retrieval table as a lookup: of several rows for one prompt the last
    in ``order`` counts (dictionary semantics).  A partial aggregate: a prompt
    asked a million times is reduced on the map side."""
    last = F.max_by(F.struct("similar_prompt", "similar_response", "similarity"), F.col(order))
    return ctx.groupBy("prompt").agg(last.alias("_last")).select("prompt", "_last.*")


def context_lookup(battles: DataFrame, ctx: DataFrame, prompts: str = "p", key: str = "id",
                   order: str = "row") -> DataFrame:
    """(id, pos, prompt) → retrieval row; a miss keeps the turn with NULL context.

    ``ctx`` may hold a prompt more than once when it has an ``order`` column:
    the last row counts.  Without one its prompts must be distinct.  Joined on
    ``xxhash64(prompt)`` and the prompt itself so long texts compare by hash first.
    """
    if order in ctx.columns:
        ctx = last_per_prompt(ctx, order)
    ex = battles.select(key, F.posexplode(prompts).alias("pos", "prompt")).withColumn("_h", F.xxhash64("prompt"))
    c = ctx.select(F.xxhash64("prompt").alias("_h"), F.col("prompt").alias("_cp"), "similar_prompt",
                   "similar_response", "similarity")
    j = ex.join(c, (ex["_h"] == c["_h"]) & (ex["prompt"] == c["_cp"]), "left")
    return j.select(key, "pos", "prompt", F.col("_cp").isNotNull().alias("hit"), "similar_prompt",
                    "similar_response", "similarity")


def with_context_flag(df: DataFrame, sim: str = "similarity", threshold: float = THRESHOLD) -> DataFrame:
    """use the context only when similarity > threshold."""
    return df.withColumn("use_context", F.coalesce(F.col(sim) > threshold, F.lit(False)))


def inject_context(battles: DataFrame, ctx: DataFrame, threshold: float = THRESHOLD, key: str = "id") -> DataFrame:
    """Hash-block prompt text with sample prompt/response blocks after
    qualifying turns; counts of turns without a retrieval row and of added
    blocks.  Returns (id, text, n_missing, n_added)."""
    look = context_lookup(battles, ctx, key=key)
    per = look.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "pos", "hit", "similarity", "similar_prompt", "similar_response"))).alias("_ctx"))
    d = battles.join(per, key, "left").withColumn("_ctx", F.coalesce("_ctx", F.array()))
    p, a, b, c = F.col("p"), F.col("a"), F.col("b"), F.col("_ctx")
    n = T.n_turns(p, a, b)

    def block(_x, i):
        ci = F.get(c, i)
        use = F.coalesce(ci["similarity"] > threshold, F.lit(False))
        extra = F.when(use, F.concat(F.lit(T.CONTEXT_BLOCK[0]), ci["similar_prompt"], F.lit(T.CONTEXT_BLOCK[1]),
                                     ci["similar_response"], F.lit(T.CONTEXT_BLOCK[2]))).otherwise(F.lit(""))
        return F.concat(F.lit(T.HASH_BLOCK[0]), F.get(p, i), F.lit(T.HASH_BLOCK[1]), F.get(a, i),
                        F.lit(T.HASH_BLOCK[2]), F.get(b, i), extra)
    body = F.array_join(F.transform(F.array_repeat(F.lit(0), n), block), "")
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(T.CONTEXT_HEADER), body).alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.lit("[RESULT]: ").alias("content")))
    zipped = F.slice(c, 1, n)
    return d.select(key, T.chat_template(msgs, "llama3").alias("text"),
                    F.size(F.filter(zipped, lambda x: ~x["hit"])).cast("bigint").alias("n_missing"),
                    F.size(F.filter(zipped, lambda x: F.coalesce(x["similarity"] > threshold, F.lit(False))))
                    .cast("bigint").alias("n_added"))
