"""Preference formatting: chosen and rejected conversations as one prompt and two
masked completions.

The two conversations of a pair are compared turn by turn (role and text) in the
order of ``turn``; their longest common prefix of turns is rendered once as the
prompt, what follows as the two completions.  If one conversation is the whole
prefix of the other, its completion is empty.  A completion comes with a mask:
(start, length, trained) for each of its turns, in code points, where only turns
of the trained role count for the loss.

Everything is built-in functions.  A conversation's turns are gathered because
its rendered text is one value; no other grouping is made.

Defined results: null role or text count as empty; a null turn sorts first; equal
turn numbers order by role, then text; repeated rows (equal in id, turn, role and
text) count once; no turn is dropped and texts are never cut, however long; a pair with one side missing has that side empty and so an
empty prompt; rows without a pair id are left out; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, TRAINED = "<|im_start|>", "<|im_end|>\n", "assistant"


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation, its distinct turns in order."""
    t = turns.where("conv_id IS NOT NULL").select(
        "conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    return t.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))


def format_pairs(pairs: DataFrame, trained: str = TRAINED) -> DataFrame:
    """``pairs``: pair_id, chosen, rejected (arrays of struct<turn, role, text>) →
    pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    df = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    differs = F.filter(F.transform("c", lambda x, i: F.when(
        (i < F.size("r")) & (x["role"] == F.get(F.col("r"), i)["role"]) & (x["text"] == F.get(F.col("r"), i)["text"]),
        F.lit(None).cast("int")).otherwise(i)), lambda i: i.isNotNull())
    df = df.select("*", F.coalesce(F.array_min(differs), shorter).alias("k"))

    def text(turns: Column) -> Column:
        return F.array_join(F.transform(turns, render), "")

    def mask(turns: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,trained:boolean>>").alias("out"))

        def step(acc, x):
            n = F.length(render(x))
            one = F.struct(acc["at"].alias("start"), n.alias("length"), (x["role"] == trained).alias("trained"))
            return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(turns, empty, step, lambda acc: acc["out"])

    rest = {s: F.slice(F.col(s), F.col("k") + 1, F.size(s)) for s in "cr"}
    return df.select("pair_id", F.col("k").alias("n_prompt_turns"), text(F.slice("c", F.lit(1), F.col("k"))).alias("prompt"),
                     text(rest["c"]).alias("chosen"), mask(rest["c"]).alias("chosen_mask"),
                     text(rest["r"]).alias("rejected"), mask(rest["r"]).alias("rejected_mask"))


def crossed_pairs(turns: DataFrame, heads: int = 6) -> DataFrame:
    """Pairs from plain conversations, one for each: chosen is conversation c as it
    is, rejected begins with its first h turns (all if fewer), h = crc32(c) % heads,
    and goes on like conversation c + 1 after that one's first h (nothing if there
    is no such conversation or it has no more)."""
    conv = conversations(turns).withColumn("conv_id", F.col("conv_id").cast("long"))
    after = conv.select((F.col("conv_id") - 1).alias("conv_id"), F.col("turns").alias("_next"))
    df = conv.join(after, "conv_id", "left").withColumn(
        "_h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int"))
    rest = F.when(F.col("_next").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_next", F.col("_h") + 1, F.size("_next")))
    return df.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("_h")), rest).alias("rejected"))


def mask_text(mask: Column) -> Column:
    """A mask as ``start:length:1`` (trained) or ``start:length:0``, comma-joined."""
    return F.array_join(F.transform(mask, lambda x: F.concat_ws(":", x["start"], x["length"], x["trained"].cast("int"))), ",")
