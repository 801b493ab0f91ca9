"""Ordered analytics over a training-metrics log (W5-W7) and row ordering.

All per-series ordering uses the bucketed ``ordered_index`` /
``running_aggregates`` helpers, so a series holding a third of the log is
still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivalry.operators.ordered import (BUCKET, buckets_for, hex_bucket, hex_digits_for, ordered_index,
                                      running_aggregates, with_range_bucket)


def running_mean(df: DataFrame, value: str, order: str, by=(), out: str = "running_loss") -> DataFrame:
    """Running mean of ``value`` per series in ``order``."""
    r = running_aggregates(df, [order], list(by), {"_s": (value, "sum"), "_n": (value, "count")})
    return r.withColumn(out, F.col("_s") / F.col("_n")).drop("_s", "_n")


def best_checkpoint(df: DataFrame, score: str, epoch: str, by=()) -> DataFrame:
    """Per series, the epoch score, the best score so far and whether this
    epoch improved on every earlier one.  Input is the per-epoch aggregate
    (one row per series and epoch)."""
    w = Window.partitionBy(*by).orderBy(epoch)
    prev_best = F.min(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.select(*by, epoch, score, F.min(score).over(w.rowsBetween(Window.unboundedPreceding, 0))
                     .alias("best_so_far"), (prev_best.isNull() | (F.col(score) < prev_best)).alias("improved"))


def early_stop(df: DataFrame, value: str, order: str, by=(), patience: int = 50) -> DataFrame:
    """Per series, the first round with ``patience`` rounds without a new
    minimum, and the best round/value at that point (or at the end).

    Rounds are 1-based positions in ``order``.  The best round as of round r
    is the first round reaching the running minimum.  Each running minimum
    reigns over one range of rounds, so a grouped aggregate per (series,
    running minimum) and one per series give the stop: no row-level join.
    """
    by = list(by)
    # one approximate-quantile pass gives the range buckets for both helpers
    d = with_range_bucket(df, order, buckets_for(df.count())).withColumnRenamed(BUCKET, "_b0")
    d = ordered_index(d, [order], by, bucket=F.col("_b0"), name="round")
    d = running_aggregates(d, [order], by, {"_m": (value, "min")}, bucket=F.col("_b0")).drop("_b0")
    # the rounds that set a new minimum, at most one row per (series, value): where the running minimum starts
    first_at = d.where(F.col("_m").isNotNull()).groupBy(*by, "_m").agg(F.min("round").alias("best_round"), F.max("round").alias("_until"))
    # as of the last round of its reign, a minimum has gone (_until - best_round) rounds without a new one
    stops = F.when(F.col("_until") - F.col("best_round") >= patience, F.col("best_round") + patience)
    end = F.struct(F.coalesce(stops, F.lit(1 << 60)).alias("at"), (-F.col("_until")).alias("last"),
                   F.col("best_round"), F.col("_m").alias("best_value"), stops.alias("stop_round"))
    return first_at.groupBy(*by).agg(F.min(end).alias("e")).select(*by, "e.stop_round", "e.best_round", "e.best_value")


def head_n(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """L1: first ``n`` rows in ``order`` (top-k per task, then merged)."""
    return df.orderBy(order).limit(n)


def slice_rows(df: DataFrame, start: int, stop: int, order: str = "id") -> DataFrame:
    """L2: rows ``start..stop-1`` in ``order`` (``iloc[start:stop]``)."""
    return df.orderBy(order).offset(start).limit(stop - start)


def half_split(df: DataFrame, order: str = "id", parts: int = 2, out: str = "half") -> DataFrame:
    """Consecutive ordered ranges cut at ``i * n // parts`` (``iloc[:n//2]``, ``iloc[n//2:]``)."""
    n = df.count()
    d = ordered_index(df, [order], name="_rn", n_rows=n)
    cuts = F.array(*[F.lit(i * n // parts) for i in range(1, parts)])
    return d.withColumn(out, F.size(F.filter(cuts, lambda b: F.col("_rn") > b)).cast("int")).drop("_rn")


def length_sort_batches(df: DataFrame, length: str, key: str, size: int = 8, out: str = "batch") -> DataFrame:
    """Batches of ``size`` rows in descending-length order (ties by key).

    Rows are numbered by key inside each length, in ranges of the key, so one
    length holding most rows still spreads; each length then starts where the
    longer ones end."""
    d = df.withColumn("_neg", -F.col(length))
    counts = d.groupBy("_neg").agg(F.count(F.lit(1)).alias("_c"))
    before = running_aggregates(counts, ["_neg"], [], {"_cum": ("_c", "sum")})
    before = before.select(F.col("_neg").alias("_len"), (F.col("_cum") - F.col("_c")).alias("_before"))
    d = ordered_index(d, [key], ["_neg"], name="_in")
    d = d.join(before, F.col("_neg").eqNullSafe(F.col("_len")))
    return d.withColumn(out, F.floor((F.col("_before") + F.col("_in") - 1) / size).cast("long")).drop("_in", "_neg", "_len", "_before")


def shuffle_rows(df: DataFrame, key: str = "id", seed: int = 42, out: str = "rn") -> DataFrame:
    """A repeatable random order: rank by ``md5(seed:key)``."""
    d = df.withColumn("_k", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return ordered_index(d, ["_k"], bucket=hex_bucket("_k", hex_digits_for(df.count())), name=out).drop("_k")


def pad_and_mask(df: DataFrame, tokens: str, batch: str, multiple: int = 8, pad: str = "<pad>",
                 out: str = "padded", mask: str = "attention_mask") -> DataFrame:
    """Right-pad every row's tokens to its batch's longest row, rounded up
    to a multiple of ``multiple``; the mask is 1 for real tokens, 0 for pads.
    Batches are small fixed-size groups, so the per-batch max is a window over
    a handful of rows."""
    n = F.size(tokens)
    longest = F.max(n).over(Window.partitionBy(batch))
    target = (F.ceil(longest / multiple) * multiple).cast("int")
    d = df.withColumn("_target", target)
    fill = F.col("_target") - F.size(tokens)
    return (d.withColumn(out, F.concat(F.col(tokens), F.array_repeat(F.lit(pad), fill)))
             .withColumn(mask, F.concat(F.array_repeat(F.lit(1), F.size(tokens)), F.array_repeat(F.lit(0), fill)))
             .drop("_target"))
