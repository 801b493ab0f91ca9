"""Sequence pooling over rows of vectors.

A sequence is a group of rows ``(seq_id, pos, vector, mask)``.  Element-wise
sums go through ``posexplode`` + ``groupBy(seq, dim)`` — partial aggregation
over (sequence, dimension) cells — and the pooled vector is re-assembled
from at most ``dim`` values per sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.functions.vectors import dot
from rivalry.operators.ordered import running_aggregates


def _assemble(df: DataFrame, seq: str, dim_col: str, val_col: str, out: str) -> DataFrame:
    return df.groupBy(seq).agg(F.transform(F.array_sort(F.collect_list(F.struct(dim_col, val_col))),
                                           lambda s: s[val_col]).alias(out))


def mean_pool(df: DataFrame, seq: str = "seq_id", vec: str = "embedding", mask: str = "mask",
              out: str = "pooled", eps: float = 1e-9) -> DataFrame:
    """``Σ mask·x / max(Σ mask, eps)`` per dimension."""
    ex = df.select(seq, F.col(mask).cast("double").alias("_m"), F.posexplode(vec).alias("_d", "_x"))
    agg = ex.groupBy(seq, "_d").agg((F.sum(F.col("_x") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(eps)))
                                    .alias("_v"))
    return _assemble(agg, seq, "_d", "_v", out)


def attention_pool(df: DataFrame, weights: list[float], seq: str = "seq_id", vec: str = "embedding",
                   mask: str = "mask", out: str = "pooled") -> DataFrame:
    """Softmax over the sequence of ``score = x·w`` (masked rows excluded),
    then the weighted sum of vectors.  The per-sequence max comes from a
    grouped aggregate joined back (one row per sequence)."""
    d = df.filter(F.col(mask) == 1).withColumn("_s", dot(vec, F.array(*[F.lit(w) for w in weights])))
    mx = d.groupBy(seq).agg(F.max("_s").alias("_mx"))
    d = d.join(mx, seq).withColumn("_a", F.exp(F.col("_s") - F.col("_mx")))
    ex = d.select(seq, "_a", F.posexplode(vec).alias("_d", "_x"))
    agg = ex.groupBy(seq, "_d").agg((F.sum(F.col("_a") * F.col("_x")) / F.sum("_a")).alias("_v"))
    return _assemble(agg, seq, "_d", "_v", out)


def last_token_pool(df: DataFrame, seq: str = "seq_id", pos: str = "pos", mask: str = "mask",
                    cols=("vec_id", "embedding")) -> DataFrame:
    """The last non-padded element of each sequence (``max_by`` on position)."""
    packed = F.struct(*cols)
    return (df.filter(F.col(mask) == 1).groupBy(seq).agg(F.max_by(packed, pos).alias("_r"))
            .select(seq, "_r.*"))


def first_token_pool(df: DataFrame, seq: str = "seq_id", pos: str = "pos", cols=("vec_id", "embedding")) -> DataFrame:
    """The first element (CLS) of each sequence."""
    packed = F.struct(*cols)
    return df.groupBy(seq).agg(F.min_by(packed, pos).alias("_r")).select(seq, "_r.*")


def position_ids(df: DataFrame, seq: str = "seq_id", pos: str = "pos", mask: str = "mask",
                 out: str = "position_id") -> DataFrame:
    """``cumsum(mask) - 1``, and 1 where the row is padding."""
    r = running_aggregates(df, [pos], [seq], {"_cs": (mask, "sum")})
    return r.withColumn(out, F.when(F.col(mask) == 0, F.lit(1)).otherwise(F.col("_cs") - 1).cast("long")).drop("_cs")
