"""Pair win-rate priors.

The reference scans the battle table once per model pair with an OR
predicate.  Here every battle is keyed by its *canonical* unordered pair
``(least(a,b), greatest(a,b))`` and one ``groupBy`` with partial aggregation
produces every pair at once — a hot pair is pre-aggregated on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.functions import probs


def canonical_pair(df: DataFrame, a: str = "model_a", b: str = "model_b") -> DataFrame:
    return df.withColumns({"m0": F.least(a, b), "m1": F.greatest(a, b)})


def pair_win_counts(df: DataFrame, label: str = "label", a: str = "model_a", b: str = "model_b") -> DataFrame:
    """A1: per unordered pair ``[1 + wins of m0, 1 + wins of m1, 1 + ties]``.

    Self-battles are skipped (pairs are 2-combinations of distinct models) and
    only pairs with at least one battle are returned (F7, ``sum > 3``).
    """
    c = canonical_pair(df.filter(F.col(a) != F.col(b)), a, b)
    lab = F.col(label)
    winner = F.when(lab == 0, F.col(a)).when(lab == 1, F.col(b))
    return c.groupBy("m0", "m1").agg(
        (1 + F.count_if(winner == F.col("m0"))).alias("w0"),
        (1 + F.count_if(winner == F.col("m1"))).alias("w1"),
        (1 + F.count_if(lab == 2)).alias("wt"),
    )


def pair_battle_counts(df: DataFrame, a: str = "model_a", b: str = "model_b") -> DataFrame:
    """J11 re-aimed: battles per unordered pair in both orientations, one pass."""
    c = canonical_pair(df.filter(F.col(a) != F.col(b)), a, b)
    return c.groupBy("m0", "m1").agg(
        F.count_if(F.col(a) == F.col("m0")).alias("n_ab"),
        F.count_if(F.col(a) == F.col("m1")).alias("n_ba"),
        F.count(F.lit(1)).alias("n"),
    )


def distinct_models(df: DataFrame, a: str = "model_a", b: str = "model_b") -> DataFrame:
    """Unique values of the union of two columns."""
    return df.select(F.col(a).alias("model")).union(df.select(F.col(b).alias("model"))).distinct()


def model_pair_combinations(df: DataFrame, a: str = "model_a", b: str = "model_b") -> DataFrame:
    """All 2-combinations ``m0 < m1`` of distinct models.

    The output is quadratic in the number of *models* (that is the operator),
    not in battles.  No nested-loop join: models are numbered (in hash order,
    skew-safe ``ordered_index``), each index expands to its larger partner
    indices and an equi-join on the partner index attaches the second model;
    the pair is then written name-ordered.
    """
    from rivalry.operators.ordered import ordered_index
    m = distinct_models(df, a, b).withColumn("_h", F.xxhash64("model"))
    r = ordered_index(m, ["_h", "model"], name="_i")
    n = r.count()
    x = (r.filter(F.col("_i") < n).select(F.col("model").alias("_x"), "_i")
         .withColumn("_j", F.explode(F.sequence(F.col("_i") + 1, F.lit(n)))))
    y = r.select(F.col("model").alias("_y"), F.col("_i").alias("_j"))
    return x.join(y, "_j").select(F.least("_x", "_y").alias("m0"), F.greatest("_x", "_y").alias("m1"))


def pair_prior_join(pred: DataFrame, priors: DataFrame, a: str = "model_a", b: str = "model_b") -> DataFrame:
    """Attach ``[w_a, w_b, w_tie]`` oriented to the row's (model_a, model_b).

    Priors are stored once per unordered pair; a row whose ``model_a`` is the
    larger name gets the first two weights swapped.  Rows without a prior get
    ``[1, 1, 1]`` (no adjustment).  The priors table has one row per model
    pair, so AQE broadcasts it once measured.
    """
    p = priors.select(F.col("m0").alias("_m0"), F.col("m1").alias("_m1"), "w0", "w1", "wt")
    j = pred.join(p, (F.least(a, b) == F.col("_m0")) & (F.greatest(a, b) == F.col("_m1")), "left")
    rev = F.col(a) > F.col(b)
    return j.select(
        *pred.columns,
        F.coalesce(F.when(rev, F.col("w1")).otherwise(F.col("w0")), F.lit(1)).cast("double").alias("wa"),
        F.coalesce(F.when(rev, F.col("w0")).otherwise(F.col("w1")), F.lit(1)).cast("double").alias("wb"),
        F.coalesce(F.col("wt"), F.lit(1)).cast("double").alias("wtie"),
    )


def prior_adjust(df: DataFrame, ps=("A", "B", "tie"), ws=("wa", "wb", "wtie"), suffix: str = "_adj") -> DataFrame:
    """``p·w`` rescaled to the original probability total."""
    adj = probs.prior_adjust(list(ps), list(ws))
    return df.withColumns({f"{p}{suffix}": c for p, c in zip(ps, adj)})
