"""Evaluation metrics as single aggregations (A2-A4, A7-A9, A25, U6, ML9).

Every metric is an ``agg`` over per-row expressions, so it runs as one
partial/final aggregation with no shuffle of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.functions import probs
from rivalry.functions.vectors import cosine
from rivalry.operators.ordered import ordered_index


def with_probs(df: DataFrame, zs=("z0", "z1", "z2"), out=("A", "B", "tie"), temperature=None) -> DataFrame:
    """Softmax of logit columns into probability columns."""
    ps = probs.softmax(*zs, temperature=temperature)
    return df.withColumns(dict(zip(out, ps)))


def with_row_loss(df: DataFrame, label: str = "label", ps=("A", "B", "tie"), out: str = "log_loss") -> DataFrame:
    """Per-row log loss and perplexity ``e ** loss``."""
    d = df.withColumn(out, probs.row_log_loss(label, *ps))
    return d.withColumn("perplexity", F.exp(out))


def log_loss(df: DataFrame, label: str = "label", ps=("A", "B", "tie"), by=()) -> DataFrame:
    """A2: mean multiclass log loss (clip + row renormalisation)."""
    return df.groupBy(*by).agg(F.avg(probs.row_log_loss(label, *ps)).alias("log_loss"))


def accuracy(df: DataFrame, label: str = "label", ps=("A", "B", "tie")) -> DataFrame:
    """A3: share of rows whose first-maximum class equals the label."""
    return df.agg(F.avg((probs.argmax(*ps) == F.col(label)).cast("double")).alias("accuracy"))


def balanced_accuracy(df: DataFrame, label: str = "label", ps=("A", "B", "tie")) -> DataFrame:
    """A4: mean over present classes of per-class recall (two-level aggregate)."""
    per = df.groupBy(label).agg(F.avg((probs.argmax(*ps) == F.col(label)).cast("double")).alias("recall"))
    return per.agg(F.avg("recall").alias("balanced_accuracy"))


def eval_metrics(df: DataFrame, label: str = "label", ps=("A", "B", "tie")) -> DataFrame:
    """ML9: log loss, accuracy and balanced accuracy from one pass over the rows
    (per-class partial sums, then a tiny second aggregate)."""
    hit = (probs.argmax(*ps) == F.col(label)).cast("double")
    per = df.groupBy(label).agg(F.sum(probs.row_log_loss(label, *ps)).alias("_ll"), F.sum(hit).alias("_hit"),
                                F.count(F.lit(1)).alias("_n"))
    return per.agg((F.sum("_ll") / F.sum("_n")).alias("log_loss"), (F.sum("_hit") / F.sum("_n")).alias("accuracy"),
                   F.avg(F.col("_hit") / F.col("_n")).alias("balanced_accuracy"))


def weighted_cross_entropy(df: DataFrame, weights: DataFrame, label: str = "label", zs=("z0", "z1", "z2")) -> DataFrame:
    """``Σ w_y·ce / Σ w_y`` with per-class weights.

    The weight table has one row per class and is joined: AQE broadcasts it when
    it measures small, and splits a hot class otherwise."""
    w = weights.select(F.col(label).alias("_class"), F.col("weight").cast("double").alias("_w"))
    d = df.join(w, F.col(label) == F.col("_class"))
    return d.agg((F.sum(F.col("_w") * probs.cross_entropy(label, *zs)) / F.sum("_w")).alias("weighted_ce"))


def label_smoothing_ce(df: DataFrame, label: str = "label", zs=("z0", "z1", "z2"), smoothing: float = 0.1) -> DataFrame:
    """Mean label-smoothed cross entropy."""
    return df.agg(F.avg(probs.smoothed_cross_entropy(label, *zs, smoothing=smoothing)).alias("smoothed_ce"))


def cosine_embedding_loss(df: DataFrame, h: str, e: str) -> DataFrame:
    """``mean(1 - cos(h, e))``."""
    return df.agg(F.avg(1 - cosine(h, e)).alias("cos_loss"))


def oof_report(df: DataFrame, fold: str = "fold", label: str = "label", ps=("A", "B", "tie")) -> DataFrame:
    """Per-fold and overall (fold NULL) log loss in one ``rollup``."""
    return df.rollup(fold).agg(F.count(F.lit(1)).alias("n"),
                               F.avg(probs.row_log_loss(label, *ps)).alias("log_loss"))


def mean_of_batch_means(df: DataFrame, value: str, order: str, by=(), batch_size: int = 8) -> DataFrame:
    """Mean over fixed-size batches (in ``order``) of the batch mean.

    Batch ids come from the skew-safe ``ordered_index``; both levels are
    plain aggregations.
    """
    d = ordered_index(df, [order], list(by), name="_rn")
    d = d.withColumn("_batch", F.floor((F.col("_rn") - 1) / batch_size))
    per = d.groupBy(*by, "_batch").agg(F.avg(value).alias("_m"))
    return per.groupBy(*by).agg(F.avg("_m").alias("loss"), F.count(F.lit(1)).alias("n_batches"))
