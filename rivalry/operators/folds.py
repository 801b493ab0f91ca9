"""Fold assignment and fold filters.

Stratified k-fold reproduces the public allocation rule: classes sorted by
first appearance, fold ``i`` receives, from class ``c`` (rows ``off..off+n-1``
of the label-sorted order), ``floor((off+n-1-i+k)/k) - floor((off-1-i+k)/k)``
rows; inside a class, rows fill folds 0..k-1 in (shuffled) row order.  The
within-class rank uses ``ordered_index`` so one hot class is spread over many
tasks instead of one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.operators.combine import broadcast_if_small
from rivalry.operators.ordered import hex_bucket, hex_digits_for, ordered_index, running_aggregates
from rivalry.session import cut_lineage


def _shuffle_key(id_col: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_kfold(df: DataFrame, k: int, label: str = "label", id_col: str = "id",
                     shuffle: bool = True, seed: int = 42, out: str = "fold") -> DataFrame:
    """Balanced folds per class; ``shuffle`` orders rows by ``md5(seed:id)``.

    Classes may be many: their offsets (rows of the classes that appear earlier)
    are running totals over one row per class, dealt by ranges of the first id,
    and the fold bounds are joined to the rows null-safely (rows without a label
    are a class of their own).
    """
    stats = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first"))
    # written, so that the numbers of the ranges stay the same
    last = F.col("first").isNull()
    stats = cut_lineage(stats.repartitionByRange(last, "first", label).withColumn("_range", F.spark_partition_id()), "classes")
    largest, total = stats.agg(F.max("n"), F.sum("n")).first()
    stats = running_aggregates(stats, [last, "first", label], [], {"until": ("n", "sum")}, bucket=F.col("_range")).withColumn("off", (F.col("until") - F.col("n")).cast("long"))
    shares = [F.expr(f"(off + n - 1 - {i} + {k}) div {k} - (off - 1 - {i} + {k}) div {k}") for i in range(k)]
    bounds = F.array(*[sum(shares[1:i + 1], shares[0]) for i in range(k)])
    stats = stats.select(F.col(label).alias("_class"), bounds.alias("_bounds"))
    if shuffle:
        digits = hex_digits_for(largest or 0)  # ~1M rows per (class, bucket) even for a hot class
        d = df.withColumn("_key", _shuffle_key(id_col, seed))
        ranked = ordered_index(d, ["_key"], [label], bucket=hex_bucket("_key", digits), name="_r")
    else:
        ranked = ordered_index(df.withColumn("_key", F.col(id_col)), [id_col], [label], name="_r", n_rows=total or 0)
    ranked = ranked.join(broadcast_if_small(stats), F.col(label).eqNullSafe(F.col("_class")))
    fold = F.size(F.filter("_bounds", lambda x: x <= F.col("_r") - 1))
    return ranked.withColumn(out, fold.cast("int")).drop("_r", "_key", "_class", "_bounds")


def pair_stratified_kfold(df: DataFrame, k: int = 10, a: str = "model_a", b: str = "model_b",
                          id_col: str = "id", seed: int = 42, out: str = "fold") -> DataFrame:
    """Folds balanced over every ``(a, b)`` pair.

    Rank inside the pair (shuffled by ``md5(seed:id)``) plus a per-pair offset
    from ``md5(a||b)``, modulo k: each pair spreads evenly and small pairs do
    not all start at fold 0.
    """
    d = df.withColumn("_key", _shuffle_key(id_col, seed))
    digits = hex_digits_for(df.count())  # a hot pair still spreads over ~n/1M buckets
    ranked = ordered_index(d, ["_key"], [a, b], bucket=hex_bucket("_key", digits), name="_r")
    offset = F.pmod(F.conv(F.substr(F.md5(F.concat(F.col(a), F.col(b))), F.lit(1), F.lit(8)), 16, 10)
                    .cast("bigint"), F.lit(k))
    return ranked.withColumn(out, F.pmod(F.col("_r") - 1 + offset, F.lit(k)).cast("int")).drop("_r", "_key")


def dense_index_table(df: DataFrame, col: str = "model_a", order: str = "id") -> DataFrame:
    """W3 dictionary: value → 0-based index of its first appearance in ``order``.

    One row per distinct value, numbered with the bucketed ``ordered_index``
    (no single-partition window even for a large dictionary).
    """
    firsts = df.groupBy(col).agg(F.min(order).alias("_first"))
    ranked = ordered_index(firsts, ["_first", col], name="_rn")
    return ranked.select(F.col(col).alias("value"), (F.col("_rn") - 1).cast("int").alias("idx"))


def dense_index(df: DataFrame, cols=("model_a", "model_b"), source: str = "model_a",
                order: str = "id", suffix: str = "_idx") -> DataFrame:
    """Encode ``cols`` with the first-appearance dictionary of ``source``;
    a value missing from the dictionary raises an error (like ``list.index``)."""
    dic = dense_index_table(df, source, order)
    out = df
    for c in cols:
        d = dic.select(F.col("value").alias(f"_v_{c}"), F.col("idx").alias(f"{c}{suffix}"))
        out = out.join(d, out[c] == d[f"_v_{c}"], "left").drop(f"_v_{c}")
        out = out.withColumn(f"{c}{suffix}", F.when(F.col(f"{c}{suffix}").isNull() & F.col(c).isNotNull(),
                                                    F.raise_error(F.concat(F.lit("unseen value: "), F.col(c))))
                             .otherwise(F.col(f"{c}{suffix}")).cast("int"))
    return out


def fold_split(df: DataFrame, k: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, valid).  Train is ``NOT (fold <=> k)`` so rows without a fold
    (e.g. unioned synthetic data) stay in train, as pandas ``fold != k`` does."""
    f = F.col(fold)
    return df.filter(~f.eqNullSafe(k)), df.filter(f.eqNullSafe(k))
