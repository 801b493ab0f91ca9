"""Unions, dedup and joins between corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.operators.labels import common_columns


def union_missing_columns(*dfs: DataFrame) -> DataFrame:
    """Concat with different schemas; missing columns become NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def union_common_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concat on the shared columns only (a's column order)."""
    cols = common_columns(a, b)
    return a.select(*cols).unionByName(b.select(*cols))


def dedup_keep_first(df: DataFrame, key: str, order: list[str], plain: DataFrame | None = None) -> DataFrame:
    """U4: one row per ``key``, the first in ``order`` (e.g. source rank, then id).

    ``order`` must make rows unique.  The aggregate holds only the key's SHA-256
    and the order columns (a key repeated a million times is reduced on the map
    side); the winners' order columns alone then pick their rows, so keys are
    hashed once and are in no grouping, sort or buffer.  ``plain``: the same rows
    with only the key and order columns, when they can be read without computing
    the rest of ``df``.
    """
    digest = F.sha2(F.col(key).cast("string"), 256)
    first = (df if plain is None else plain).groupBy(digest.alias("_k")).agg(F.min(F.struct(*order)).alias("_o"))
    first = first.select(*[F.col(f"_o.{c}").alias(f"_o_{c}") for c in order])
    match = F.lit(True)
    for c in order:
        match = match & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return df.join(first, match, "left_semi")


CHECKED_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = CHECKED_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted, at
    most one row beyond); otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def semi_join_models(df: DataFrame, ref: DataFrame, a: str = "model_a", b: str = "model_b") -> DataFrame:
    """Keep rows whose ``a`` is among ref's ``a`` values AND ``b`` among ref's ``b``
    values (two independent sets, not the pair).  The sets are distinct model
    names, broadcast when counted small, so the wide rows of ``df`` are not
    shuffled by a few hot names; left-semi joins never duplicate rows."""
    sa = broadcast_if_small(ref.select(F.col(a).alias("_a")).distinct())
    sb = broadcast_if_small(ref.select(F.col(b).alias("_b")).distinct())
    return (df.join(sa, F.col(a) == F.col("_a"), "left_semi")
              .join(sb, F.col(b) == F.col("_b"), "left_semi"))


def lookup_last_wins(lookup: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """J3 dictionary: key → value of the row with the largest ``pos`` (dict(zip) semantics)."""
    return lookup.groupBy(key).agg(F.max_by(value, pos).alias(value))


def left_join_lookup(df: DataFrame, lookup: DataFrame, left_key: str, key: str, value: str,
                     pos: str, out: str | None = None) -> DataFrame:
    """``df[left_key].map(dict)``; a miss is NULL."""
    d = lookup_last_wins(lookup, key, value, pos).select(F.col(key).alias("_lk"),
                                                         F.col(value).alias(out or value))
    return df.join(d, F.col(left_key) == F.col("_lk"), "left").drop("_lk")


def left_join_predictions(df: DataFrame, preds: DataFrame, key: str = "id") -> DataFrame:
    """Equi left join on a string id (both sides cast)."""
    p = preds.withColumn(key, F.col(key).cast("string"))
    return df.withColumn(key, F.col(key).cast("string")).join(p, key, "left")


def result_row_join(results: DataFrame, source: DataFrame, id_col: str = "id",
                    custom_id: str = "custom_id") -> DataFrame:
    """``request-{i}`` → source row ``i`` (recover the label)."""
    rid = F.split(F.col(custom_id), "-").getItem(1).cast("bigint")
    return results.withColumn("_rid", rid).join(source, F.col("_rid") == source[id_col]).drop("_rid")
