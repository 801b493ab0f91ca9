"""Skew-safe ordered analytics: row numbers and running aggregates.

A plain ``row_number() over (partition by label order by id)`` puts every row
of one label into one task; with three labels (or one hot key holding a third
of the data) that does not scale.  Instead every ordered operator here runs in
three steps:

1. give each row a *bucket* that is monotone in the sort order
   (hex prefix of an md5 key, or approximate-quantile ranges of a numeric key);
2. aggregate per ``(partition, bucket)`` — partial aggregation, a tiny table of
   at most ``|partitions| x n_buckets`` rows — and turn it into per-bucket
   offsets with a window over that tiny table;
3. number / accumulate rows inside ``(partition, bucket)`` and add the offset.

The offsets join back to the rows on ``(partition, bucket)``; AQE turns it into
a broadcast join once the aggregated stage is measured small, and keeps the
shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bkt"
ROWS_PER_BUCKET = 1_000_000   # target rows per (partition, bucket) window task
MIN_BUCKETS, MAX_RANGE_BUCKETS = 64, 1 << 17
LITERAL_OFFSETS = 4096        # global offsets up to this many buckets are inlined as literals


def buckets_for(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Range-bucket count so that a bucket holds about ``rows_per_bucket`` rows."""
    return int(min(MAX_RANGE_BUCKETS, max(MIN_BUCKETS, -(-n_rows // rows_per_bucket))))


def hex_digits_for(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """md5-prefix length (16**digits buckets) for about ``rows_per_bucket`` rows per bucket."""
    want, digits = max(1, -(-n_rows // rows_per_bucket)), 2
    while 16 ** digits < want and digits < 5:
        digits += 1
    return max(3, digits)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        e = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = e if cond is None else cond & e
    out = left.join(r, cond, how)
    return out.drop(*[f"_r_{k}" for k in keys])


def hex_bucket(hex_col, digits: int = 3) -> Column:
    """Bucket = integer value of the first ``digits`` hex characters (16**digits buckets)."""
    c = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return F.conv(F.substr(c, F.lit(1), F.lit(digits)), 16, 10).cast("int")


def with_range_bucket(df: DataFrame, col: str, n_buckets: int = 256, rel_error: float | None = None) -> DataFrame:
    """Add ``_bkt``: approximate-quantile range of numeric ``col`` (monotone in ``col``).

    The split points come from one ``approxQuantile`` pass (a bounded sketch, no
    sort), precise to a quarter of a bucket, and are applied by ``Bucketizer``
    (binary search in the JVM).  Nulls sort first and get their own bucket -1.
    """
    rel_error = rel_error or 1 / (4 * n_buckets)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    edges = df.approxQuantile(col, probs, rel_error) if n_buckets > 1 else []
    splits = [float("-inf")] + sorted({float(e) for e in edges if e is not None}) + [float("inf")]
    tmp = "_bkt_in"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=BUCKET, handleInvalid="keep")
    out = b.transform(df.withColumn(tmp, F.col(col).cast("double")))
    return out.withColumn(BUCKET, F.when(F.col(col).isNull(), -1).otherwise(F.col(BUCKET).cast("int"))).drop(tmp)


def _bucketed(df: DataFrame, order_cols: list, bucket, n_rows: int | None = None) -> DataFrame:
    if bucket is None:
        first = order_cols[0]
        if not isinstance(first, str):
            raise ValueError("give a bucket column when ordering by an expression")
        n = n_rows if n_rows is not None else df.select(first).count()
        return with_range_bucket(df, first, buckets_for(n))
    return df.withColumn(BUCKET, bucket)


def _order(order_cols):
    return [F.col(c) if isinstance(c, str) else c for c in order_cols]


def ordered_index(df: DataFrame, order_cols: list, partition_cols: list | tuple = (),
                  bucket: Column | None = None, name: str = "rn", n_rows: int | None = None) -> DataFrame:
    """Add a 1-based row number per ``partition_cols`` in ``order_cols`` order.

    ``bucket`` must be non-decreasing in the order (e.g. ``hex_bucket(md5)``
    when ordering by that md5); by default numeric quantile buckets of the
    first order column are used.  Order columns must make rows unique.
    The offsets table is joined; AQE broadcasts it only when it measures small.
    Range buckets are sized from the row count (``n_rows``,
    counted when not given) to about ``ROWS_PER_BUCKET`` rows each.
    """
    part = list(partition_cols)
    d = _bucketed(df, order_cols, bucket, n_rows)
    counts = d.groupBy(*part, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    offs = _global_offsets(counts, {"_n": "sum"}) if not part else None
    if offs is not None:
        # global numbering with few buckets: inline the prefix offsets as a literal map
        d = d.withColumn("_off", F.coalesce(F.element_at(offs["_n"], F.col(BUCKET)), F.lit(0)))
    else:
        w = Window.partitionBy(*part).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*part, BUCKET, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
        d = _null_safe_join(d, offsets, part + [BUCKET])
    wi = Window.partitionBy(*part, BUCKET).orderBy(*_order(order_cols))
    return d.withColumn(name, (F.row_number().over(wi) + F.col("_off")).cast("long")).drop("_off", BUCKET)


def _global_offsets(per_bucket: DataFrame, kinds: dict[str, str]) -> dict | None:
    """Exclusive prefix aggregates over buckets as literal maps bucket → value,
    or ``None`` when there are more than ``LITERAL_OFFSETS`` non-empty buckets
    (the caller then joins a broadcast offsets table instead)."""
    rows = per_bucket.limit(LITERAL_OFFSETS + 1).collect()
    if len(rows) > LITERAL_OFFSETS:
        return None
    rows.sort(key=lambda r: r[BUCKET])
    out = {}
    for col, kind in kinds.items():
        acc, pairs = None, []
        for r in rows:
            pairs.append((r[BUCKET], acc))
            v = r[col]
            if v is None:
                continue
            acc = v if acc is None else (acc + v if kind in ("sum", "count") else
                                         min(acc, v) if kind == "min" else max(acc, v))
        lits = [x for b, a in pairs if a is not None for x in (F.lit(b), F.lit(a))]
        out[col] = F.create_map(*lits) if lits else F.create_map().cast("map<int,double>")
    return out


def running_aggregates(df: DataFrame, order_cols: list, partition_cols: list | tuple,
                       aggs: dict[str, tuple[str, str]], bucket: Column | None = None,
                       n_rows: int | None = None) -> DataFrame:
    """Running (inclusive, row-based) aggregates per partition in order.

    ``aggs``: output name → (input column, kind) with kind in
    ``sum | count | min | max``; ``avg`` is derived as sum/count by the caller.
    """
    part = list(partition_cols)
    d = _bucketed(df, order_cols, bucket, n_rows)
    fn = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    combine = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    bucket_aggs = [fn[k](F.col(c)).alias(f"_b_{o}") for o, (c, k) in aggs.items()]
    per_bucket = d.groupBy(*part, BUCKET).agg(*bucket_aggs)
    lit_offs = _global_offsets(per_bucket, {f"_b_{o}": k for o, (c, k) in aggs.items()}) if not part else None
    if lit_offs is not None:
        d = d.withColumns({f"_o_{o}": F.element_at(lit_offs[f"_b_{o}"], F.col(BUCKET)) for o in aggs})
    else:
        w = Window.partitionBy(*part).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        offs = per_bucket.select(*part, BUCKET, *[combine[k](F.col(f"_b_{o}")).over(w).alias(f"_o_{o}")
                                                  for o, (c, k) in aggs.items()])
        d = _null_safe_join(d, offs, part + [BUCKET])
    wi = (Window.partitionBy(*part, BUCKET).orderBy(*_order(order_cols))
          .rowsBetween(Window.unboundedPreceding, 0))
    for o, (c, k) in aggs.items():
        inner = fn[k](F.col(c)).over(wi)
        prev = F.col(f"_o_{o}")
        if k in ("sum", "count"):
            val = inner + F.coalesce(prev, F.lit(0))
        elif k == "min":
            val = F.when(prev.isNull(), inner).otherwise(F.least(inner, prev))
        else:
            val = F.when(prev.isNull(), inner).otherwise(F.greatest(inner, prev))
        d = d.withColumn(o, val)
    return d.drop(BUCKET, *[f"_o_{o}" for o in aggs])
