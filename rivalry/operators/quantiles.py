"""Exact quantiles by histogram refinement.

The wanted ranks are found without sorting or storing values: a pass counts the
values of a range in equal-width bins and keeps each bin's smallest and largest
value; the bins that hold a wanted rank are the ranges of the next pass, until
they hold a single value.  A pass is one grouped aggregate with at most
``max_bins`` groups, whatever the number of rows; values that spread evenly need
one pass for the range and two for the counts, up to about 10^8 different values.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BINS = 1 << 16


def exact_quantiles(df: DataFrame, col: str, fractions: list[float], max_bins: int = MAX_BINS) -> list[float | None]:
    """Linearly interpolated quantiles of the values that are neither null nor
    NaN (``None`` if there are none)."""
    v = F.col(col).cast("double")
    values = df.select(v.alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    inside = F.abs("v") < float("inf")
    below, n, above, lo, hi = values.agg(
        F.count(F.when(F.col("v") == float("-inf"), 1)), F.count(F.when(inside, 1)), F.count(F.when(F.col("v") == float("inf"), 1)),
        F.min(F.when(inside, F.col("v"))), F.max(F.when(inside, F.col("v")))).first()
    total = below + n + above
    if not total:
        return [None] * len(fractions)
    at = [p * (total - 1) for p in fractions]
    ranks = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
    found = {r: float("-inf") for r in ranks if r < below} | {r: float("inf") for r in ranks if r >= below + n}
    open_ = [r for r in ranks if r not in found]
    # (values before the range, smallest, largest value of the range)
    ranges = [(below, lo, hi)] if open_ else []
    while open_:
        single = {first: a for first, a, b in ranges if a == b}
        ranges = [x for x in ranges if x[1] < x[2]]
        starts = sorted(single.keys() | {x[0] for x in ranges})
        holder = {r: max(s for s in starts if s <= r) for r in open_}
        found |= {r: single[s] for r, s in holder.items() if s in single}
        open_ = [r for r in open_ if r not in found]
        if open_:
            ranges = _refined([x for x in ranges if x[0] in {holder[r] for r in open_}], values, open_, max_bins)
    out = []
    for x in at:
        lo_r, hi_r = math.floor(x), math.ceil(x)
        a, b = found[lo_r], found[hi_r]
        out.append(a if lo_r == hi_r or a == b else (hi_r - x) * a + (x - lo_r) * b)
    return out


def _refined(ranges: list[tuple], values: DataFrame, ranks: list[int], max_bins: int) -> list[tuple]:
    """One pass: the bins of ``ranges`` that hold one of ``ranks``."""
    n_bins = max(2, max_bins // len(ranges))
    if len(ranges) == 1:
        _, a, b = ranges[0]
        inside = values.where((F.col("v") >= a) & (F.col("v") <= b)).withColumn("part", F.lit(0))
    else:
        ends = sorted({e for _, a, b in ranges for e in (a, float(np.nextafter(b, np.inf)))})
        splits = [float("-inf"), *ends, float("inf")]
        part_of = {splits.index(a): i for i, (_, a, _) in enumerate(ranges)}
        numbers = F.array(*[F.lit(part_of.get(i)).cast("int") for i in range(len(splits) - 1)])
        cut = Bucketizer(splits=splits, inputCol="v", outputCol="cut").transform(values)
        inside = cut.withColumn("part", F.get(numbers, F.col("cut").cast("int"))).where("part IS NOT NULL")
    low = F.get(F.array(*[F.lit(a) for _, a, _ in ranges]), F.col("part"))
    high = F.get(F.array(*[F.lit(b) for _, _, b in ranges]), F.col("part"))
    # scaled, so that the widest range is finite and the narrowest not 0; the largest value always has the last bin, so every pass gets on
    scale = F.get(F.array(*[F.lit(2.0 ** 600 if max(abs(a), abs(b)) < 1e-150 else 0.5) for _, a, b in ranges]), F.col("part"))
    share = (F.col("v") * scale - low * scale) / (high * scale - low * scale)
    bin_ = F.when(F.col("v") == high, n_bins - 1).otherwise(F.least(F.floor(share * n_bins), F.lit(n_bins - 1)))
    bins = (inside.groupBy("part", bin_.alias("bin"))
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).toPandas().sort_values(["part", "bin"]))
    out, wanted = [], np.array(sorted(ranks))
    for i, (first, _, _) in enumerate(ranges):
        mine = bins[bins["part"] == i]
        ends = first + mine["n"].to_numpy().cumsum()
        starts = ends - mine["n"].to_numpy()
        held = np.searchsorted(wanted, starts) < np.searchsorted(wanted, ends)
        out += [(int(s), float(a), float(b)) for s, a, b, h in zip(starts, mine["lo"], mine["hi"], held) if h]
    return out
