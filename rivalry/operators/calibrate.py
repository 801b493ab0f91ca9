"""Calibration: quantile bins, temperature search, blending (T24, T26, T28,
A10, A11, A14, A15, J12).

The reference runs one full pass per candidate weight / temperature.  Here the
temperature of every bin is found by Newton steps on 1/T, one aggregate of first
and second derivatives for all bins a step (the loss is convex in 1/T); the blend
search adds up the losses of all weights in one dense accumulator per task.  No
search multiplies the rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.functions import probs
from rivalry.operators.combine import CHECKED_ROWS, broadcast_if_small
from rivalry.operators.quantiles import exact_quantiles
from rivalry.session import cut_lineage


def qcut_edges(df: DataFrame, col: str, q: int, exact: bool = True) -> list[float]:
    """T28 edges: ``q+1`` quantiles (linear interpolation, like pandas).

    ``exact`` counts values and takes ranks from distributed running totals;
    otherwise ``percentile_approx`` (bounded sketch).  The edges are ``q+1``
    numbers.  Duplicate edges raise, as pandas does.
    """
    ps = [i / q for i in range(q + 1)]
    if exact:
        edges = exact_quantiles(df, col, ps)
    else:
        edges = df.agg(F.percentile_approx(F.col(col).cast("double"), ps, 100000).alias("e")).first()["e"]
    edges = [float(x) for x in edges]
    if len(set(edges)) != len(edges):
        raise ValueError(f"bin edges must be unique: {edges}")
    return edges


def assign_bin(col, edges: list[float]):
    """Right-closed bins, lowest edge included: #interior edges strictly below x."""
    inner = F.array(*[F.lit(e) for e in edges[1:-1]])
    x = F.col(col) if isinstance(col, str) else col
    return F.size(F.filter(inner, lambda e: e < x)).cast("int")


def with_qcut(df: DataFrame, col: str, q: int, out: str = "bin", exact: bool = True) -> tuple[DataFrame, list[float]]:
    edges = qcut_edges(df, col, q, exact)
    return df.withColumn(out, assign_bin(col, edges)), edges


def bin_table(edges: list[float], spark) -> DataFrame:
    """One row per bin: bin, left, right, mid."""
    rows = [(i, edges[i], edges[i + 1], (edges[i] + edges[i + 1]) / 2) for i in range(len(edges) - 1)]
    return spark.createDataFrame(rows, "bin int, left double, right double, mid double")


def binned_mean(df: DataFrame, bin_col: str, value: str, edges: list[float]) -> DataFrame:
    """A10: mean of ``value`` per bin, with bin edges, ordered by left edge (L4)."""
    agg = df.groupBy(bin_col).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_loss"))
    edge_arr = F.array(*[F.lit(e) for e in edges])
    return agg.select(bin_col, F.element_at(edge_arr, F.col(bin_col) + 1).alias("left"),
                      F.element_at(edge_arr, F.col(bin_col) + 2).alias("right"), "n", "mean_loss").orderBy("left")


def _spread(df: DataFrame) -> DataFrame:
    """Deal narrow rows to the shuffle partitions before they are evaluated many
    times: the exchange moves a few numbers per row, the evaluation costs up to a
    thousand logarithms per row, however few files the input has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def temperature_grid(lo: float = 0.5, hi: float = 1.5, steps: int = 100) -> list[float]:
    return [lo + (hi - lo) * i / steps for i in range(steps + 1)]


def _at_temperatures(rows: DataFrame, bin_col: str, temps: list[tuple], names: list[str]) -> DataFrame:
    """``rows`` with columns ``names`` from ``temps`` (bin, values ...): one row a bin, as many as were collected."""
    kind = dict(rows.dtypes)[bin_col]
    t = rows.sparkSession.createDataFrame(temps, f"_bin {kind}, " + ", ".join(f"{n} double" for n in names))
    t = F.broadcast(t) if len(temps) <= CHECKED_ROWS else t
    return rows.join(t, F.col(bin_col).eqNullSafe(F.col("_bin"))).drop("_bin")


def _slopes(rows: DataFrame, bin_col: str, label: str, zs) -> DataFrame:
    """bin, g, h: average first and second derivative of the log loss in b = 1 / T at column ``_b``."""
    top = F.greatest(*[F.col("_b") * F.col(z) for z in zs])
    d = rows.withColumn("_top", top).withColumns({f"_e{i}": F.exp(F.col("_b") * F.col(z) - F.col("_top")) for i, z in enumerate(zs)})

    def total(power):
        terms = [F.col(f"_e{i}") * F.col(z) ** power if power else F.col(f"_e{i}") for i, z in enumerate(zs)]
        return sum(terms[1:], terms[0])

    d = d.withColumn("_all", total(0)).withColumns({"_mean": total(1) / F.col("_all"), "_square": total(2) / F.col("_all")})
    return d.groupBy(bin_col).agg(F.avg(F.col("_mean") - probs.pick(label, *zs)).alias("g"), F.avg(F.col("_square") - F.col("_mean") * F.col("_mean")).alias("h"))


def _fitted(rows: DataFrame, bin_col: str, label: str, zs, lo: float, hi: float, steps: int, tol: float = 1e-10) -> dict:
    """bin → 1 / T between 1 / hi and 1 / lo with the smallest loss.

    Newton steps kept inside a bracket of the derivative's sign change; a step
    that leaves it is replaced by a bisection.  A bin is done after a step shorter
    than ``tol`` (Newton's next error is about its square)."""
    least, most = 1 / hi, 1 / lo
    state: dict = {}  # bin → 1 / T, largest value with a falling and smallest with a rising loss (None: not met), done
    for _ in range(steps):
        at = rows.withColumn("_b", F.lit(1.0)) if not state else _at_temperatures(
            rows, bin_col, [(k, s[0]) for k, s in state.items() if not s[3]], ["_b"])
        for k, g, h in _slopes(at, bin_col, label, zs).collect():  # one row a bin
            b, left, right, _ = state.get(k, (1.0, None, None, False))
            if not g:  # flat, or no row counts
                state[k] = (b, left, right, True)
                continue
            left, right = (b, right) if g < 0 else (left, b)
            a, z = least if left is None else left, most if right is None else right
            new = b - g / h if h > 0 else (a + z) / 2
            if not a <= new <= z:  # to a limit that has not been tried, else to the middle
                new = most if g < 0 and right is None else least if g > 0 and left is None else (a + z) / 2
            state[k] = (new, left, right, abs(new - b) < tol)
        if all(s[3] for s in state.values()):
            break
    return {k: s[0] for k, s in state.items()}


def temperature_fit(df: DataFrame, bin_col: str, label: str = "label", zs=("z0", "z1", "z2"), lo: float = 0.5, hi: float = 1.5,
                    steps: int = 40) -> DataFrame:
    """A15, continuous: per bin the temperature in [lo, hi] with the smallest
    softmax log loss: bin, temperature, loss, n.  A bin whose loss does not
    depend on the temperature keeps 1."""
    rows = cut_lineage(_spread(df.select(bin_col, label, *zs)), "temperature-rows")
    best = _fitted(rows, bin_col, label, zs, lo, hi, steps)
    at = _at_temperatures(rows, bin_col, [(k, 1 / b) for k, b in best.items()], ["_t"])
    return at.groupBy(bin_col).agg(F.first("_t").alias("temperature"),
                                   F.avg(probs.row_softmax_log_loss(label, *zs, temperature=F.col("_t"))).alias("loss"), F.count(F.lit(1)).alias("n"))


def temperature_search(df: DataFrame, bin_col: str, label: str = "label", zs=("z0", "z1", "z2"),
                       grid: list[float] | None = None) -> DataFrame:
    """A15 on a grid: per bin, the temperature in ``grid`` minimising the softmax log loss.

    The loss is convex in 1 / T, so the best grid point is next to the continuous
    optimum: its two neighbours are evaluated, and the smallest temperature, to
    which a bin with a constant loss goes (ties → smaller T)."""
    grid = sorted(grid or temperature_grid())
    rows = cut_lineage(_spread(df.select(bin_col, label, *zs)), "temperature-rows")
    best = _fitted(rows, bin_col, label, zs, grid[0], grid[-1], 40, 1e-4)
    near = []
    for k, b in best.items():
        i = min(max(bisect.bisect_left(grid, 1 / b), 1), len(grid) - 1)
        near.append((k, grid[0], grid[i - 1], grid[i]))
    at = _at_temperatures(rows, bin_col, near, [f"_t{i}" for i in range(3)])
    at = at.withColumns({f"_l{i}": probs.row_softmax_log_loss(label, *zs, temperature=F.col(f"_t{i}")) for i in range(3)})
    found = at.groupBy(bin_col).agg(F.count(F.lit(1)).alias("n"), *[x for i in range(3) for x in (F.first(f"_t{i}").alias(f"_t{i}"), F.avg(f"_l{i}").alias(f"_l{i}"))])
    best_of = F.least(*[F.struct(F.round(f"_l{i}", 9).alias("r"), F.col(f"_t{i}").alias("t"), F.col(f"_l{i}").alias("loss")) for i in range(3)])
    return found.withColumn("b", best_of).select(bin_col, F.col("b.t").alias("temperature"), F.col("b.loss").alias("loss"), "n")


def temperature_scale(df: DataFrame, temps: DataFrame, bin_col: str, zs=("z0", "z1", "z2"),
                      out=("A", "B", "tie")) -> DataFrame:
    """Logits / T(bin) → softmax.  ``temps`` has one row per bin (broadcast when counted small)."""
    j = df.join(broadcast_if_small(temps.select(bin_col, "temperature")), bin_col, "left")
    t = F.coalesce(F.col("temperature"), F.lit(1.0))
    return j.withColumns(dict(zip(out, probs.softmax(*zs, temperature=t))))


def _blend_sums(df: DataFrame, label: str, ps, qs, weights: np.ndarray) -> DataFrame:
    """n, sums: per task the rows and the added losses of every weight.  Rows
    without a label or with a null probability are left out."""
    number = F.when(F.col(label) == F.col(label).cast("int"), F.col(label).cast("int"))
    rows = _spread(df.select(number.alias("y"), *[F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(ps)],
                             *[F.col(c).cast("double").alias(f"q{i}") for i, c in enumerate(qs)]))
    k, eps, rest = len(ps), probs.EPS, 1 - weights

    def mixed(p, q):
        out = np.multiply.outer(p, weights)
        out += np.multiply.outer(q, rest)
        np.maximum(out, eps, out=out)
        np.minimum(out, 1 - eps, out=out)
        if np.isnan(p).any() or np.isnan(q).any():
            out[np.isnan(out)] = 1 - eps  # NaN counts as larger than any number
        return out

    def run(batches):
        sums, n = np.zeros(len(weights)), 0
        for batch in batches:
            y = batch.column("y").fill_null(-1).to_numpy()
            known = (y >= 0) & (y < k)
            for c in batch.columns[1:]:
                if c.null_count:
                    known &= c.is_valid().to_numpy(zero_copy_only=False)
            p, q = (np.stack([batch.column(f"{x}{i}").to_numpy(zero_copy_only=False)[known] for i in range(k)]) for x in "pq")
            y = y[known]
            for a in range(0, len(y), 32):  # a few rows at a time stay in the processor's cache
                mine, at = y[a:a + 32], np.arange(a, min(a + 32, len(y)))
                own = mixed(p[mine, at], q[mine, at])
                total = own.copy()
                for d in range(1, k):
                    other = (mine + d) % k
                    total += mixed(p[other, at], q[other, at])
                total /= own
                sums += np.log(total, out=total).sum(axis=0)
            n += len(y)
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.float64()))], names=["n", "sums"])

    return rows.mapInArrow(run, "n long, sums array<double>")


def blend_grid_search(df: DataFrame, label: str = "label", ps=("pa", "pb", "pt"), qs=("qa", "qb", "qt"),
                      n: int = 1001) -> DataFrame:
    """``argmin_w logloss(w·p + (1-w)·q)`` over ``w ∈ {0, 1/(n-1), …, 1}``.

    Every weight is evaluated: rows that do not sum to 1 are renormalised inside
    the loss, which then need not be convex in ``w``.  A task adds the losses of
    its rows for all weights at once; the tasks' sums are added as vectors.
    Ties resolve to the smaller weight (strict ``<`` in the reference loop);
    losses are rounded to 9 digits before comparing.
    """
    sums = _blend_sums(df, label, ps, qs, np.arange(n) / (n - 1))
    sums = sums.unionByName(df.sparkSession.createDataFrame([(0, [0.0] * n)], sums.schema))  # there is a row to add in any case
    total = sums.agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("sums")).alias("s")).select("n", vector_to_array("s").alias("s"))
    mean = F.when(F.col("n") > 0, F.transform("s", lambda x: x / F.col("n")))
    points = F.transform("mean", lambda x, i: F.struct(F.round(x, 9).alias("r"), (i / (n - 1)).alias("w"), x.alias("loss")))
    return total.select(mean.alias("mean")).select(F.array_min(points).alias("b"), F.get("mean", F.lit(0)).alias("base_loss")).select(
        F.col("b.w").alias("best_w"), F.col("b.loss").alias("best_loss"), "base_loss")
