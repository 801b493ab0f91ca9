"""Quantiles, temperature and blend searches, folds of many classes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MED
from rivalry.functions.probs import EPS
from rivalry.operators import calibrate, folds, quantiles
from rivalry.plans import fixtures as fx
from rivalry.plans.sqlgen import kfold_sql

FRACTIONS = [0, 0.001, 0.1, 0.25, 0.5, 0.77, 0.9, 0.999, 1]


@pytest.mark.parametrize("max_bins", [1 << 16, 64])
@pytest.mark.parametrize("kind", ["normal", "huge", "tiny", "ties", "one", "skewed", "lengths"])
def test_quantiles_equal_numpy(spark, kind, max_bins):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=5000), "huge": rng.normal(size=300) * 1e307, "tiny": np.arange(200) * 5e-324,
         "ties": np.repeat([3.0, 1.0, 2.0], [500, 1, 700]), "one": np.array([4.5]), "skewed": 10.0 ** rng.uniform(-200, 200, 400),
         "lengths": rng.integers(1, 4000, 8000).astype(float)}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    want = np.quantile(x, FRACTIONS)
    assert np.allclose(quantiles.exact_quantiles(df, "x", FRACTIONS, max_bins), want, rtol=1e-12, atol=5e-324)


def test_quantiles_with_infinities(spark):
    x = [float("-inf"), float("-inf"), -1.0, 0.0, 5.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert quantiles.exact_quantiles(df, "x", [0, 0.2, 0.4, 0.5, 0.8, 1]) == [x[0], x[0], -1.0, -0.5, 5.0, float("inf")]
    assert quantiles.exact_quantiles(df.limit(0), "x", [0.5]) == [None]


def test_quantiles_need_few_passes(spark, monkeypatch):
    passes, real = [], quantiles._refined
    monkeypatch.setattr(quantiles, "_refined", lambda *a: passes.append(1) or real(*a))
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=20_000)], "x double")
    edges = calibrate.qcut_edges(df, "x", 100)
    assert len(edges) == 101 and len(passes) <= 2
    del passes[:]
    calibrate.qcut_edges(fx.battles_big(spark, SF_MED), "len", 50)
    assert len(passes) == 1  # whole numbers: a bin each


def test_continuous_temperature_is_no_worse_than_the_grid(spark):
    rng = np.random.default_rng(1)
    rows = []
    for b, t in enumerate([0.2, 0.7, 1.0, 1.3, 4.0]):  # the first and last lie beyond the limits
        z = rng.normal(size=(600, 3)) * 2
        p = np.exp(z / t)
        p /= p.sum(axis=1)[:, None]
        rows += [(b, int(rng.choice(3, p=q)), *map(float, v)) for v, q in zip(z, p)]
    rows += [(5, 1, 0.5, 0.5, 0.5)] * 7 + [(None, 2, 1.0, 0.0, 3.0), (None, 0, 1.0, 0.0, 3.0), (6, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "bin int, label int, z0 double, z1 double, z2 double")
    fit = {r["bin"]: r for r in calibrate.temperature_fit(df, "bin").collect()}
    grid = {r["bin"]: r for r in calibrate.temperature_search(df, "bin").collect()}
    assert fit.keys() == grid.keys() == {0, 1, 2, 3, 4, 5, 6, None}

    def loss(b, t):
        out = [math.log(sum(math.exp(v / t) for v in z)) - z[y] / t for k, y, *z in rows if k == b and y is not None]
        return sum(out) / len(out)

    for b in (0, 1, 2, 3, 4, None):
        losses = [(round(loss(b, t), 9), t) for t in calibrate.temperature_grid()]
        assert math.isclose(grid[b]["temperature"], min(losses)[1]) and math.isclose(grid[b]["loss"], loss(b, grid[b]["temperature"]))
        assert fit[b]["loss"] <= grid[b]["loss"] + 1e-12 and 0.5 - 1e-9 <= fit[b]["temperature"] <= 1.5 + 1e-9
    assert math.isclose(fit[0]["temperature"], 0.5) and math.isclose(fit[4]["temperature"], 1.5)
    assert (fit[5]["temperature"], grid[5]["temperature"], fit[5]["n"]) == (1.0, 0.5, 7)  # a flat loss
    assert fit[6]["loss"] is None and grid[6]["n"] == 1


def test_searches_do_not_multiply_rows(spark):
    from rivalry.plans import q_eval
    pz = q_eval._pz(spark, SF_MED)
    sums = calibrate._blend_sums(pz, "label", ("A", "B", "tie"), ("qa", "qb", "qt"), np.arange(1001) / 1000)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan and "Join" not in plan
    assert sums.agg(F.sum("n")).first()[0] == pz.count() and sums.where(F.size("sums") != 1001).count() == 0


def test_blend_with_nulls_and_odd_numbers(spark):
    rng = random.Random(0)
    rows = [(rng.randrange(3), *[rng.random() for _ in range(6)]) for _ in range(50)]
    odd = [(None, *[0.5] * 6), (1, None, *[0.5] * 5), (7, *[0.5] * 6), (0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), (2, float("nan"), 0.2, 0.3, 0.1, 0.1, 0.8)]
    schema = "label int, pa double, pb double, pt double, qa double, qb double, qt double"

    def loss(w):
        out = []
        for y, *v in rows + odd[3:]:
            mix = [min(1 - EPS, max(EPS, m)) if m == m else 1 - EPS for m in (w * a + (1 - w) * b for a, b in zip(v[:3], v[3:]))]
            out.append(-math.log(mix[y] / sum(mix)))
        return sum(out) / len(out)

    got = calibrate.blend_grid_search(spark.createDataFrame(rows + odd, schema)).first()
    want = min((round(loss(i / 1000), 9), i / 1000) for i in range(1001))
    assert got["best_w"] == want[1] and abs(got["best_loss"] - want[0]) < 1e-8 and abs(got["base_loss"] - loss(0.0)) < 1e-8
    empty = calibrate.blend_grid_search(spark.createDataFrame(odd[:3], schema)).collect()
    assert [tuple(r) for r in empty] == [(None, None, None)]


def test_folds_of_very_many_classes(spark):
    import duckdb
    rows = [(i, i % 10_001) for i in range(31_000)]
    got = folds.stratified_kfold(spark.createDataFrame(rows, "id long, label long"), 5, shuffle=False)
    con = duckdb.connect()
    con.execute("CREATE TABLE s AS SELECT i AS id, i % 10001 AS label FROM range(31000) r(i)")
    want = con.execute(f"SELECT id, fold FROM {kfold_sql('s', 5, 'id')}").fetchall()
    assert sorted((r["id"], r["fold"]) for r in got.collect()) == sorted(want)
