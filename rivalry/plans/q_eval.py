"""Registered queries: probabilities, losses, metrics, binning, temperature and blend searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.functions import probs
from rivalry.operators import calibrate, labels, metrics
from rivalry.plans import fixtures as fx
from rivalry.plans.oracle_fixtures import with_fixtures as W
from rivalry.plans.registry import register
from rivalry.plans.sqlgen import ce_sql, dot_sql, log_loss_sql, softmax_sql
from rivalry.session import table

Z = ["z0", "z1", "z2"]
G = ["g0", "g1", "g2"]
_PZ = softmax_sql(Z)
_PG = softmax_sql(G)
_PZ_CTE = (f"pz AS (SELECT id, label, len, model_a, model_b, z0, z1, z2, {_PZ[0]} AS A, {_PZ[1]} AS B, {_PZ[2]} AS tie, "
           f"{_PG[0]} AS qa, {_PG[1]} AS qb, {_PG[2]} AS qt FROM bb)")
_LL = log_loss_sql("label", ["A", "B", "tie"])


def _pz(spark, sf):
    bb = fx.battles_big(spark, sf)
    bb = metrics.with_probs(bb, Z, ("A", "B", "tie"))
    return metrics.with_probs(bb, G, ("qa", "qb", "qt"))


def _r(c, d=6):
    return F.round(c, d).alias(c if isinstance(c, str) else None)


@register("softmax", W(f"WITH {_PZ_CTE} SELECT id, round(A, 6) AS A, round(B, 6) AS B, round(tie, 6) AS tie FROM pz", "bb"))
def q_softmax(spark, sf):
    return _pz(spark, sf).select("id", _r("A"), _r("B"), _r("tie"))


@register("row_log_loss", W(f"WITH {_PZ_CTE} SELECT id, round({_LL}, 6) AS log_loss FROM pz", "bb"))
def q_row_log_loss(spark, sf):
    return metrics.with_row_loss(_pz(spark, sf)).select("id", _r("log_loss"))


@register("perplexity", W(f"WITH {_PZ_CTE} SELECT id, round(exp({_LL}), 6) AS perplexity FROM pz", "bb"))
def q_perplexity(spark, sf):
    return metrics.with_row_loss(_pz(spark, sf)).select("id", _r("perplexity"))


@register("log_loss", W(f"WITH {_PZ_CTE} SELECT round(avg({_LL}), 6) AS log_loss FROM pz", "bb"))
def q_log_loss(spark, sf):
    return metrics.log_loss(_pz(spark, sf)).select(_r("log_loss"))


_ARGMAX = "list_position([A, B, tie], greatest(A, B, tie)) - 1"


@register("accuracy", W(f"WITH {_PZ_CTE} SELECT round(avg(CAST({_ARGMAX} = label AS DOUBLE)), 6) AS accuracy FROM pz",
                        "bb"))
def q_accuracy(spark, sf):
    return metrics.accuracy(_pz(spark, sf)).select(_r("accuracy"))


@register("balanced_accuracy", W(f"""WITH {_PZ_CTE} SELECT round(avg(r), 6) AS balanced_accuracy FROM (
  SELECT label, avg(CAST({_ARGMAX} = label AS DOUBLE)) AS r FROM pz GROUP BY label)""", "bb"))
def q_balanced_accuracy(spark, sf):
    return metrics.balanced_accuracy(_pz(spark, sf)).select(_r("balanced_accuracy"))


@register("eval_metrics", W(f"""WITH {_PZ_CTE}, per AS (SELECT label, avg(CAST({_ARGMAX} = label AS DOUBLE)) AS r FROM pz GROUP BY label)
SELECT round(avg({_LL}), 6) AS log_loss, round(avg(CAST({_ARGMAX} = label AS DOUBLE)), 6) AS accuracy,
  round((SELECT avg(r) FROM per), 6) AS balanced_accuracy FROM pz""", "bb"))
def q_eval_metrics(spark, sf):
    m = metrics.eval_metrics(_pz(spark, sf))
    return m.select(_r("log_loss"), _r("accuracy"), _r("balanced_accuracy"))


@register("weighted_cross_entropy", W(f"""WITH w AS (SELECT label, (1 / ratio) / sum(1 / ratio) OVER () AS weight FROM (
  SELECT label, count(*) / sum(count(*)) OVER () AS ratio FROM bb GROUP BY label))
SELECT round(sum(w.weight * {ce_sql('bb.label', Z)}) / sum(w.weight), 6) AS weighted_ce FROM bb JOIN w USING (label)""",
                                      "bb"))
def q_weighted_cross_entropy(spark, sf):
    bb = fx.battles_big(spark, sf)
    return metrics.weighted_cross_entropy(bb, labels.class_weights(bb)).select(_r("weighted_ce"))


@register("label_smoothing_ce", W(f"""SELECT round(avg(0.9 * {ce_sql('label', Z)} +
  0.1 * ({ce_sql('0', Z)} + {ce_sql('1', Z)} + {ce_sql('2', Z)}) / 3), 6) AS smoothed_ce FROM bb""", "bb"))
def q_label_smoothing_ce(spark, sf):
    return metrics.label_smoothing_ce(fx.battles_big(spark, sf)).select(_r("smoothed_ce"))


@register("cosine_embedding_loss", f"""SELECT round(avg(1 - {dot_sql('h.embedding', 'e.embedding')} /
  greatest(sqrt({dot_sql('h.embedding', 'h.embedding')}) * sqrt({dot_sql('e.embedding', 'e.embedding')}), 1e-8)), 5) AS cos_loss
FROM embeddings h JOIN embeddings e ON e.vec_id = h.vec_id + 1""")
def q_cosine_embedding_loss(spark, sf):
    e = table(spark, sf, "embeddings")
    h = e.select("vec_id", F.col("embedding").alias("h"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e"))
    return metrics.cosine_embedding_loss(h.join(n, "vec_id"), "h", "e").select(F.round("cos_loss", 5).alias("cos_loss"))


@register("oof_concat", W(f"""WITH {_PZ_CTE} SELECT fold, count(*) AS n, round(avg({_LL}), 6) AS log_loss FROM (
  SELECT *, CAST(id % 4 AS INTEGER) AS fold FROM pz) GROUP BY ROLLUP (fold)""", "bb"))
def q_oof_concat(spark, sf):
    pz = _pz(spark, sf).withColumn("fold", (F.col("id") % 4).cast("int"))
    return metrics.oof_report(pz).select("fold", "n", _r("log_loss"))


@register("mean_of_batch_means", W("""SELECT fold, round(avg(m), 6) AS loss, count(*) AS n_batches FROM (
  SELECT fold, b, avg(loss) AS m FROM (
    SELECT fold, loss, (row_number() OVER (PARTITION BY fold ORDER BY step) - 1) // 8 AS b FROM ml)
  GROUP BY fold, b) GROUP BY fold""", "ml"))
def q_mean_of_batch_means(spark, sf):
    m = metrics.mean_of_batch_means(fx.metrics_log(spark, sf), "loss", "step", by=["fold"])
    return m.select("fold", _r("loss"), "n_batches")


# ---------------------------------------------------------------- bins / calibration

def _edges_sql(col: str, q: int) -> str:
    ps = ", ".join(repr(i / q) for i in range(q + 1))
    return f"quantile_cont(CAST({col} AS DOUBLE), [{ps}])"


def _binned_cte(q: int) -> str:
    return (f"e AS (SELECT {_edges_sql('len', q)} AS edges FROM bb), "
            f"bz AS (SELECT bb.*, CAST(len(list_filter(e.edges[2:{q}], lambda x: x < bb.len)) AS INTEGER) AS bin, "
            f"e.edges FROM bb, e)")


def _qcut(spark, sf, q):
    bb = fx.battles_big(spark, sf)
    return calibrate.with_qcut(bb, "len", q)


@register("qcut", W(f"WITH {_binned_cte(100)} SELECT id, bin FROM bz", "bb"))
def q_qcut(spark, sf):
    d, _ = _qcut(spark, sf, 100)
    return d.select("id", "bin")


@register("length_bin_range_join", W(f"WITH {_binned_cte(50)} SELECT id, bin FROM bz", "bb"))
def q_length_bin_range_join(spark, sf):
    d, _ = _qcut(spark, sf, 50)
    return d.select("id", "bin")


_PZB = f"pzb AS (SELECT bz.*, {_PZ[0]} AS A, {_PZ[1]} AS B, {_PZ[2]} AS tie FROM bz)"


@register("binned_mean_loss", W(f"""WITH {_binned_cte(100)}, {_PZB}
SELECT bin, edges[bin + 1] AS "left", edges[bin + 2] AS "right", count(*) AS n, round(avg({_LL}), 6) AS mean_loss
FROM pzb GROUP BY bin, edges""", "bb"))
def q_binned_mean_loss(spark, sf):
    d, edges = _qcut(spark, sf, 100)
    d = metrics.with_row_loss(metrics.with_probs(d))
    return calibrate.binned_mean(d, "bin", "log_loss", edges).select("bin", "left", "right", "n", _r("mean_loss"))


@register("sort_bins", W(f"""WITH {_binned_cte(100)} SELECT DISTINCT bin, edges[bin + 1] AS "left" FROM bz""", "bb"))
def q_sort_bins(spark, sf):
    return q_binned_mean_loss(spark, sf).select("bin", "left")


_TGRID = "(SELECT 0.5 + CAST(i AS DOUBLE) / 100 AS t FROM range(101) r(i))"
_TEMP_CTE = (f"tl AS (SELECT bin, t, avg({log_loss_sql('label', softmax_sql(Z, 't'))}) AS loss, count(*) AS n "
             f"FROM bz, {_TGRID} g GROUP BY bin, t), "
             f"tb AS (SELECT bin, t AS temperature, loss, n FROM (SELECT *, row_number() OVER "
             f"(PARTITION BY bin ORDER BY round(loss, 9), t) AS rk FROM tl) WHERE rk = 1)")


def _temps(spark, sf):
    d, edges = _qcut(spark, sf, 50)
    return d, edges, calibrate.temperature_search(d, "bin")


@register("temperature_search", W(f"""WITH {_binned_cte(50)}, {_TEMP_CTE}
SELECT bin, temperature, round(loss, 6) AS loss, n FROM tb""", "bb"))
def q_temperature_search(spark, sf):
    _, _, t = _temps(spark, sf)
    return t.select("bin", "temperature", _r("loss"), "n")


def _newton_sql(steps: int = 9) -> str:
    """CTEs t0 .. t<steps>: per bin 1 / T after so many Newton steps on the log loss, kept within the limits."""
    p = softmax_sql([f"b * {z}" for z in Z])
    mean = " + ".join(f"({x}) * {z}" for x, z in zip(p, Z))
    square = " + ".join(f"({x}) * {z} * {z}" for x, z in zip(p, Z))
    ctes = ["t0 AS (SELECT DISTINCT bin, CAST(1 AS DOUBLE) AS b FROM bz)"]
    for k in range(steps):
        ctes.append(f"""s{k} AS (SELECT bin, any_value(b) AS b, avg(m - CASE label WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END) AS g, avg(q - m * m) AS h
  FROM (SELECT bz.bin, b, label, z0, z1, z2, {mean} AS m, {square} AS q FROM bz JOIN t{k} ON t{k}.bin = bz.bin) GROUP BY bin),
t{k + 1} AS (SELECT bin, least(greatest(b - g / h, 1 / 1.5), 1 / 0.5) AS b FROM s{k})""")
    return ", ".join(ctes)


@register("temperature_fit", W(f"""WITH {_binned_cte(50)}, {_newton_sql()}
SELECT bz.bin, round(any_value(1 / b), 5) AS temperature, round(avg({log_loss_sql('label', softmax_sql(Z, '(1 / b)'))}), 6) AS loss, count(*) AS n
FROM bz JOIN t9 ON t9.bin = bz.bin GROUP BY bz.bin""", "bb"))
def q_temperature_fit(spark, sf):
    d, _ = _qcut(spark, sf, 50)
    return calibrate.temperature_fit(d, "bin").select("bin", F.round("temperature", 5).alias("temperature"), _r("loss"), "n")


@register("binned_softmax_loss", W(f"""WITH {_binned_cte(50)}, {_TEMP_CTE}
SELECT bz.bin, round((any_value(edges[bz.bin + 1]) + any_value(edges[bz.bin + 2])) / 2, 6) AS mid,
  any_value(tb.temperature) AS temperature,
  round(avg({log_loss_sql('label', softmax_sql(Z, 'tb.temperature'))}), 6) AS loss
FROM bz JOIN tb ON bz.bin = tb.bin GROUP BY bz.bin""", "bb"))
def q_binned_softmax_loss(spark, sf):
    d, edges, t = _temps(spark, sf)
    scaled = calibrate.temperature_scale(d, t, "bin")
    per = scaled.groupBy("bin").agg(F.first("temperature").alias("temperature"),
                                    F.avg(probs.row_log_loss("label", "A", "B", "tie")).alias("loss"))
    bins = calibrate.bin_table(edges, spark).select("bin", "mid")
    return per.join(F.broadcast(bins), "bin").select("bin", _r("mid"), "temperature", _r("loss"))


@register("temperature_scale", W(f"""WITH {_binned_cte(50)}, {_TEMP_CTE}
SELECT id, {', '.join(f'round({p}, 6) AS {n}' for p, n in zip(softmax_sql(Z, 'tb.temperature'), ('A', 'B', 'tie')))}
FROM bz JOIN tb ON bz.bin = tb.bin""", "bb"))
def q_temperature_scale(spark, sf):
    d, _, t = _temps(spark, sf)
    return calibrate.temperature_scale(d, t, "bin").select("id", _r("A"), _r("B"), _r("tie"))


@register("blend", W(f"""WITH {_PZ_CTE} SELECT id, round(0.3 * A + (1 - 0.3) * qa, 6) AS A, round(0.3 * B + (1 - 0.3) * qb, 6) AS B,
  round(0.3 * tie + (1 - 0.3) * qt, 6) AS tie FROM pz""", "bb"))
def q_blend(spark, sf):
    pz = _pz(spark, sf)
    mixed = probs.blend(["A", "B", "tie"], ["qa", "qb", "qt"], 0.3)
    return pz.select("id", *[F.round(c, 6).alias(n) for c, n in zip(mixed, ("A", "B", "tie"))])


_BLEND_SQL = W(f"""WITH {_PZ_CTE}, g AS (SELECT CAST(i AS DOUBLE) / 1000 AS w FROM range(1001) r(i)),
l AS (SELECT w, avg({log_loss_sql('label', ['w * A + (1 - w) * qa', 'w * B + (1 - w) * qb', 'w * tie + (1 - w) * qt'])}) AS loss
  FROM pz, g GROUP BY w)
SELECT w AS best_w, round(loss, 6) AS best_loss, round((SELECT loss FROM l WHERE w = 0), 6) AS base_loss
FROM l ORDER BY round(loss, 9), w LIMIT 1""", "bb")


def _blend_search(spark, sf):
    pz = _pz(spark, sf)
    return calibrate.blend_grid_search(pz, ps=("A", "B", "tie"), qs=("qa", "qb", "qt"))


@register("blend_grid_search", _BLEND_SQL)
def q_blend_grid_search(spark, sf):
    return _blend_search(spark, sf).select("best_w", _r("best_loss"), _r("base_loss"))


@register("argmin_weight", _BLEND_SQL.replace(
    "SELECT w AS best_w, round(loss, 6) AS best_loss, round((SELECT loss FROM l WHERE w = 0), 6) AS base_loss",
    "SELECT w AS best_w"))
def q_argmin_weight(spark, sf):
    return _blend_search(spark, sf).select("best_w")
