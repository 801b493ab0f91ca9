"""Registered queries: running/ordered analytics and row ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.functions import text as X
from rivalry.operators import training_log as TL
from rivalry.plans import fixtures as fx
from rivalry.plans.oracle_fixtures import with_fixtures as W
from rivalry.plans.registry import register
from rivalry.plans.sqlgen import tokens_sql
from rivalry.session import table


@register("running_mean_loss", W("""SELECT fold, epoch, step, round(avg(loss) OVER (PARTITION BY fold, epoch ORDER BY step
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_loss FROM ml""", "ml"))
def q_running_mean_loss(spark, sf):
    r = TL.running_mean(fx.metrics_log(spark, sf), "loss", "step", by=["fold", "epoch"])
    return r.select("fold", "epoch", "step", F.round("running_loss", 6).alias("running_loss"))


@register("best_checkpoint", W("""WITH e AS (SELECT fold, epoch, avg(loss) AS score FROM ml GROUP BY fold, epoch)
SELECT fold, epoch, round(score, 6) AS score,
  round(min(score) OVER (PARTITION BY fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_so_far,
  coalesce(score < min(score) OVER (PARTITION BY fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
    AS improved
FROM e""", "ml"))
def q_best_checkpoint(spark, sf):
    e = fx.metrics_log(spark, sf).groupBy("fold", "epoch").agg(F.avg("loss").alias("score"))
    b = TL.best_checkpoint(e, "score", "epoch", by=["fold"])
    return b.select("fold", "epoch", F.round("score", 6).alias("score"), F.round("best_so_far", 6).alias("best_so_far"),
                    "improved")


@register("early_stop_round", W("""WITH r AS (SELECT fold, loss, row_number() OVER (PARTITION BY fold ORDER BY step) AS round,
  min(loss) OVER (PARTITION BY fold ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM ml),
b AS (SELECT *, min(round) OVER (PARTITION BY fold, m) AS best_round FROM r),
s AS (SELECT fold, min(round) FILTER (WHERE round - best_round >= 50) AS stop_round, max(round) AS last FROM b GROUP BY fold)
SELECT b.fold, s.stop_round, b.best_round, b.m AS best_value FROM b JOIN s ON b.fold = s.fold
WHERE b.round = coalesce(s.stop_round, s.last)""", "ml"))
def q_early_stop_round(spark, sf):
    return TL.early_stop(fx.metrics_log(spark, sf), "loss", "step", by=["fold"], patience=50)


@register("head_n", W("SELECT id, label FROM bb ORDER BY id LIMIT 100", "bb"))
def q_head_n(spark, sf):
    return TL.head_n(fx.battles_big(spark, sf).select("id", "label"), 100)


@register("slice_rows", W("""SELECT id, label FROM bb WHERE id % 4 <> 0 ORDER BY id LIMIT 4900 OFFSET 5100""", "bb"))
def q_slice_rows(spark, sf):
    bb = fx.battles_big(spark, sf).select("id", "label", (F.col("id") % 4).alias("fold"))
    train = bb.filter(~F.col("fold").eqNullSafe(0)).drop("fold")
    return TL.slice_rows(train, 5100, 10000)


@register("half_split", W("""SELECT id, CASE WHEN row_number() OVER (ORDER BY id) <= (count(*) OVER ()) // 2 THEN 0 ELSE 1 END
  AS half FROM bb""", "bb"))
def q_half_split(spark, sf):
    return TL.half_split(fx.battles_big(spark, sf).select("id"))


@register("length_sort", f"""SELECT doc_id, (row_number() OVER (ORDER BY len({tokens_sql('text')}) DESC, doc_id) - 1) // 8 AS batch
FROM documents""")
def q_length_sort(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.token_count("text").alias("n"))
    return TL.length_sort_batches(d, "n", "doc_id").select("doc_id", "batch")


@register("shuffle_rows", W("SELECT id, row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR))) AS rn FROM bb", "bb"))
def q_shuffle_rows(spark, sf):
    return TL.shuffle_rows(fx.battles_big(spark, sf).select("id"))
