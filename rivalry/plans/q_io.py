"""Registered queries: sources and sinks as write → read round trips in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.operators import metrics, priors
from rivalry.operators.turns import qa_pairs
from rivalry.plans import fixtures as fx
from rivalry.plans.oracle_fixtures import with_fixtures as W
from rivalry.plans.registry import register
from rivalry.plans.sqlgen import log_loss_sql, softmax_sql
from rivalry.session import scratch_path, table
from rivalry.sources import io as S


@register("scan_battles_csv", W("""SELECT id, model_a, model_b, prompt, response_a, response_b, winner_model_a,
  winner_model_b, winner_tie FROM bt""", "bt"))
def q_scan_battles_csv(spark, sf):
    path = scratch_path(spark, "battles-csv")
    S.write_csv(fx.battles_text(spark, sf), path)
    return S.read_csv(spark, path, S.BATTLE_SCHEMA)


@register("sink_csv", """WITH t AS (SELECT conv_id, role, text,
  row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
SELECT u.conv_id, u.k, u.text AS prompt, a.text AS response FROM t u JOIN t a
  ON u.conv_id = a.conv_id AND u.k = a.k AND u.role = 'user' AND a.role = 'assistant'""")
def q_sink_csv(spark, sf):
    path = scratch_path(spark, "qa-csv")
    qa = qa_pairs(table(spark, sf, "conversations"))
    S.write_csv(qa, path, escape="\\")
    return S.read_csv(spark, path, "conv_id long, k long, prompt string, response string", escape="\\")


@register("scan_vectors", "SELECT vec_id, embedding FROM embeddings")
def q_scan_vectors(spark, sf):
    path = scratch_path(spark, "vectors")
    S.write_vectors(table(spark, sf, "embeddings"), path, "vec_id", "embedding")
    return S.read_vectors(spark, path, "vec_id", "embedding")


@register("sink_vectors", "SELECT vec_id, label FROM embeddings")
def q_sink_vectors(spark, sf):
    path = scratch_path(spark, "vectors-labels")
    S.write_vectors(table(spark, sf, "embeddings"), path, "vec_id", "embedding", extra="label")
    return S.read_vectors(spark, path, "vec_id", "embedding", extra="label").select("vec_id", "label")


@register("scan_nested_corpus", """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos,
  CASE role WHEN 'user' THEN 'human' ELSE 'gpt' END AS "from", text AS value
FROM conversations WHERE role IN ('user', 'assistant')""")
def q_scan_nested_corpus(spark, sf):
    path = scratch_path(spark, "nested")
    S.nested_corpus(table(spark, sf, "conversations")).write.mode("overwrite").json(path)
    n = S.read_nested_corpus(spark, path)
    return n.select("conv_id", F.posexplode("conversations").alias("pos", "t")).select(
        "conv_id", "pos", F.col("t.from").alias("from"), F.col("t.value").alias("value"))


@register("pair_prior_json", W("""SELECT least(model_a, model_b) AS m0, greatest(model_a, model_b) AS m1,
  CAST(1 + count(*) FILTER (WHERE (label = 0 AND model_a < model_b) OR (label = 1 AND model_b < model_a)) AS BIGINT) AS w0,
  CAST(1 + count(*) FILTER (WHERE (label = 0 AND model_a > model_b) OR (label = 1 AND model_b > model_a)) AS BIGINT) AS w1,
  CAST(1 + count(*) FILTER (WHERE label = 2) AS BIGINT) AS wt
FROM bb WHERE model_a <> model_b GROUP BY 1, 2""", "bb"))
def q_pair_prior_json(spark, sf):
    path = scratch_path(spark, "priors-json")
    S.write_pair_priors(priors.pair_win_counts(fx.battles_big(spark, sf)), path)
    return S.read_pair_priors(spark, path)


_P = softmax_sql(["z0", "z1", "z2"])


@register("sink_submission", W(f"""SELECT id, round({_P[0]}, 6) AS winner_model_a, round({_P[1]}, 6) AS winner_model_b,
  round({_P[2]}, 6) AS winner_tie FROM bb""", "bb"))
def q_sink_submission(spark, sf):
    path = scratch_path(spark, "submission")
    p = metrics.with_probs(fx.battles_big(spark, sf), out=("winner_model_a", "winner_model_b", "winner_tie"))
    sub = p.select("id", *[F.round(c, 6).alias(c) for c in ("winner_model_a", "winner_model_b", "winner_tie")])
    S.write_csv(sub, path)
    return S.read_csv(spark, path, "id long, winner_model_a double, winner_model_b double, winner_tie double")


@register("run_metadata", W(f"""SELECT 'run-1' AS run, param, value, round(avg({log_loss_sql('label', _P)}), 6) AS score
FROM bb, (VALUES ('fold', '0'), ('model', 'softmax-z'), ('seed', '42')) v(param, value) GROUP BY param, value""", "bb"))
def q_run_metadata(spark, sf):
    path = scratch_path(spark, "runs")
    score = metrics.log_loss(metrics.with_probs(fx.battles_big(spark, sf)))
    runs = S.append_run_metadata(spark, path, "run-1", {"fold": "0", "model": "softmax-z", "seed": "42"},
                                 score.select(F.round("log_loss", 6).alias("score")), "score")
    return runs.select("run", F.explode("params").alias("param", "value"), "score")


@register("metrics_log", W("SELECT fold, epoch, step, round(loss, 6) AS loss, round(lr, 9) AS lr FROM ml", "ml"))
def q_metrics_log(spark, sf):
    path = scratch_path(spark, "metrics-log")
    ml = fx.metrics_log(spark, sf)
    for e in (0, 1, 2):  # appended epoch by epoch, as a training loop would
        S.append_metrics(ml.filter(F.col("epoch") == e), path)
    back = spark.read.parquet(path)
    return back.select("fold", "epoch", "step", F.round("loss", 6).alias("loss"), F.round("lr", 9).alias("lr"))
