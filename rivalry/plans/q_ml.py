"""Registered queries: batch scoring, embeddings and models (rows and metric floors)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rivalry.functions.probs import argmax
from rivalry.operators import boosting, combine, labels, ml, text_features
from rivalry.plans import fixtures as fx
from rivalry.plans.corpus import render_text
from rivalry.plans.registry import register
from rivalry.plans.sqlgen import tokens_sql
from rivalry.session import scratch_path, table


def _split(spark, sf):
    # learnable 3-class target derived from the vectors (the shipped labels are noise)
    e = table(spark, sf, "embeddings").withColumn(
        "label", argmax(*[F.col("embedding")[i] for i in range(3)]))
    d = ml.vector_frame(e)
    return d.filter(F.col("vec_id") % 5 != 0), d.filter(F.col("vec_id") % 5 == 0)


@register("batch_score")
def q_batch_score(spark, sf):
    # the scorer is trained on the battles' labels; each battle is scored by the one that did not see it
    bt = labels.label_from_flags(render_text(fx.battles_text(spark, sf))).select("id", "text", "label")
    s = ml.out_of_fold(bt, "id", 2, text_features.train_scorer, lambda model, rows: ml.batch_score(rows, model))
    return s.select("id", *[F.round(c, 6).alias(c) for c in ("A", "B", "tie")])


@register("batch_embed")
def q_batch_embed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return ml.batch_embed(docs).select("doc_id", F.size("embedding").alias("dim"),
                                       F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6)
                                       .alias("norm_sq"))


@register("gbm_classify")
def q_gbm_classify(spark, sf):
    train, valid = _split(spark, sf)
    return ml.gbm_classify(train, valid).select("vec_id", "label", "prediction", *[F.round(f"p{i}", 6).alias(f"p{i}") for i in range(3)])


@register("svm_classify")
def q_svm_classify(spark, sf):
    train, valid = _split(spark, sf)
    return ml.svm_classify(train, valid).select("vec_id", "label", "prediction", *[F.round(f"p{i}", 6).alias(f"p{i}") for i in range(3)])


@register("linear_head")
def q_linear_head(spark, sf):
    train, valid = _split(spark, sf)
    p = ml.linear_head(train, valid)
    return p.select("vec_id", "label", "prediction", vector_to_array("probability").alias("probability"))


_VOCABULARY = f"""t AS (SELECT doc_id, unnest({tokens_sql('lower(text)')}) AS token FROM documents),
n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT token, df, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM (SELECT token, count(DISTINCT doc_id) AS df FROM t GROUP BY token), n
  WHERE df >= 2 AND df <= 0.9 * n)"""


@register("tfidf_vocabulary", f"WITH {_VOCABULARY} SELECT token, df, round(idf, 6) AS idf FROM v")
def q_tfidf_vocabulary(spark, sf):
    docs = table(spark, sf, "documents").select("text")
    v = text_features.vocabulary(docs, min_df=2, max_df=0.9)
    return v.select("token", "df", F.round("idf", 6).alias("idf"))


@register("tfidf_features", f"""WITH {_VOCABULARY}, w AS (SELECT doc_id, token, count(*) * any_value(idf) AS w FROM t JOIN v USING (token) GROUP BY 1, 2),
s AS (SELECT doc_id, count(*) AS nnz, sum(w) / sqrt(sum(w * w)) AS total, max(w) / sqrt(sum(w * w)) AS largest FROM w GROUP BY 1)
SELECT doc_id, coalesce(nnz, 0) AS nnz, round(coalesce(total, 0), 5) AS total, round(coalesce(largest, 0), 5) AS largest
FROM documents LEFT JOIN s USING (doc_id)""")
def q_tfidf_features(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = text_features.fit_tfidf(docs, min_df=2, max_df=0.9)
    w = text_features.sparse_entries(model.transform(docs), "doc_id")
    total = F.aggregate("weight", F.lit(0.0), lambda a, x: a + x)
    return w.select("doc_id", F.size("weight").cast("long").alias("nnz"), F.round(total, 5).alias("total"),
                    F.round(F.coalesce(F.array_max("weight"), F.lit(0.0)), 5).alias("largest"))


@register("project_3d")
def q_project_3d(spark, sf):
    p = ml.project_3d(table(spark, sf, "embeddings"))
    return p.select("vec_id", F.transform("pc", lambda x: F.round(x, 5)).alias("pc"))


@register("predictions_as_features")
def q_predictions_as_features(spark, sf):
    # stack on the scores of two models and the length; every battle is scored out of fold
    bb = fx.battles_big(spark, sf)
    x = F.array(*[F.col(c).cast("double") for c in ("z0", "z1", "z2", "g0", "g1", "g2")], F.log1p("len"))
    corpus = ml.vector_frame(bb.select("id", "label", x.alias("embedding")))
    p = ml.out_of_fold(corpus, "id", 5, ml.fit_linear, lambda model, rows: model.transform(rows).select("id", vector_to_array("probability").alias("p")))
    path = scratch_path(spark, "stacked-preds")
    p.select("id", *[F.col("p")[i].alias(n) for i, n in enumerate(("A_log", "B_log", "tie_log"))]).write.mode("overwrite").parquet(path)
    return combine.left_join_predictions(bb.select("id", "label"), spark.read.parquet(path))


@register("model_store")
def q_model_store(spark, sf):
    train, valid = _split(spark, sf)
    model = ml.fit_and_store(train, scratch_path(spark, "model"), params=boosting.Params(max_rounds=20))
    return boosting.predict(model, valid).select("vec_id", "label", "prediction")
