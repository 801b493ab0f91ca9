"""Batch inference and tabular ML on vectors (ML1-ML8, S10), re-aimed at Spark ML.

* ML1 scoring goes through ``predict_batch_udf``: the user's model is a
  callable loaded once per Python worker and fed Arrow batches of a fixed size;
  ``text_features.train_scorer`` trains one.
* ML2 embeddings are learned from the corpus (``text_features.fit_embedder``); a
  user embedder plugs in through the same batch UDF.
* ML3 and ML4 are ``boosting`` and ``kernel_svm``, ML6 is ``text_features``, ML7
  ``projection``, ML5 a Spark ML estimator; ML8 scores every row by models that never saw it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.functions.probs import softmax
from rivalry.operators import boosting, kernel_svm, projection, text_features
from rivalry.session import cut_lineage


def batch_score(df: DataFrame, make_model: Callable, text: str = "text", batch_size: int = 8, out=("A", "B", "tie")) -> DataFrame:
    """ML1: logits from a batched model, then softmax probabilities."""
    udf = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=None)
    d = df.withColumn("_logits", udf(F.coalesce(F.col(text), F.lit(""))))
    zs = [F.col("_logits")[i].cast("double") for i in range(3)]
    return d.withColumns(dict(zip(out, softmax(*zs)))).drop("_logits")


def batch_embed(df: DataFrame, text: str = "text", dim: int = 64, out: str = "embedding", embedder: text_features.Embedder | None = None) -> DataFrame:
    """ML2: unit vectors of an embedder, learned from ``df`` itself when none is given."""
    embedder = embedder or text_features.fit_embedder(df, text, dim)
    return embedder.transform(df, text, out)


def vector_frame(df: DataFrame, vec: str = "embedding", label: str | None = "label") -> DataFrame:
    d = df.withColumn("features", array_to_vector(vec))
    return d.withColumn("label", F.col(label).cast("double")) if label else d


def fit_boosted(train: DataFrame, id_col: str = "vec_id", watch_mod: int = 10, params: boosting.Params | None = None) -> boosting.Model:
    """Boosted trees; every ``watch_mod``-th row (by a hash of its id) is watched for early stopping."""
    watched = F.pmod(F.xxhash64(id_col), F.lit(watch_mod)) == 0
    return boosting.fit(train.where(~watched), train.where(watched), id_col, params=params)


def gbm_classify(train: DataFrame, valid: DataFrame, id_col: str = "vec_id", params: boosting.Params | None = None) -> DataFrame:
    """ML3: boosted trees on the multiclass log loss."""
    return boosting.predict(fit_boosted(train, id_col, params=params), valid)


def svm_classify(train: DataFrame, valid: DataFrame, id_col: str = "vec_id", c: float = 25.0, gamma: float | str = "scale") -> DataFrame:
    """ML4: support-vector machines with a radial kernel and probabilities."""
    return kernel_svm.predict(kernel_svm.fit(train, id_col, c=c, gamma=gamma), valid)


def out_of_fold(df: DataFrame, key: str, k: int, fit: Callable[[DataFrame], object], predict: Callable[[object, DataFrame], DataFrame]) -> DataFrame:
    """ML8: every row of ``df`` scored by a model that never saw it.  Rows are
    dealt to ``k`` folds by a hash of ``key``; each fold is predicted by the model
    fitted on the others.  Rows that share a key share a fold."""
    fold = F.pmod(F.xxhash64(key), F.lit(k))
    parts = [predict(fit(df.where(fold != i)), df.where(fold == i)) for i in range(k)]
    return cut_lineage(reduce(DataFrame.unionByName, parts), "out-of-fold")


def linear_head(train: DataFrame, valid: DataFrame, reg: float = 0.01) -> DataFrame:
    """ML5: multinomial logistic regression head with class probabilities."""
    return fit_linear(train, reg).transform(valid)


def fit_linear(train: DataFrame, reg: float = 0.01):
    return LogisticRegression(family="multinomial", regParam=reg, maxIter=100).fit(train)


def project_3d(df: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """ML7: 3-D projection that keeps neighbours together, for inspection."""
    return projection.transform(projection.fit(df, key, vec), df, vec)


def project_linear(df: DataFrame, vec: str = "embedding", k: int = 3) -> DataFrame:
    """Principal components (``pc``), the linear projection."""
    d = df.withColumn("_f", array_to_vector(vec))
    return PCA(k=k, inputCol="_f", outputCol="_pc").fit(d).transform(d).withColumn("pc", vector_to_array("_pc")).drop("_f", "_pc")


def fit_and_store(train: DataFrame, path: str, id_col: str = "vec_id", params: boosting.Params | None = None) -> boosting.Model:
    """Fit boosted trees, store them as a plain table, read them back (the
    stored artefact is what scoring uses)."""
    boosting.save(fit_boosted(train, id_col, params=params), train.sparkSession, path)
    return boosting.load(train.sparkSession, path)
