"""Support-vector classification with a radial kernel and probabilities (ML4).

The kernel exp(-gamma |x - y|^2) is replaced by the inner product of Nystroem
features: the kernel values of a row with a bounded hash sample of training rows
(the landmarks), turned so that the kernel among the landmarks is exact.  They are
computed row by row; one linear support-vector machine per class (Spark ML) is
then trained on them.  A share of the rows, dealt
by a hash of the key, is kept out of that training: their margins calibrate one
sigmoid per class (Newton steps, one aggregate of all classes a step), and the
sigmoids of a row are scaled to sum to 1.

Defined results: rows without a label or with a null vector or entry take no part
in training; such a vector has null probabilities and prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, OneVsRest, OneVsRestModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rivalry.session import cut_lineage

MAX_CLASSES = 256


@dataclass
class KernelSvm:
    classes: list[float]
    gamma: float
    landmarks: np.ndarray           # (features, dimensions)
    turn: np.ndarray                # (features, features): inverse root of the landmarks' kernel
    margins: OneVsRestModel
    sigmoids: list[tuple[float, float]]  # slope and intercept of each class


def _vector(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("array<double>") if dict(df.dtypes)[name].startswith("array") else vector_to_array(name)


def _whole(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.exists(name, lambda x: x.isNull() | F.isnan(x))


def scale_gamma(rows: DataFrame, col: str = "_x") -> float:
    """1 / (dimensions x variance of all entries)."""
    v = rows.select(array_to_vector(col).alias("v")).agg(Summarizer.mean(F.col("v")).alias("m"), Summarizer.variance(F.col("v")).alias("s")).first()
    mean, var = v["m"].toArray(), v["s"].toArray()
    spread = float(var.mean() + mean.var())
    return 1.0 / (len(mean) * spread) if spread > 0 else 1.0


def _kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    far = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(far, 0.0))


def _turn(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks, gamma))
    known = values > 1e-8 * values.max()
    return (vectors[:, known] / np.sqrt(values[known])) @ vectors[:, known].T


def _mapped(df: DataFrame, landmarks: np.ndarray, turn: np.ndarray, gamma: float) -> DataFrame:
    @F.pandas_udf(ArrayType(DoubleType()))
    def features(x: pd.Series) -> pd.Series:
        return pd.Series(list(_kernel(np.stack(x.to_list()), landmarks, gamma) @ turn) if len(x) else [], dtype=object)

    return df.withColumn("features", array_to_vector(features("_x")))


def _calibrated(margins: DataFrame, n_classes: int, steps: int = 50) -> list[tuple[float, float]]:
    """Slope and intercept per class: the sigmoid of the margin fits whether a
    row is of the class, with the usual targets (n+ + 1) / (n+ + 2) and 1 / (n- + 2)."""
    counts = {r["y"]: r["count"] for r in margins.groupBy("y").count().collect()}
    n = sum(counts.values())
    at = []
    for c in range(n_classes):
        yes = counts.get(c, 0)
        at.append([1.0, float(np.log((yes + 1) / (n - yes + 1)))])
    goal = [((counts.get(c, 0) + 1) / (counts.get(c, 0) + 2), 1 / (n - counts.get(c, 0) + 2)) for c in range(n_classes)]
    for _ in range(steps):
        sums = []
        for c, (a, b) in enumerate(at):
            m = F.col("m")[c]
            p = 1 / (1 + F.exp(-(a * m + b)))
            miss, w = p - F.when(F.col("y") == c, goal[c][0]).otherwise(goal[c][1]), p * (1 - p)
            sums.append(F.array(*[F.avg(x) for x in (miss * m, miss, w * m * m, w * m, w)]).alias(f"c{c}"))
        found = margins.agg(*sums).first()
        largest = 0.0
        for c in range(n_classes):
            ga, gb, haa, hab, hbb = found[c]
            step = np.linalg.solve([[haa + 1e-9, hab], [hab, hbb + 1e-9]], [ga, gb])
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            at[c][0] -= float(step[0])
            at[c][1] -= float(step[1])
            largest = max(largest, float(np.abs(step).max()))
        if largest < 1e-7:
            break
    return [(a, b) for a, b in at]


def fit(train: DataFrame, key: str, vec: str = "features", label: str = "label", c: float = 25.0, gamma: float | str = "scale",
        n_features: int = 512, keep_out: int = 5, max_iter: int = 60, tol: float = 1e-4, seed: int = 42) -> KernelSvm:
    """``c`` weighs the hinge losses, ``gamma`` the squared distance ("scale": by
    the variance); at most ``n_features`` rows are landmarks; one row in
    ``keep_out`` calibrates the probabilities."""
    rows = train.select(F.col(key).alias("_key"), _vector(train, vec).alias("_x"), F.col(label).cast("double").alias("_y")).where(_whole("_x") & F.col("_y").isNotNull())
    found = rows.groupBy("_y").count().orderBy("_y").limit(MAX_CLASSES + 1).collect()
    if not 1 < len(found) <= MAX_CLASSES:
        raise ValueError(f"{len(found)} classes: between 2 and {MAX_CLASSES} are wanted")
    classes = [r["_y"] for r in found]
    gamma = scale_gamma(rows) if gamma == "scale" else float(gamma)
    sample = rows.orderBy(F.xxhash64("_key", F.lit(seed)), "_key").limit(n_features).collect()
    landmarks = np.unique(np.array([r["_x"] for r in sample]), axis=0)
    turn = _turn(landmarks, gamma)
    number = (F.array_position(F.array(*[F.lit(x) for x in classes]), F.col("_y")) - 1).cast("double")
    mapped = cut_lineage(_mapped(rows.select("_x", number.alias("label"), (F.pmod(F.xxhash64("_key"), F.lit(keep_out)) == 0).alias("_held")), landmarks, turn, gamma)
                         .select("features", "label", "_held"), "svm-rows")
    n = mapped.where("NOT _held").count()
    svm = LinearSVC(regParam=1.0 / (c * max(n, 1)), maxIter=max_iter, tol=tol)
    margins = OneVsRest(classifier=svm, parallelism=4).fit(mapped.where("NOT _held").select("features", "label"))
    held = margins.transform(mapped.where("_held")).select(F.col("label").cast("int").alias("y"), vector_to_array("rawPrediction").alias("m"))
    return KernelSvm(classes, gamma, landmarks, turn, margins, _calibrated(cut_lineage(held, "svm-margins"), len(classes)))


def predict(model: KernelSvm, df: DataFrame, vec: str = "features", out: str = "p") -> DataFrame:
    """``df`` with ``out``0, ``out``1, ... (in the order of ``classes``) and ``prediction``."""
    rows = df.withColumn("_all", F.struct(*[F.col(f"`{c}`") for c in df.columns])).select("_all", _vector(df, vec).alias("_x"))
    scored = model.margins.transform(_mapped(rows.where(_whole("_x")), model.landmarks, model.turn, model.gamma))
    m = vector_to_array("rawPrediction")
    scored = scored.select("_all", m.alias("_m"))
    p = [1 / (1 + F.exp(-(a * F.col("_m")[i] + b))) for i, (a, b) in enumerate(model.sigmoids)]
    scored = scored.select("_all", F.array(*p).alias("_p"))
    total = F.aggregate("_p", F.lit(0.0), lambda s, x: s + x)
    scored = scored.select("_all", F.when(total > 0, F.transform("_p", lambda x: x / total)).otherwise(F.transform("_p", lambda x: F.lit(1.0 / len(p)))).alias("_p"))
    missing = rows.where(~_whole("_x")).select("_all", F.lit(None).cast("array<double>").alias("_p"))
    classes = F.array(*[F.lit(c) for c in model.classes])
    best = F.element_at(classes, F.array_position("_p", F.array_max("_p")).cast("int"))
    return scored.unionByName(missing).select("_all.*", *[F.get("_p", F.lit(i)).alias(f"{out}{i}") for i in range(len(p))], best.alias("prediction"))
