"""Non-linear 3-D projection by a neighbour graph (ML7).

A bounded hash sample of rows (the landmarks) is joined into a graph of nearest
neighbours; the leading eigenvectors of its normalised Laplacian place the
landmarks, so that what is near along the graph stays near.  Every row is then
placed among its nearest landmarks, in the tasks, by the same weights.  The driver
holds the landmarks and a matrix of their pairs, nothing that grows with the rows.

Defined results: a null vector or entry has no place (null); with no more landmarks
than dimensions the rest of the coordinates is 0; of a coordinate's two signs the
one is taken whose largest entry in absolute value is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


@dataclass
class NeighbourMap:
    landmarks: np.ndarray   # (landmarks, dimensions)
    places: np.ndarray      # (landmarks, 3)
    width: float            # of the weights
    near: int


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0.0))


def _known(vec: str):
    return F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))


def fit(df: DataFrame, key: str, vec: str = "embedding", landmarks: int = 1500, near: int = 12, dim: int = 3) -> NeighbourMap:
    rows = df.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v")).where(_known("v"))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("k"), "k").limit(landmarks).collect()]
    if not sample:
        raise ValueError("no row has a vector")
    x = np.unique(np.array(sample), axis=0)
    n, far = len(x), _distances(x, x)
    order = np.argsort(far, axis=1, kind="stable")[:, 1:near + 1]
    width = float(np.median(np.take_along_axis(far, order, axis=1))) if n > 1 else 1.0
    weight = np.zeros((n, n))
    np.put_along_axis(weight, order, np.exp(-(np.take_along_axis(far, order, axis=1) / max(width, 1e-12)) ** 2), axis=1)
    # either row's neighbour joins the two; a little weight everywhere keeps separate parts of the graph in one picture
    weight = np.maximum(weight, weight.T) + 1e-4 / n
    size = np.sqrt(weight.sum(axis=1))
    _, vectors = np.linalg.eigh(weight / size[:, None] / size)
    places = np.zeros((n, dim))
    found = (vectors[:, ::-1][:, 1:dim + 1] / size[:, None])  # the first one is constant
    places[:, :found.shape[1]] = found / np.maximum(np.abs(found).max(axis=0), 1e-300)
    places *= np.where(places[np.abs(places).argmax(axis=0), np.arange(dim)] < 0, -1.0, 1.0)
    return NeighbourMap(x, places, max(width, 1e-12), min(near, n))


def transform(model: NeighbourMap, df: DataFrame, vec: str = "embedding", out: str = "pc") -> DataFrame:
    """``df`` with the place ``out`` (array<double>) of every row."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def placed(x: pd.Series) -> pd.Series:
        known = [v is not None and not np.isnan(np.asarray(v, float)).any() for v in x]
        result = [None] * len(x)
        at = np.flatnonzero(known)
        for a in range(0, len(at), 1024):
            part = at[a:a + 1024]
            far = _distances(np.stack([np.asarray(x.iloc[i], float) for i in part]), model.landmarks)
            order = np.argpartition(far, model.near - 1, axis=1)[:, :model.near]
            d = np.take_along_axis(far, order, axis=1)
            # relative to the nearest, so that rows far from all landmarks have weights as well
            w = np.exp(-(d / model.width) ** 2 + (d.min(axis=1, keepdims=True) / model.width) ** 2)
            for i, p in zip(part, (w[:, :, None] * model.places[order]).sum(axis=1) / w.sum(axis=1)[:, None]):
                result[i] = p
        return pd.Series(result, dtype=object)

    return df.withColumn(out, placed(F.col(vec).cast("array<double>")))
