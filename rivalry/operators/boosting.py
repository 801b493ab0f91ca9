"""Multiclass gradient boosting on histograms (ML3).

One model for all classes on the multiclass log loss: each round grows one tree
per class from the shared softmax probabilities.  Rows stay in Spark: a level of
all trees of a round is one job that sums gradients, Hessians and row counts by
(class, node, feature, bin) inside the tasks, adds them up with the vector sum
of ``Summarizer`` and finds the best split of each block of features on the
executors; the driver receives one candidate per (class, node, block).  The same
job measures the log loss of the training and the watched rows, which stops the
rounds after ``patience`` rounds without a new minimum.

Features are cut into at most ``max_bin`` bins at quantiles of a hash sample
(``edge_rows`` rows, or fewer for wide vectors) and stored as one byte each.  Scores are stored every
``refresh`` rounds, so that a round applies only the trees since then.

Defined results: rows without a label take no part in training; a null vector,
a null or NaN entry counts as smaller than every edge; equal gains go to the
lower feature, then the lower bin; a class without a useful split gets a single
leaf; probabilities sum to 1 and follow the order of ``classes``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rivalry.session import cut_lineage

FEATURE_BLOCK = 64
EDGE_BYTES = 64 << 20


@dataclass(frozen=True)
class Params:
    max_rounds: int = 60
    learning_rate: float = 0.3
    max_depth: int = 3
    max_bin: int = 64
    reg_lambda: float = 1.3
    reg_alpha: float = 0.1
    min_rows: int = 5            # rows on either side of a split
    feature_fraction: float = 0.8   # features a tree may use
    extra_trees: bool = False    # one random threshold per node and feature instead of all
    patience: int = 8
    seed: int = 42
    edge_rows: int = 50_000
    refresh: int = 8
    max_classes: int = 256


@dataclass
class Model:
    """Trees as complete binary arrays: node i has children 2i+1 and 2i+2; rows
    with a bin above ``cut`` go right; an unsplit node sends all rows left."""
    classes: list
    edges: list[np.ndarray]
    start: np.ndarray                                    # initial score of each class
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)   # per round: (classes, 2^depth - 1)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)      # per round: (classes, 2^depth)
    log: list[tuple[int, float, float]] = field(default_factory=list)  # round, training loss, watched loss
    best_round: int = 0

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            # NaN sorts behind every edge in searchsorted; it belongs before them
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], side="left"))
        return out

    def scores(self, bins: np.ndarray, first: int, last: int) -> np.ndarray:
        """Scores that rounds first <= r < last add."""
        out = np.zeros((len(bins), len(self.classes)))
        for r in range(first, last):
            for c in range(len(self.classes)):
                out[:, c] += self.leaf[r][c][_leaves(bins, self.feature[r][c], self.cut[r][c], self.depth)]
        return out

    def rows(self) -> list[tuple]:
        """The model as a plain table (kind, round, class, node, feature, value)."""
        out = [("depth", None, None, None, None, float(self.depth)), ("best_round", None, None, None, None, float(self.best_round))]
        out += [("class", None, c, None, None, float(v)) for c, v in enumerate(self.classes)]
        out += [("start", None, c, None, None, float(v)) for c, v in enumerate(self.start)]
        out += [("edge", None, None, k, j, float(v)) for j, e in enumerate(self.edges) for k, v in enumerate(e)]
        out += [("features", None, None, None, None, float(len(self.edges)))]
        for r in range(len(self.leaf)):
            for c in range(len(self.classes)):
                out += [("split", r, c, i, int(j), float(b)) for i, (j, b) in enumerate(zip(self.feature[r][c], self.cut[r][c]))]
                out += [("leaf", r, c, i, None, float(v)) for i, v in enumerate(self.leaf[r][c])]
        out += [("train_loss", r, None, None, None, t) for r, t, _ in self.log] + [("watch_loss", r, None, None, None, w) for r, _, w in self.log]
        return out


_MODEL_DDL = "kind string, round int, class int, node int, feature int, value double"


def save(model: Model, spark: SparkSession, path: str) -> None:
    spark.createDataFrame(model.rows(), _MODEL_DDL).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    """The rows of one stored model (its size is rounds x classes x nodes)."""
    by: dict[str, list] = {}
    for r in spark.read.schema(_MODEL_DDL).parquet(path).collect():
        by.setdefault(r["kind"], []).append(r)
    depth, n_features = int(by["depth"][0]["value"]), int(by["features"][0]["value"])
    classes = [r["value"] for r in sorted(by["class"], key=lambda r: r["class"])]
    start = np.array([r["value"] for r in sorted(by["start"], key=lambda r: r["class"])])
    edges: list[list] = [[] for _ in range(n_features)]
    for r in sorted(by.get("edge", []), key=lambda r: r["node"]):
        edges[r["feature"]].append(r["value"])
    rounds = 1 + max((r["round"] for r in by.get("leaf", [])), default=-1)
    model = Model(classes, [np.array(e) for e in edges], start, depth, best_round=int(by["best_round"][0]["value"]))
    for store, kind, width, dtype in ((model.feature, "split", 2 ** depth - 1, np.int64), (model.cut, "split", 2 ** depth - 1, np.int64),
                                      (model.leaf, "leaf", 2 ** depth, np.float64)):
        store += [np.zeros((len(classes), width), dtype) for _ in range(rounds)]
        for r in by.get(kind, []):
            store[r["round"]][r["class"], r["node"]] = r["feature"] if store is model.feature else r["value"]
    train = {r["round"]: r["value"] for r in by.get("train_loss", [])}
    watch = {r["round"]: r["value"] for r in by.get("watch_loss", [])}
    model.log = [(r, train[r], watch[r]) for r in sorted(train)]
    return model


def _leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        at = 2 * at + 1 + (bins[rows, feature[at]] > cut[at])
    return at - (2 ** depth - 1)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal length as one matrix; a null row or entry is NaN."""
    if column.null_count == 0 and column.values.null_count == 0:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) == width * len(column):
            return flat.reshape(len(column), width).astype(np.float64)
    return np.array([[np.nan if v is None else v for v in r] if r is not None else [np.nan] * width for r in column.to_pylist()],
                    np.float64).reshape(len(column), width)


def _as_array(df: DataFrame, name: str):
    return F.col(name).cast("array<double>") if dict(df.dtypes)[name].startswith("array") else vector_to_array(name)


def _edges(rows: DataFrame, key: str, p: Params) -> list[np.ndarray]:
    width = rows.where("x IS NOT NULL").select(F.size("x")).first()
    if width is None:
        raise ValueError("no training row has a vector")
    n = max(1, min(p.edge_rows, EDGE_BYTES // (8 * max(1, width[0]))))
    sample = rows.where("x IS NOT NULL").select("x").orderBy(F.xxhash64(key), key).limit(n).toPandas()["x"]
    x = np.array([[np.nan if v is None else v for v in r] for r in sample], np.float64)
    at = np.linspace(0, 1, p.max_bin + 1)[1:-1]
    edges = []
    for j in range(x.shape[1]):
        known = x[~np.isnan(x[:, j]), j]
        edges.append(np.unique(np.quantile(known, at, method="inverted_cdf")) if len(known) else np.empty(0))
    return edges


def _gain(g: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    g = np.sign(g) * np.maximum(np.abs(g) - p.reg_alpha, 0.0)
    return g * g / (h + p.reg_lambda)


def _value(g: float, h: float, p: Params) -> float:
    return float(-p.learning_rate * np.sign(g) * max(abs(g) - p.reg_alpha, 0.0) / (h + p.reg_lambda))


def _histograms(table: DataFrame, model: Model, first: int, grown: list, level: int, p: Params) -> DataFrame:
    """cls, block, sums: (nodes, features of the block, bins, 3) added over the
    task's rows; cls -1 holds the losses (training, watched) and their rows."""
    n_features, n_bins, nodes = len(model.edges), p.max_bin, 2 ** level
    last, n_classes = len(model.leaf), len(model.classes)
    schema = pa.schema([("cls", pa.int32()), ("block", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        loss = np.zeros(4)
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, n_features)
            score = batch.column("score").flatten().to_numpy().reshape(n, n_classes) + model.scores(bins, first, last)
            prob, label, watched = _softmax(score), batch.column("cls").to_numpy(), batch.column("watched").to_numpy(zero_copy_only=False)
            if level == 0:
                row_loss = -np.log(np.maximum(prob[np.arange(n), label], 1e-300))
                loss += [row_loss[~watched].sum(), (~watched).sum(), row_loss[watched].sum(), watched.sum()]
            own = ~watched
            bins, prob, label = bins[own], prob[own], label[own]
            at = [_leaves(bins, *grown[c], level) for c in range(n_classes)]
            for block, j0 in enumerate(range(0, n_features, FEATURE_BLOCK)):
                part = bins[:, j0:j0 + FEATURE_BLOCK].astype(np.int64)
                width = part.shape[1]
                for c in range(n_classes):
                    g = prob[:, c] - (label == c)
                    h = prob[:, c] * (1 - prob[:, c])
                    slot = ((at[c][:, None] * width + np.arange(width)) * n_bins + part).ravel()
                    size = nodes * width * n_bins
                    got = np.stack([np.bincount(slot, np.repeat(w, width), size) for w in (g, h, np.ones(len(g)))], axis=1)
                    key = (c, block)
                    if key in sums:
                        sums[key] += got
                    else:
                        sums[key] = got
        out = [(c, b, s.ravel()) for (c, b), s in sums.items()]
        if level == 0:
            out.append((-1, 0, loss))
        for c, b, s in out:
            yield pa.record_batch([pa.array([c], pa.int32()), pa.array([b], pa.int32()), pa.array([s], schema.field("sums").type)], schema=schema)

    return table.mapInArrow(run, "cls int, block int, sums array<double>")


def _best_splits(total: DataFrame, model: Model, level: int, round_: int, allowed: list[np.ndarray], p: Params) -> DataFrame:
    """One row per (class, node, block): the best split and the sums on both sides."""
    n_features, n_bins, nodes = len(model.edges), p.max_bin, 2 ** level
    usable = [len(e) for e in model.edges]
    schema = pa.schema([("cls", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("bin", pa.int32()),
                        ("sums", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            rows = []
            for c, block, sums in zip(*(batch.column(x).to_pylist() for x in ("cls", "block")), batch.column("sums")):
                values = sums.values.to_numpy()
                if c < 0:
                    rows.append((c, 0, 0.0, 0, 0, values))
                    continue
                j0 = block * FEATURE_BLOCK
                width = min(FEATURE_BLOCK, n_features - j0)
                left = values.reshape(nodes, width, n_bins, 3).cumsum(axis=2)
                both = left[:, :, -1:, :]
                right = both - left
                gain = _gain(left[..., 0], left[..., 1], p) + _gain(right[..., 0], right[..., 1], p) - _gain(both[..., 0], both[..., 1], p)
                fits = (left[..., 2] >= p.min_rows - 0.5) & (right[..., 2] >= p.min_rows - 0.5)
                fits &= np.arange(n_bins) < np.array(usable[j0:j0 + width])[:, None]
                fits &= allowed[c][j0:j0 + width, None]
                if p.extra_trees:
                    rng = np.random.default_rng([p.seed, round_, c, level, block])
                    chosen = (rng.random((nodes, width)) * np.maximum(usable[j0:j0 + width], 1)).astype(int)
                    fits &= np.arange(n_bins) == chosen[..., None]
                gain = np.where(fits, gain, -np.inf).reshape(nodes, -1)
                best = gain.argmax(axis=1)
                for node, k in enumerate(best.tolist()):
                    j, b = divmod(k, n_bins)
                    side = left[node, j, b] if np.isfinite(gain[node, k]) else np.zeros(3)
                    rows.append((c, node, gain[node, k], j0 + j, b, np.concatenate([side, both[node, 0, 0]])))
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return total.mapInArrow(run, "cls int, node int, gain double, feature int, bin int, sums array<double>")


def fit(train: DataFrame, watch: DataFrame, key: str, vec: str = "features", label: str = "label", params: Params | None = None) -> Model:
    """``train`` grows the trees, the log loss of ``watch`` stops them.  Rows of
    ``watch`` with a label that ``train`` does not have are left out."""
    p = params or Params()
    if not 2 <= p.max_bin <= 256:
        raise ValueError("max_bin must be between 2 and 256")

    def rows(df, watched):
        return df.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), _as_array(df, vec).alias("x"),
                                                         F.col(label).cast("double").alias("y"), F.lit(watched).alias("watched"))

    train, watch = rows(train, False), rows(watch, True)
    counts = train.groupBy("y").count().orderBy("y").limit(p.max_classes + 1).collect()
    if not 1 < len(counts) <= p.max_classes:
        raise ValueError(f"{len(counts)} classes: between 2 and {p.max_classes} are wanted")
    classes, n = [r["y"] for r in counts], sum(r["count"] for r in counts)
    model = Model(classes, _edges(train, "key", p), np.log(np.array([r["count"] / n for r in counts])), p.max_depth)
    n_features, n_classes = len(model.edges), len(classes)

    def binned(batches):
        index = {c: i for i, c in enumerate(classes)}
        for batch in batches:
            b = model.bins(_matrix(batch.column("x"), n_features))
            yield pa.record_batch([pa.array([r.tobytes() for r in b], pa.binary()), pa.array([index[y] for y in batch.column("y").to_pylist()], pa.int32()),
                                   batch.column("watched"), pa.array([model.start] * len(b), pa.list_(pa.float64()))],
                                  names=["bins", "cls", "watched", "score"])

    def advanced(first, last):
        def run(batches):
            for batch in batches:
                n = batch.num_rows
                b = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, n_features)
                s = batch.column("score").flatten().to_numpy().reshape(n, n_classes) + model.scores(b, first, last)
                yield pa.record_batch([*(batch.column(c) for c in ("bins", "cls", "watched")), pa.array(list(s), pa.list_(pa.float64()))],
                                      names=["bins", "cls", "watched", "score"])
        return run

    ddl = "bins binary, cls int, watched boolean, score array<double>"
    known = train.unionByName(watch.where(F.col("y").isin(classes)))
    table = cut_lineage(known.mapInArrow(binned, ddl), "boost-rows")
    stored, rng, best = 0, np.random.default_rng(p.seed), None
    while True:
        r = len(model.leaf)
        if r - stored >= p.refresh:
            table = cut_lineage(table.mapInArrow(advanced(stored, r), ddl), "boost-rows")
            stored = r
        width = 2 ** p.max_depth - 1
        feature, cut = np.zeros((n_classes, width), np.int64), np.full((n_classes, width), 256)
        own = np.zeros((n_classes, width + 2 ** p.max_depth, 2))  # gradient and Hessian of every node
        n_used = max(1, round(p.feature_fraction * n_features))
        allowed = [np.isin(np.arange(n_features), rng.choice(n_features, n_used, replace=False)) for _ in classes]
        for level in range(p.max_depth):
            sums = _histograms(table, model, stored, [(feature[c], cut[c]) for c in range(n_classes)], level, p)
            total = sums.groupBy("cls", "block").agg(Summarizer.sum(array_to_vector("sums")).alias("s")).select("cls", "block", vector_to_array("s").alias("sums"))
            found: dict[tuple, tuple] = {}
            for cls, node, gain, j, b, s in _best_splits(total, model, level, r, allowed, p).collect():
                if cls < 0:
                    model.log.append((r, s[0] / max(s[1], 1), s[2] / s[3] if s[3] else s[0] / max(s[1], 1)))
                    continue
                now = found.get((cls, node))
                if now is None or (gain, -j) > (now[0], -now[1]):
                    found[cls, node] = (gain, j, b, s)
            if level == 0 and _done(model, p):
                return model
            for (cls, node), (gain, j, b, s) in found.items():
                at = 2 ** level - 1 + node
                own[cls, at] = s[3:5]
                if gain > 1e-9:
                    feature[cls, at], cut[cls, at] = j, b
                    own[cls, 2 * at + 1], own[cls, 2 * at + 2] = s[0:2], (s[3] - s[0], s[4] - s[1])
                else:  # all rows go left
                    own[cls, 2 * at + 1] = s[3:5]
        leaf = np.array([[_value(g, h, p) for g, h in own[c, width:]] for c in range(n_classes)])
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)


def _done(model: Model, p: Params) -> bool:
    """Sets the best round so far (the first of equal ones); true when rounds end."""
    model.best_round = min(model.log, key=lambda x: (x[2], x[0]))[0]
    r = model.log[-1][0]
    return r >= p.max_rounds or r - model.best_round >= p.patience


def predict(model: Model, df: DataFrame, vec: str = "features", out: str = "p") -> DataFrame:
    """``df`` with ``out``0, ``out``1, ... (probabilities in the order of
    ``classes``, using the trees up to the best round) and ``prediction``."""
    width, names = len(model.edges), [f"{out}{i}" for i in range(len(model.classes))]

    @F.pandas_udf(ArrayType(DoubleType()))
    def probabilities(x: pd.Series) -> pd.Series:
        m = np.array([[np.nan if v is None else v for v in r] if r is not None else [np.nan] * width for r in x], np.float64).reshape(len(x), width)
        b = model.bins(m)
        return pd.Series(list(_softmax(model.start + model.scores(b, 0, model.best_round))))

    d = df.withColumn("_p", probabilities(_as_array(df, vec)))
    d = d.withColumns({name: F.col("_p")[i] for i, name in enumerate(names)})
    classes = F.array(*[F.lit(float(c)) for c in model.classes])
    return d.withColumn("prediction", F.element_at(classes, F.array_position("_p", F.array_max("_p")).cast("int"))).drop("_p")
