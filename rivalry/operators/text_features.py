"""Text features: TF-IDF over a distributed vocabulary, stacking with dense
columns, learned embeddings and a trained text scorer (ML1, ML2, ML6).

The vocabulary is one grouped count of documents per token; tokens in fewer than
``min_df`` documents or more than a ``max_df`` share are left out, and at most
``max_features`` (those in most documents) are kept, which bounds everything the
driver and the tasks hold.  Weights are count x idf, idf = ln((1 + n) / (1 + df)) + 1,
rows scaled to length 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rivalry.functions.text import TOKEN_PATTERN, tokens
from rivalry.session import cut_lineage, small_batches

MAX_FEATURES = 1 << 18
TERM_BLOCK = 256
SLICE_TOKENS = 1 << 14  # a worker holds the directions of so many tokens at a time, or of one longer row


def lower_tokens(text: str):
    return tokens(F.lower(F.col(text)))


def vocabulary(df: DataFrame, text: str = "text", min_df: int = 1, max_df: float = 1.0, max_features: int = MAX_FEATURES) -> DataFrame:
    """token, df (documents that hold it) and idf; a null text counts as a document without tokens."""
    n = df.count()
    counts = df.select(F.explode(F.array_distinct(lower_tokens(text))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    kept = counts.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n)).orderBy(F.desc("df"), "token").limit(max_features)
    return kept.select("token", "df", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))


@dataclass
class Tfidf:
    tokens: list[str]
    idf: np.ndarray

    def transform(self, df: DataFrame, text: str = "text", out: str = "tfidf") -> DataFrame:
        """``df`` with the sparse vector ``out`` (JVM transformers); tokens outside the vocabulary count for nothing."""
        d = df.withColumn("_tokens", lower_tokens(text))
        counts = CountVectorizerModel.from_vocabulary(self.tokens, inputCol="_tokens", outputCol="_counts")
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weights")
        unit = Normalizer(p=2.0, inputCol="_weights", outputCol=out)
        return unit.transform(weigh.transform(counts.transform(d))).drop("_tokens", "_counts", "_weights")


def fit_tfidf(df: DataFrame, text: str = "text", min_df: int = 1, max_df: float = 1.0, max_features: int = MAX_FEATURES) -> Tfidf:
    """The vocabulary in token order, at most ``max_features`` rows."""
    rows = sorted(vocabulary(df, text, min_df, max_df, max_features).collect(), key=lambda r: r["token"])
    if not rows:
        raise ValueError("no token is left for the vocabulary")
    return Tfidf([r["token"] for r in rows], np.array([r["idf"] for r in rows]))


def sparse_entries(df: DataFrame, key: str, vec: str = "tfidf") -> DataFrame:
    """key, at (array<int>) and weight (array<double>): the entries of a sparse vector column."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            v = batch.column(vec)
            yield pa.record_batch([batch.column(key), v.field("indices"), v.field("values")], names=[key, "at", "weight"])

    return df.select(key, vec).mapInArrow(run, f"`{key}` {kind}, at array<int>, weight array<double>")


def stack_features(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """One vector of sparse and dense columns side by side (numbers, vectors)."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


# ---------------------------------------------------------------- embeddings

def _slices(rows: pa.ListArray) -> Iterator[pa.ListArray]:
    """The rows in order, in runs of at most ``SLICE_TOKENS`` tokens and rows, or one longer row."""
    ends = rows.offsets.to_numpy() + np.arange(len(rows) + 1)
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_TOKENS, side="right")) - 1)
        yield rows.slice(a, b - a)
        a = b


def _weights(known: pa.Array, idf: np.ndarray, rows: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token number, weight) of the ``known`` tokens that the rows hold."""
    size = np.diff(rows.offsets.to_numpy())
    flat = pc.index_in(rows.flatten(), value_set=known).fill_null(-1).to_numpy()
    keys, n = np.unique((np.repeat(np.arange(len(size)), size) << 32 | flat)[flat >= 0], return_counts=True)
    row, at = keys >> 32, keys & 0xFFFFFFFF
    weight = n * idf[at]
    return row, at, weight / np.sqrt(np.bincount(row, weight * weight, len(size)))[row]


def _projected(row: np.ndarray, at: np.ndarray, weight: np.ndarray, directions: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, directions.shape[1]))
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat(weight[:, None] * directions[at], first, axis=0)
    return out


def _add_products(sums: np.ndarray, model: Tfidf, rows: pa.ListArray, directions: np.ndarray) -> None:
    """Adds row x (row . directions) of every row to ``sums``, a slice of rows at a time."""
    known = pa.array(model.tokens, pa.string())
    for some in _slices(rows):
        row, at, weight = _weights(known, model.idf, some)
        seen = _projected(row, at, weight, directions, len(some))
        np.add.at(sums, at, weight[:, None] * seen[row])


@dataclass
class Embedder:
    tfidf: Tfidf
    basis: np.ndarray  # (tokens, dimensions)

    def vectors(self, words: pa.ListArray) -> pa.ListArray:
        """The unit vectors of token lists, a slice of rows at a time."""
        known, parts = pa.array(self.tfidf.tokens, pa.string()), [np.zeros((0, self.basis.shape[1]))]
        for some in _slices(words):
            x = _projected(*_weights(known, self.tfidf.idf, some), self.basis, len(some))
            parts.append(x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None])
        x = np.concatenate(parts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    def transform(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        """``df`` with the unit vector ``out``; a text without known tokens gets zeros."""
        @F.arrow_udf(ArrayType(DoubleType()))
        def embedded(words: pa.Array) -> pa.Array:
            return self.vectors(words)

        small_batches(df.sparkSession)
        return df.withColumn(out, embedded(lower_tokens(text)))


def fit_embedder(df: DataFrame, text: str = "text", dim: int = 64, min_df: int = 2, max_df: float = 0.5, max_features: int = 1 << 14,
                 passes: int = 3, extra: int = 16, seed: int = 0) -> Embedder:
    """The leading ``dim`` right singular vectors of the TF-IDF matrix, by
    subspace iteration on random directions: a pass sums row x (row . directions)
    inside the tasks and adds the tasks' blocks of ``TERM_BLOCK`` tokens.  A task
    holds its sums (tokens x directions) and the directions of one slice of rows;
    there are at most two tasks a core, so what they write does not grow with ``df``."""
    small_batches(df.sparkSession)
    model = fit_tfidf(df, text, min_df, max_df, max_features)
    n_terms, width = len(model.tokens), min(dim + extra, len(model.tokens))
    rows = cut_lineage(df.select(lower_tokens(text).alias("words")), "embed-words").coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    schema = pa.schema([("block", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def pass_over(directions: np.ndarray) -> np.ndarray:
        def run(batches):
            sums = np.zeros((-(-n_terms // TERM_BLOCK) * TERM_BLOCK, width))
            for batch in batches:
                _add_products(sums, model, batch.column("words"), directions)
            for b in range(0, len(sums), TERM_BLOCK):
                yield pa.record_batch([pa.array([b // TERM_BLOCK], pa.int32()), pa.array([sums[b:b + TERM_BLOCK].ravel()], schema.field("sums").type)], schema=schema)

        total = rows.mapInArrow(run, "block int, sums array<double>").groupBy("block").agg(Summarizer.sum(array_to_vector("sums")).alias("s"))
        found = np.zeros((-(-n_terms // TERM_BLOCK) * TERM_BLOCK, width))
        for block, s in total.collect():  # tokens x directions, bounded by max_features
            found[block * TERM_BLOCK:(block + 1) * TERM_BLOCK] = s.toArray().reshape(TERM_BLOCK, width)
        return found[:n_terms]

    directions = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_terms, width)))[0]
    for _ in range(passes):
        found = pass_over(directions)
        small = directions.T @ found
        directions, before = np.linalg.qr(found)[0], directions
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return Embedder(model, (before @ turn[:, ::-1])[:, :dim])


# ---------------------------------------------------------------- a trained scorer

def train_scorer(df: DataFrame, text: str = "text", label: str = "label", n_classes: int = 3, min_df: int = 2, max_features: int = 1 << 14,
                 reg: float = 1e-3) -> Callable:
    """A loader for ``predict_batch_udf``: multinomial logistic regression on the
    TF-IDF of ``df`` (labels 0 .. n_classes - 1; rows without a label are left out)."""
    known = df.where(F.col(label).isNotNull())
    model = fit_tfidf(known, text, min_df, 1.0, max_features)
    fitted = LogisticRegression(family="multinomial", regParam=reg, maxIter=100, featuresCol="tfidf").fit(
        model.transform(known.withColumn("label", F.col(label).cast("double")), text))
    # classes that the rows do not have (or that lie behind the last one seen) keep a low score
    weight, start = np.zeros((n_classes, len(model.tokens))), np.full(n_classes, -30.0)
    seen = fitted.coefficientMatrix.toArray()
    weight[:len(seen)], start[:len(seen)] = seen, np.maximum(fitted.interceptVector.toArray(), -30.0)
    number, idf = {t: i for i, t in enumerate(model.tokens)}, model.idf

    def load():
        import regex
        split = regex.compile(TOKEN_PATTERN).findall

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.tile(start, (len(texts), 1))
            for row, t in enumerate(texts):
                at = [number[w] for w in split(t.lower()) if w in number]
                if at:
                    i, n = np.unique(at, return_counts=True)
                    v = n * idf[i]
                    out[row] += weight[:, i] @ (v / np.linalg.norm(v))
            return out.astype(np.float32)
        return predict
    return load
