"""Near-duplicate vectors by an exact metric range join.

Two vectors link when their labels are equal and not null and their cosine is at
least ``min_cosine``, which is a Euclidean distance of at most
r = sqrt(2 - 2 min_cosine) between the unit vectors.

1. Equal vectors of a label count once (smallest id, number of copies).
2. Pivots, a hash sample of the large labels' vectors, cut each label into cells:
   a vector's home is its nearest pivot.  By the triangle inequality everything
   within r of a vector at home in cell c is at most 2 r farther from c's pivot
   than from its own, so a vector is copied to exactly the cells for which
   d(x, p_c) <= d(x, home) + 2 r.  Labels of up to ``cell_size`` vectors are one cell.
3. Cells join on their own: the home vectors against all vectors there.  A cell of
   more than ``block`` vectors is cut into blocks that meet pair by pair, in
   different tasks.  Each block pair gives a link count per home vector and a
   spanning forest, never pairs.
4. Components of the forests are labelled with their smallest id.

At most ``MAX_PIVOTS`` pivots go to the tasks (a bounded broadcast), the largest
labels first; labels beyond that stay one cell, cut into blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, vectors without a label or an id, and vectors of different lengths
link with nothing; repeated rows are copies of each other; a null id has a null
component and is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .components import components

MIN_COSINE, CELL_SIZE, BLOCK, MAX_PIVOTS, LABEL_PIVOTS = 0.93, 2000, 2048, 2048, 256


def _unit(rows) -> np.ndarray:
    v = np.stack([np.asarray(r, np.float64) for r in rows])
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def pivots(reps: DataFrame, cell_size: int, max_pivots: int) -> dict:
    """(label, dim) → unit pivots, at most ``max_pivots`` in all."""
    large = (reps.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > cell_size)
             .orderBy(F.desc("n"), "label", "dim").limit(max_pivots).collect())
    wanted, left = {}, max_pivots
    for r in large:
        k = min(LABEL_PIVOTS, -(-r["n"] // cell_size), left)
        if k > 1:
            wanted[(r["label"], r["dim"])] = (k, r["n"])
            left -= k
    out = {}
    if wanted:
        rate = reps.sparkSession.createDataFrame([(*key, 4.0 * k / n) for key, (k, n) in wanted.items()],
                                                 "label string, dim int, rate double")
        draw = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
        drawn = reps.join(F.broadcast(rate), ["label", "dim"]).where(draw / F.lit(1 << 30) < F.col("rate"))
        for r in sorted(drawn.select("label", "dim", "rep", "embedding").collect(), key=lambda r: r["rep"]):
            out.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    return {key: _unit(rows[:wanted[key][0]]) for key, rows in out.items() if len(rows) > 1}


def cells(reps: DataFrame, centres: dict, radius: float) -> DataFrame:
    """Each vector with its cells: (rep, n, embedding, label, dim, cell, home)."""
    def run(frames):
        for pdf in frames:
            cell, home, take = [], [], []
            for (label, dim), g in pdf.reset_index(drop=True).groupby(["label", "dim"], sort=False):
                p = centres.get((label, dim))
                if p is None:
                    cell += [0] * len(g)
                    home += [True] * len(g)
                    take += g.index.tolist()
                    continue
                d = np.sqrt(np.maximum(2.0 - 2.0 * (_unit(g["embedding"]) @ p.T), 0.0))
                own = d.argmin(axis=1)
                row, c = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * radius + 1e-9)
                cell += c.tolist()
                home += (own[row] == c).tolist()
                take += g.index.to_numpy()[row].tolist()
            yield pdf.reset_index(drop=True).iloc[take].assign(cell=cell, home=home)

    kinds = dict(reps.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in reps.columns) + ", cell int, home boolean"
    return reps.mapInPandas(run, schema)


def _roots(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest linked row of every row, by repeated minima along the links."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _block_links(pdf: pd.DataFrame, min_cosine: float) -> pd.DataFrame:
    """links of each home vector of the first block to the vectors of the second; forest edges (a, b)."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    none = pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
    if not len(left) or not len(right):
        return none
    ids = np.concatenate([left["rep"].to_numpy(), right["rep"].to_numpy()])
    a, b, n = _unit(left["embedding"]), _unit(right["embedding"]), right["n"].to_numpy()
    rows, cols, links = [], [], np.zeros(len(a), np.int64)
    for k in range(0, len(a), 256):
        c = a[k:k + 256] @ b.T
        for x, y in zip(*np.nonzero(np.abs(c - min_cosine) < 1e-12)):
            c[x, y] = math.fsum((a[k + x] * b[y]).tolist())
        hit = (c >= min_cosine) & (ids[k:k + len(c), None] != ids[None, len(a):])
        links[k:k + 256] = hit @ n
        i, j = np.nonzero(hit)
        rows.append(i + k)
        cols.append(j + len(a))
    i, j = np.concatenate(rows), np.concatenate(cols)
    if not len(i):
        return none
    _, same = np.unique(ids, return_inverse=True)  # a vector may be on both sides
    root = _roots(same.max() + 1, same[i], same[j])
    unique = np.unique(ids)
    tied = np.flatnonzero(root != np.arange(len(root)))
    some = links > 0
    return pd.DataFrame({"a": np.concatenate([ids[:len(a)][some], unique[tied]]),
                         "b": np.concatenate([ids[:len(a)][some], unique[root[tied]]]),
                         "links": np.concatenate([links[some], np.zeros(len(tied), np.int64)])})


def near_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, cell_size: int = CELL_SIZE, block: int = BLOCK,
                 max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept for a table (vec_id, embedding, label)."""
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * min_cosine))
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    good = v.where(usable)
    reps = cut_lineage(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
                       .withColumn("dim", F.size("embedding")), "vectors")
    placed = cut_lineage(cells(reps, pivots(reps, cell_size, max_pivots), radius), "cells")
    cell = ["label", "dim", "cell"]
    size = placed.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    at = placed.join(size, cell).withColumn("blk", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    home = at.where("home").select("*", other).select("rep", "n", "embedding", *cell, F.lit(0).alias("side"),
                                                      F.col("blk").alias("i"), F.col("other").alias("j"))
    there = at.select("*", other).select("rep", "n", "embedding", *cell, F.lit(1).alias("side"),
                                         F.col("other").alias("i"), F.col("blk").alias("j"))
    found = home.unionByName(there).groupBy(*cell, "i", "j").applyInPandas(
        lambda pdf: _block_links(pdf, min_cosine), "a long, b long, links long")
    found = cut_lineage(found, "links")
    links = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    root = components(found.where("a <> b").select("a", "b"))
    of_rep = (reps.join(links, "rep", "left").join(root.withColumnRenamed("node", "rep"), "rep", "left")
              .select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
                      (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                      F.coalesce("component", "rep").alias("component")))
    out = v.withColumn("_ok", usable).join(of_rep, (F.col("_ok")) & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
