"""Approximate nearest neighbours through a stored index.

An index is a folder of plain Parquet tables: coarse centres, product-quantiser
codebooks, and one row per vector (cell, id, codes, vector) partitioned by cell.
``build_index`` writes it once; ``search`` reads only what a set of queries needs
and can be called any number of times.  A query is scored against the codes of
its nearest cells, its best ``rerank`` candidates are scored again with the
stored vectors, and the number of codes it met is returned with the result.

Centres and codebooks are learned from a hash sample of ``sample_rows`` vectors;
every vector is indexed.  How many cells a query visits is measured while the index
is built: sampled vectors look for their nearest other sampled vector, and
``probes`` is the number of cells that finds the wanted share of them.

Similarity is the inner product.  Rows with a null vector or entry are left out of
the index; queries with one have no neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivalry.functions.vectors import dot
from rivalry.operators.combine import broadcast_if_small
from rivalry.session import cut_lineage

MEMBERS_PER_CELL, MIN_CELLS, MAX_CELLS = 5000, 16, 4096
CHUNK_ROWS = 65_536   # codes of one cell that a task holds at a time
CANDIDATE_ROWS = 1_000_000  # candidates up to this count are broadcast to the stored vectors


@dataclass
class Index:
    """What the driver keeps of a stored index: centres, codebooks, sizes."""
    path: str
    centres: np.ndarray      # (cells, dimensions)
    codebooks: np.ndarray    # (parts, codes, dimensions / parts), zero-padded dimensions
    probes: int
    members: dict[int, int]  # vectors per cell


def _known(vec: str):
    return F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means; a centre without members takes the farthest point."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        far = (centres ** 2).sum(axis=1) - 2 * x @ centres.T
        own = far.argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-far[np.arange(len(x)), own])[:len(empty)]]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _padded(x: np.ndarray, parts: int) -> np.ndarray:
    extra = -x.shape[1] % parts
    return np.pad(x, ((0, 0), (0, extra))) if extra else x


def _codes(residual: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    parts, _, width = codebooks.shape
    r = _padded(residual, parts).reshape(len(residual), parts, width)
    return np.stack([_nearest(r[:, i], codebooks[i]) for i in range(parts)], axis=1).astype(np.uint8)


def _rebuilt(codes: np.ndarray, centre: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    parts = len(codebooks)
    return np.concatenate([codebooks[i][codes[:, i]] for i in range(parts)], axis=1)[:, :len(centre)] + centre


def _probes_for(sample: np.ndarray, centres: np.ndarray, recall: float, rng: np.random.Generator, queries: int = 1000) -> int:
    own = _nearest(sample, centres)
    at = rng.choice(len(sample), min(queries, len(sample)), replace=False)
    sim = sample[at] @ sample.T
    sim[np.arange(len(at)), at] = -np.inf
    wanted = own[sim.argmax(axis=1)]
    order = np.argsort(-(sample[at] @ centres.T), axis=1, kind="stable")
    rank = (order == wanted[:, None]).argmax(axis=1) + 1
    return int(np.quantile(rank, recall, method="higher"))


def build_index(corpus: DataFrame, path: str, id_col: str = "id", vec: str = "embedding", members: int = MEMBERS_PER_CELL,
                max_cells: int = MAX_CELLS, parts: int = 8, codes: int = 256, sample_rows: int = 20_000, wanted_recall: float = 0.97,
                seed: int = 7) -> Index:
    """Learns, codes and stores ``corpus`` under ``path``."""
    spark = corpus.sparkSession
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(_known("vec"))
    n = rows.count()
    sample = [r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()]
    if not sample:
        raise ValueError("no vector to index")
    sample, rng = np.array(sample), np.random.default_rng(seed)
    cells = int(min(max_cells, max(MIN_CELLS, -(-n // members)), len(sample)))
    centres = _means(sample, cells, rng)
    residual = _padded(sample - centres[_nearest(sample, centres)], parts)
    width = residual.shape[1] // parts
    books = [_means(residual[:, i * width:(i + 1) * width], codes, rng) for i in range(parts)]
    books = np.stack([np.pad(b, ((0, max(len(x) for x in books) - len(b)), (0, 0)), mode="edge") for b in books])
    probes = min(len(centres), _probes_for(sample, centres, wanted_recall, rng)) if len(sample) > 1 else len(centres)

    def coded(it):
        for pdf in it:
            if len(pdf):
                v = np.stack(pdf["vec"].to_list())
                own = _nearest(v, centres)
                yield pd.DataFrame({"cell": own.astype(np.int32), "id": pdf["id"].to_numpy(),
                                    "codes": [c.tobytes() for c in _codes(v - centres[own], books)], "vec": pdf["vec"]})

    rows.mapInPandas(coded, "cell int, id long, codes binary, vec array<double>").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))) \
        .sortWithinPartitions("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    model = [("centre", i, 0, c.tolist()) for i, c in enumerate(centres)] + [("probes", probes, 0, [])]
    model += [("code", i, j, c.tolist()) for i, book in enumerate(books) for j, c in enumerate(book)]
    spark.createDataFrame(model, "kind string, i int, j int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """The stored index at ``path``; its model has one row per centre and code."""
    model = spark.read.parquet(f"{path}/model").collect()
    centres = np.array([r["v"] for r in sorted((r for r in model if r["kind"] == "centre"), key=lambda r: r["i"])])
    codes = sorted((r for r in model if r["kind"] == "code"), key=lambda r: (r["i"], r["j"]))
    parts = codes[-1]["i"] + 1
    books = np.array([r["v"] for r in codes]).reshape(parts, len(codes) // parts, -1)
    members = {r["cell"]: r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy("cell").count().collect()}
    return Index(path, centres, books, next(r["i"] for r in model if r["kind"] == "probes"), members)


def search(queries: DataFrame, index: Index, k: int = 1, q_id: str = "q_id", id_col: str = "id", vec: str = "embedding",
           probes: int | None = None, rerank: int = 64) -> DataFrame:
    """q_id, rank, id, similarity (exact for the returned vectors), n_candidates (codes met)."""
    spark, rerank = queries.sparkSession, max(rerank, k)
    stored = spark.read.parquet(f"{index.path}/rows")
    cells = np.array(sorted(index.members))
    centres, books, n_probes = index.centres, index.codebooks, min(probes or index.probes, len(cells))
    chunks = {c: -(-n // CHUNK_ROWS) for c, n in index.members.items()}
    n_chunks = F.array(*[F.lit(chunks.get(c, 0)) for c in range(len(centres))])

    def cells_of(it):
        for pdf in it:
            if len(pdf):
                q = np.stack(pdf["qv"].to_list())
                near = cells[np.argsort(-(q @ centres[cells].T), axis=1, kind="stable")[:, :n_probes]]
                yield pd.DataFrame({"q": np.repeat(pdf["q"].to_numpy(), n_probes), "cell": near.ravel().astype(np.int32),
                                    "data": [x for v in q for x in [v.tobytes()] * n_probes]})

    asked = queries.select(F.col(q_id).cast("long").alias("q"), F.col(vec).cast("array<double>").alias("qv")).where(_known("qv"))
    wanted = (asked.mapInPandas(cells_of, "q long, cell int, data binary")
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.get(n_chunks, F.col("cell")) - 1)))
              .select("cell", "chunk", F.lit(1).alias("side"), F.col("q").alias("rid"), "data"))
    coded = stored.select("cell", F.pmod(F.xxhash64("id"), F.get(n_chunks, F.col("cell"))).cast("int").alias("chunk"), F.lit(0).alias("side"),
                          F.col("id").alias("rid"), F.col("codes").alias("data"))

    def scored(it):
        """Rows sorted by cell, chunk and side: the codes of a chunk, then its queries."""
        now, ids, codes, base = None, [], [], None
        for pdf in it:
            keys = pdf[["cell", "chunk", "side"]].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                cell, chunk, side = keys[a]
                if (cell, chunk) != now:
                    now, ids, codes, base = (cell, chunk), [], [], None
                part = pdf.iloc[a:b]
                if side == 0:
                    ids.append(part["rid"].to_numpy())
                    codes.append(np.frombuffer(b"".join(part["data"]), np.uint8).reshape(b - a, len(books)))
                    continue
                if not ids:
                    continue
                if base is None:
                    own, base = np.concatenate(ids), _rebuilt(np.concatenate(codes), centres[cell], books)
                q, qids = np.frombuffer(b"".join(part["data"])).reshape(b - a, -1), part["rid"].to_numpy()
                for s in range(0, len(q), 256):
                    sim = q[s:s + 256] @ base.T
                    m = min(rerank, sim.shape[1])
                    best = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                    yield pd.DataFrame({"q": np.repeat(qids[s:s + 256], m), "cell": np.int32(cell), "chunk": np.int32(chunk), "id": own[best.ravel()],
                                        "approx": np.take_along_axis(sim, best, axis=1).ravel(), "met": len(own)})

    both = coded.unionByName(wanted).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "side", "rid")
    found = cut_lineage(both.mapInPandas(scored, "q long, cell int, chunk int, id long, approx double, met long"), "ann-found")
    met = found.groupBy("q", "cell", "chunk").agg(F.first("met").alias("met")).groupBy("q").agg(F.sum("met").alias("n_candidates"))
    order = Window.partitionBy("q").orderBy(F.desc("approx"), "id")
    top = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rerank).select("q", "cell", "id")
    exact = (stored.select("cell", "id", "vec").join(broadcast_if_small(cut_lineage(top, "ann-top"), CANDIDATE_ROWS), ["cell", "id"])
             .join(asked, "q").select("q", "id", dot("vec", "qv").alias("similarity")))
    by = Window.partitionBy("q").orderBy(F.desc("similarity"), "id")
    return (exact.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).join(met, "q")
            .select(F.col("q").alias(q_id), "rank", F.col("id").alias(id_col), "similarity", "n_candidates"))
