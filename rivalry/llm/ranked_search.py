"""Ranked lexical search by sequential reads of impact-sorted lists (NRA).

``search`` scores every document for every item and returns each item's ``k``
best.  Documents are dealt to shards as they are read.  In a shard each term has
a list of (document, gain) sorted by gain; an item's lists are read in sequence,
never by document.  For every document of the shard the search keeps a lower
bound (the gains read so far) and an upper bound (plus the next gain of each of
the item's lists in which the document has not turned up).  Reading goes on, in
steps that double, until every document whose upper bound reaches the k-th best
lower bound has equal bounds: then membership, ties and scores are settled.
Each task carries the k-th best score from shard to shard, so that later shards
start with a threshold.

Items are taken in blocks of about ``block_terms`` distinct terms; a block's terms
and document frequencies are sent to the tasks, the documents never are.

Scoring (64-bit integers unless said otherwise): N documents with a term, L terms
in all, n terms of the document, df documents with the term, tf its count in the
document; weight w = floor(1000 ln((2N + 2) / (2 df + 1))) in doubles, document
measure m = 100 - 50 + 50 n N div L, score = sum over the item's distinct terms of
w * (10^9 tf div (1000 tf + 20 m)).

Defined results: null texts have no terms; an item without terms, or with no
document above 0, has no rows; equal scores are ordered by ascending doc_id (null
last); repeated rows are ranked one by one; items that share an item_id are
ranked each on its own; texts are never cut; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches

K = 50
BLOCK_TERMS = 200_000
#: A shard holds about so many postings, and documents.
SHARD_POSTINGS, SHARD_DOCS = 1_000_000, 16_384
FIRST_READ = 64

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on UTF-8 bytes: A-Z lower-cased, what is in no term made a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_BYTES).split() if text else []


def _term_counts(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), the numbers of the terms in ``number`` that the
    document holds, and their counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches):
        get, none = number.get, itertools.repeat(-1)
        for batch in batches:
            ids, n = [], []
            for text in batch.column("text"):
                found = terms(text.as_py())
                n.append(len(found))
                ids.append(np.fromiter(map(get, found, none), np.int64, len(found)))
            flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
            doc = np.repeat(np.arange(len(n), dtype=np.int64), n)
            keys, counts = np.unique((doc << 32 | flat)[flat >= 0], return_counts=True)
            starts = pa.array(np.searchsorted(keys >> 32, np.arange(len(n) + 1)), pa.int32())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(starts, pa.array(keys & 0xFFFFFFFF, pa.int32())),
                                   pa.ListArray.from_arrays(starts, pa.array(counts, pa.int32()))], schema=schema)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n long, terms array<int>, counts array<int>")


def settle(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of those among ``n_docs`` that can be among the best
    ``k`` and score at least ``floor`` and above 0; all of them are exact.

    ``lists`` are (documents, gains), gains above 0 and descending, each document
    once a list."""
    lower = np.zeros(n_docs, np.int64)
    known = np.zeros(n_docs, np.int64)  # per document: next gains of the lists it has turned up in
    read, step = [0] * len(lists), FIRST_READ
    nexts = [int(g[0]) if len(g) else 0 for _, g in lists]
    floor = max(floor, 1)
    while True:
        unread = sum(nexts)
        upper = lower + (unread - known)
        least = floor
        if n_docs > k:
            least = max(least, int(np.partition(lower, n_docs - k)[n_docs - k]))
        hope = upper >= least
        if not (hope & (upper > lower)).any():
            out = np.flatnonzero(hope)
            return out, lower[out]
        for i, (docs, gains) in enumerate(lists):
            a = read[i]
            if a == len(gains):
                continue
            b = min(len(gains), a + step)
            after = int(gains[b]) if b < len(gains) else 0
            known[docs[:a]] += after - nexts[i]
            new = docs[a:b]
            lower[new] += gains[a:b]
            known[new] += after
            read[i], nexts[i] = b, after
        step *= 2


class _Best:
    """The running ``k`` best (score, then smaller doc_id) of one item."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.floor = k, np.empty(0, np.int64), np.empty(0, np.int64), 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.floor = int(self.scores[-1])


#: Stands for a null doc_id inside a task: behind all others of its score.
_NULL_ID = np.iinfo(np.int64).max


def _best_of_shards(counted: DataFrame, weight: np.ndarray, items: list[np.ndarray], n_docs: int, n_terms: int, k: int,
                    shard_postings: int, shard_docs: int) -> DataFrame:
    """item (number), doc_id, score: the ``k`` best of every task."""
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def shard(parts, best):
        ids, n, sizes, term, tf = (np.concatenate(x) for x in zip(*parts))
        m = 100 - 50 + (50 * n * n_docs) // n_terms
        doc = np.repeat(np.arange(len(ids)), sizes)
        gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        doc, term, gain = (x[gain > 0] for x in (doc, term, gain))
        order = np.lexsort((-gain, term))
        doc, term, gain = doc[order], term[order], gain[order]
        at = np.searchsorted(term, np.arange(len(weight) + 1))
        for own, top in zip(items, best):
            lists = [(doc[a:b], gain[a:b]) for a, b in zip(at[own].tolist(), at[own + 1].tolist()) if a < b]
            if lists:
                found, scores = settle(lists, len(ids), k, top.floor)
                if len(found):
                    top.add(ids[found], scores)

    def run(batches):
        best = [_Best(k) for _ in items]
        parts, postings, docs = [], 0, 0
        for batch in batches:
            at = batch.column("terms").offsets.to_numpy()
            parts.append((batch.column("doc_id").fill_null(_NULL_ID).to_numpy(), batch.column("n").to_numpy(), np.diff(at),
                          *(batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))))
            postings, docs = postings + int(at[-1] - at[0]), docs + batch.num_rows
            if postings >= shard_postings or docs >= shard_docs:
                shard(parts, best)
                parts, postings, docs = [], 0, 0
        if docs:
            shard(parts, best)
        item = np.repeat(np.arange(len(items), dtype=np.int32), [len(b.ids) for b in best])
        ids = np.concatenate([b.ids for b in best])
        yield pa.record_batch([pa.array(item), pa.array(ids, mask=ids == _NULL_ID), pa.array(np.concatenate([b.scores for b in best]))], schema=schema)

    return counted.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS,
           shard_docs: int = SHARD_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` documents of highest score."""
    spark = docs.sparkSession
    text = F.coalesce(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    queries = items.select(F.monotonically_increasing_id().alias("row"), "item_id", F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("terms"))
    queries = cut_lineage(queries, "queries")
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    out = None
    for b in range(blocks):
        block = queries.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).select("row", "terms").collect()
        number: dict[bytes, int] = {}
        own = [np.asarray([number.setdefault(t.encode(), len(number)) for t in r["terms"]]) for r in block]
        if not block:
            continue
        counted = cut_lineage(_term_counts(docs, number), "term-counts")
        n_docs, n_terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not n_terms:
            break
        df = np.zeros(len(number), np.int64)
        for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[term] = n
        weight = np.asarray([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        found = _best_of_shards(counted, weight, own, n_docs, n_terms, k, shard_postings, shard_docs)
        rows = spark.createDataFrame([(i, r["row"]) for i, r in enumerate(block)], "item int, row long")
        best = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = found.withColumn("rank", best).where(F.col("rank") <= k).join(rows, "item").select("row", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")
    return out.join(queries.select("row", "item_id"), "row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
