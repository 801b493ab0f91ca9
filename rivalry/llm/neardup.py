"""MinHash near-duplicate components by a signature-coordinate inverted join.

1. Each document becomes its set of distinct ``width``-word shingles (64-bit
   hashes) and a signature of ``coords`` MinHash values.  Equal sets (128-bit
   digest) are one node; steps 2 to 4 work on nodes, not on doc_ids.
2. Every (coordinate, value) is a posting list.  A link needs at least
   ``matches`` equal coordinates; with coordinates ranked rarest first, two such
   documents share one of their first ``coords - matches + 1`` coordinates.
   Values that occur once are counted but never posted, and a document whose
   prefix holds only those is skipped.
3. Prefix postings join nodes into clusters through each list's smallest
   node (a list of m nodes gives m - 1 rows, not m^2 pairs).
4. Inside a cluster the collisions of full signatures are counted block by
   block, and pairs with at least ``matches`` that are not connected yet are
   confirmed on the full shingle sets; a block returns a spanning forest.
   Clusters of more than ``block_shingles`` are cut into blocks, and every
   block meets every other one: exact at any size.
5. Nodes that share a doc_id are tied together, and components of all links are
   labelled with their smallest doc_id.

``matches`` is the largest count that a pair right at the threshold misses with
a probability below 1e-6.

Defined results: null text counts as empty; a document without words has no
shingles, is linked with nothing and is its own component; rows that share a
doc_id count as one document (each row keeps the size of its own set, and a row
without words is in the component of its doc_id); a null doc_id is linked with
nothing, has a null component and is kept; texts are never cut, nor are words; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, kept, small_batches
from .components import components

WIDTH, PERCENT, COORDS = 3, 85, 64
BLOCK_SHINGLES = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_POW = np.cumprod(np.full(4096, np.uint64(0x9E3779B97F4A7C15) | np.uint64(1), dtype=np.uint64))
_FAR = np.cumprod(np.full(4096, np.uint64(0xC2B2AE3D27D4EB4F), dtype=np.uint64))  # for the 4096-byte blocks of a word
_MUL = _RNG.integers(1, 1 << 63, 512, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(1, 1 << 63, 512, dtype=np.uint64)
_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of every word of ``raw`` (any text: cut at blanks
    into blocks of about 1 MB)."""
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + (1 << 20))
        if end < len(raw):
            while end < len(raw) and not _BLANKS[raw[end]]:
                end += 1
        b = np.frombuffer(raw, np.uint8, end - at, at)
        inside = ~_BLANKS[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        if len(s):
            begins = np.concatenate([[0], s])  # blanks before the first word belong to no word
            pos = np.arange(len(b)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(b)]])))
            power = _POW[pos & 4095]
            if (e - s).max() > len(_POW):
                block = pos >> 12
                far = _FAR[block & 4095] * _mix((block >> 12).astype(np.uint64) + np.uint64(1))
                power = np.where(block > 0, power * far, power)  # words of one block hash alike in any batch
            v = np.where(inside, _BYTE[b] * power, np.uint64(0))
            hashes.append(_mix(np.add.reduceat(v, s) + (e - s).astype(np.uint64)))
            starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than
    ``width`` words has its whole word sequence as one shingle."""
    raws = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raws])
    h, starts = word_hashes(b"\n".join(raws))
    cuts = np.searchsorted(starts, ends)
    sh = None
    for k in range(width):
        part = h[k:len(h) - (width - 1 - k)] if len(h) >= width else h[:0]
        sh = part * np.uint64(1) if sh is None else _mix(sh * np.uint64(0x9E3779B97F4A7C15) + part)
    out, a = [], 0
    for b in cuts:
        if b - a >= width:
            out.append(np.unique(sh[a:b - width + 1]))
        elif b > a:
            one = np.asarray([b - a], np.uint64)
            for w in h[a:b]:
                one = _mix(one * np.uint64(3) + w)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
        a = b
    return out


def signature(shingles: np.ndarray, coords: int) -> np.ndarray:
    best = np.full(coords, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 2048):
            v = shingles[k:k + 2048, None] * _MUL[:coords]
            v += _ADD[:coords]
            np.minimum(best, v.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def least_matches(coords: int, percent: int, miss: float = 1e-6) -> int:
    """Largest m with P(Binomial(coords, percent / 100) < m) < miss."""
    p, below = percent / 100, 0.0
    for m in range(coords + 1):
        below += math.comb(coords, m) * p ** m * (1 - p) ** (coords - m)
        if below >= miss:
            return m
    return coords


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def sketches(docs: DataFrame, width: int = WIDTH, coords: int = COORDS) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hi, set_lo (digest of the set; null if empty), sig array<int>."""
    small_batches(docs.sparkSession)

    def run(batches):
        kept("near duplicates")
        for batch in batches:
            sets = shingle_sets([t or "" for t in batch.column("text").to_pylist()], width)
            hi, lo, sig = [], [], []
            for s in sets:
                if len(s):
                    one, two = set_digest(s)
                    hi.append(one)
                    lo.append(two)
                    sig.append(signature(s, coords).view(np.int32))
                else:
                    hi.append(None)
                    lo.append(None)
                    sig.append(None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                                   pa.array(sig, pa.list_(pa.int32()))],
                                  names=["doc_id", "text_hash", "n_shingles", "set_hi", "set_lo", "sig"])

    return hashed(docs).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, set_hi long, set_lo long, sig array<int>")


def prefix_postings(reps: DataFrame, matches: int) -> DataFrame:
    """(key, rep): the shared coordinate-value pairs of each document's prefix."""
    posts = reps.select("rep", F.explode(F.transform("sig", lambda v, i: F.shiftleft(i.cast("long"), 32) + v)).alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    # written, so that the join reads plain exchanges whose hot partitions can be split
    found = posts.join(cut_lineage(shared, "shared"), "key")
    # a prefix has coords - matches + 1 entries and takes the coords - size(p) unique values first,
    # so size(p) - matches + 1 shared ones are left; p has at most `coords` entries
    per_doc = (found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("p"))
               .withColumn("n", F.size("p") - F.lit(matches - 1)).where("n > 0"))
    return per_doc.select("rep", F.explode(F.expr("slice(p, 1, n)")).alias("e")).select("rep", F.col("e.key").alias("key"))


def _forest(ids, sigs, sets, first, matches, percent):
    """Spanning forest of the confirmed links between rows; ``first``: block of
    each row, pairs inside the second block only are left to its own task."""
    n = len(ids)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a0 in range(0, n, 256):
        rows = range(a0, min(n, a0 + 256))
        a = sigs[a0:a0 + 256]
        for b0 in range(a0, n, 1024):
            b = sigs[b0:b0 + 1024]
            hits = np.zeros((len(a), len(b)), np.uint16)
            for c in range(sigs.shape[1]):
                hits += a[:, c][:, None] == b[:, c][None, :]
            i, j = np.nonzero(hits >= matches)
            keep = (j + b0 > i + a0) & first[i + a0]
            i, j = i[keep], j[keep]
            for k in np.argsort(-hits[i, j].astype(np.int32), kind="stable"):
                x, y = i[k] + rows[0], j[k] + b0
                rx, ry = find(x), find(y)
                if rx == ry:
                    continue
                sx, sy = sets[x], sets[y]
                if 100 * min(len(sx), len(sy)) < percent * max(len(sx), len(sy)):
                    continue
                both = np.concatenate([sx, sy])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    parent[rx] = ry
                    out.append((ids[x], ids[y]))
    return out


def confirmed_links(docs: DataFrame, clusters: DataFrame, width: int, coords: int, matches: int, percent: int,
                    block_shingles: int) -> DataFrame:
    """A spanning forest (a, b) of the links between cluster members.
    ``clusters``: node, doc_id and text_hash (where its text is found), set_hi,
    set_lo, n_shingles, cluster (materialised)."""
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("blocks"))
    total = clusters.agg(F.sum("n_shingles")).first()[0] or 0
    bundles = max(1, -(-total // block_shingles))
    member = clusters.join(sizes, "cluster")
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))
    member = (member.withColumn("block", block)
              .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
              .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
              .select("doc_id", "text_hash", "node", "set_hi", "set_lo", "cluster", "lo", "hi", (F.col("block") == F.col("lo")).alias("in_lo"),
                      F.when(F.col("blocks") > 1, F.xxhash64("cluster", "lo", "hi"))
                      .otherwise(F.pmod(F.xxhash64("cluster"), F.lit(bundles))).alias("task")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["cluster", "lo", "hi"], sort=False):
            # repeated rows come along, and other texts of the doc_id if their hashes are equal
            g = g.drop_duplicates(["node", "text"]).sort_values(["in_lo", "node"], ascending=[False, True])
            sets = shingle_sets(g["text"].tolist(), width)
            mine = [len(s) > 0 and set_digest(s) == d for s, d in zip(sets, zip(g["set_hi"], g["set_lo"]))]
            g, sets = g[mine], [s for s, m in zip(sets, mine) if m]
            first = (~g["node"].duplicated()).tolist()
            g, sets = g[first], [s for s, m in zip(sets, first) if m]
            if len(g) < 2:
                continue
            sigs = np.stack([signature(s, coords) for s in sets])
            out += _forest(g["node"].to_numpy(), sigs, sets, g["in_lo"].to_numpy(), matches, percent)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    texts = hashed(docs).where("text IS NOT NULL")
    # the member list grows with the corpus: never broadcast it
    return texts.join(member.hint("merge"), ["doc_id", "text_hash"]).groupBy("task").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, coords: int = COORDS,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    matches = least_matches(coords, percent)
    sk = cut_lineage(sketches(docs, width, coords), "sketches")
    with_words = sk.where("set_hi IS NOT NULL AND doc_id IS NOT NULL")
    sets = with_words.groupBy("set_hi", "set_lo").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("n_shingles").alias("n_shingles"),
                                                      F.first("sig").alias("sig"))
    # written, so that the numbers are the same for all readers
    sets = cut_lineage(sets.select(F.monotonically_increasing_id().alias("node"), "set_hi", "set_lo", "at.*", "n_shingles", "sig"), "sets")
    posts = cut_lineage(prefix_postings(sets.select(F.col("node").alias("rep"), "sig"), matches), "postings")
    heads = posts.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1")
    heads = cut_lineage(heads.select("key", "head"), "heads")
    edges = posts.join(heads, "key").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    label = components(edges).withColumnRenamed("component", "cluster")
    clusters = cut_lineage(sets.drop("sig").join(label, "node"), "clusters")
    links = cut_lineage(confirmed_links(docs, clusters, width, coords, matches, percent, block_shingles), "links")
    # a doc_id with different texts ties their sets together as well
    node = sets.select("set_hi", "set_lo", "node")
    own = cut_lineage(sk.select("doc_id", "n_shingles", "set_hi", "set_lo").join(node, ["set_hi", "set_lo"], "left").select("doc_id", "n_shingles", "node"), "own-nodes")
    mixed = own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.max(F.col("node").isNull()).alias("bare"))
    mixed = cut_lineage(mixed.where("first <> last OR bare AND first IS NOT NULL").select("doc_id", "first"), "mixed")
    same = own.join(mixed, "doc_id").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    root = components(links.unionByName(same))
    of_node = sets.select("node", "doc_id").join(root, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_node.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = of_node.join(least, "component").select("node", "component_id")
    # rows without words belong where their doc_id has a node, if it has one
    own = own.join(mixed, "doc_id", "left").withColumn("node", F.coalesce("node", "first"))
    out = own.join(of_node, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
