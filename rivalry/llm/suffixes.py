"""Removal of every byte covered by a string of ``length`` bytes that starts
anywhere else in the corpus.

Suffixes are sorted by the difference-cover algorithm (``suffix_sort``: sort
sampled triples, recurse on names, merge the remaining suffixes, compare adjacent
prefixes), spread over tasks so that suffixes that can share ``length`` bytes
meet.  Sorting every suffix of the corpus as rows would shuffle many times the
input (README: figures), so what cannot repeat is set aside first, by sampling
places that equal strings have in common: each string of ``length`` bytes is represented by its *anchor*, the
window of ``WINDOW`` bytes with the smallest hash inside it (leftmost of equals).
The positions of a text fall into runs that share an anchor, about one row for
every 85 bytes.

1. Runs whose anchor occurs once are done: no string in them repeats.
2. The rest are sorted into classes of equal surroundings (all bytes that the
   strings of a run touch).  A class of two or more repeats as a whole.
3. A class of one is compared with one run of each other class of its anchor:
   the anchors are dealt to bundles of about ``bundle_runs`` runs, the suffixes
   of a bundle are sorted, and neighbours that agree on ``length`` bytes are
   repeats.  Anchors with more than ``hot_classes`` classes are compared by a
   distributed grouping of their positions' strings (by hash), so no group is
   gathered whole.
4. The repeated ranges of a document are merged and cut out.

Anchors and surroundings are 64-bit hashes; two different strings are taken for
equal only if both collide.  A row is known by a 128-bit hash of doc_id and text
(``_hi``, ``_lo``), so ranges belong to one text.

Defined results: null text counts as empty; texts under ``length`` bytes lose
nothing; repeated rows repeat each other; rows that share a doc_id, or have none,
each lose their own ranges only; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, kept, small_batches
from .suffix_sort import repeated_starts, suffix_array

LENGTH = 200
WINDOW = 32
HOT_CLASSES = 4096
BUNDLE_RUNS = 2048
_BLOCK = 1 << 20

_RNG = np.random.default_rng(77003)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_TABLE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _TABLE:
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            f = np.full(size, np.uint64(base))
            f[0] = 1
            out.append(np.cumprod(f, dtype=np.uint64))
        _TABLE[size] = tuple(out)
    return _TABLE[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _prefix(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(b) + 1)
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[:len(b)], out=s[1:])
    return s, inverse


def _hash_all(b: np.ndarray, width: int) -> np.ndarray:
    """Mixed hash of every window of ``width`` bytes."""
    s, inverse = _prefix(b)
    n = len(b) - width + 1
    return _mix((s[width:] - s[:-width]) * inverse[:n])


def _runs(b: np.ndarray, length: int):
    """Runs of string starts with the same anchor in one text: start, count,
    anchor's hash, hash of the bytes touched."""
    n = len(b) - length + 1
    s, inverse = _prefix(b)
    windows = len(b) - WINDOW + 1
    h = _mix((s[WINDOW:] - s[:-WINDOW]) * inverse[:windows])
    low = np.uint64((1 << 21) - 1)
    m = (h & ~low) | np.arange(windows, dtype=np.uint64)
    span, have = length - WINDOW + 1, 1
    while 2 * have <= span:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < span:
        m = np.minimum(m[:-(span - have)], m[span - have:])
    at = (m[:n] & low).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    count = np.diff(np.concatenate([start, [n]]))
    end = start + count + length - 1
    around = _mix((s[end] - s[start]) * inverse[start] + (at[start] - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
                  + count.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return start, count, h[at[start]], around


def _with_key(docs: DataFrame) -> DataFrame:
    """Adds the row key ``_hi``, ``_lo``: equal for rows equal in doc_id and text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.withColumns({"_hi": F.xxhash64(doc_id, text), "_lo": F.xxhash64(F.lit(1), text, doc_id)})


def anchor_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_hi, _lo, start, count, key, around), one row per run.  ``docs``: _hi, _lo, text."""
    small_batches(docs.sparkSession)
    names = ["_hi", "_lo", "start", "count", "key", "around"]

    def run(batches):
        kept("repeats")
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column("text").to_pylist()):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                for at in range(0, len(raw) - length + 1, _BLOCK):
                    start, count, key, around = _runs(raw[at:at + _BLOCK + length - 1], length)
                    rows.append((k, start + at, count, key, around))
            if rows:
                of = pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]))
                yield pa.record_batch([batch.column("_hi").take(of), batch.column("_lo").take(of),
                                       pa.array(np.concatenate([r[1] for r in rows])),
                                       pa.array(np.concatenate([r[2] for r in rows]).astype(np.int32)),
                                       pa.array(np.concatenate([r[3] for r in rows]).view(np.int64)),
                                       pa.array(np.concatenate([r[4] for r in rows]).view(np.int64))], names=names)

    return docs.mapInArrow(run, "_hi long, _lo long, start long, count int, key long, around long")


def _true_runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _compared(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Repeated ranges of the single runs of whole anchors (all classes of each
    key are here): suffix sort of the runs' bytes, then adjacent prefixes."""
    blobs = pdf["bytes"].to_numpy()
    b = np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    first = np.cumsum(sizes + 1) - (sizes + 1)
    count = sizes - (length - 1)
    row = np.repeat(np.arange(len(blobs)), count)
    starts = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    symbols = b.astype(np.int64) + 2
    symbols[first + sizes] = 1
    repeated = repeated_starts(b, suffix_array(symbols), starts, length)
    # a range never crosses rows: rows are set apart by a position that does not repeat
    apart = np.zeros(len(row) + len(blobs), bool)
    apart[np.arange(len(row)) + row] = repeated
    s, e = _true_runs(apart)
    r = np.searchsorted(np.cumsum(count + 1), s, side="right")
    base = (np.cumsum(count + 1) - (count + 1))[r]
    start = pdf["start"].to_numpy()[r] + (s - base)
    out = pd.DataFrame({"_hi": pdf["_hi"].to_numpy()[r], "_lo": pdf["_lo"].to_numpy()[r], "start": start, "stop": start + (e - s) + length - 1})
    return out[pdf["single"].to_numpy()[r]]


def _positions(length: int):
    """Rows (key, name, _hi, _lo, at, single) of all positions of the given runs."""
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                pdf = batch.slice(k, 256).to_pandas()
                names = [_hash_all(np.frombuffer(x, np.uint8), length) for x in pdf["bytes"]]
                count = [len(x) for x in names]
                at = np.concatenate([np.arange(c) for c in count]) + np.repeat(pdf["start"].to_numpy(), count)
                take = np.repeat(np.arange(len(pdf)), count)
                yield pa.record_batch([batch.slice(k, 256).column("key").take(pa.array(take)),
                                       pa.array(np.concatenate(names).view(np.int64)),
                                       batch.slice(k, 256).column("_hi").take(pa.array(take)),
                                       batch.slice(k, 256).column("_lo").take(pa.array(take)), pa.array(at),
                                       batch.slice(k, 256).column("single").take(pa.array(take))],
                                      names=["key", "name", "_hi", "_lo", "at", "single"])
    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, hot_classes: int = HOT_CLASSES,
                    bundle_runs: int = BUNDLE_RUNS) -> DataFrame:
    """(_hi, _lo, start, stop): byte ranges covered by repeated strings, not yet merged."""
    texts = _with_key(docs).select("_hi", "_lo", F.col("text").cast("string"))
    runs = cut_lineage(anchor_runs(texts, length), "runs")
    shared = runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    # written, so that the join below reads plain exchanges whose hot partitions can be split
    shared = cut_lineage(shared, "shared")
    hits = cut_lineage(runs.join(shared, "key", "left_semi"), "hits")
    classes = hits.groupBy("key", "around").agg(F.count("*").alias("n"), F.min(F.struct("_hi", "_lo", "start", "count")).alias("one"))
    classes = cut_lineage(classes, "classes")
    whole = hits.join(classes.where("n > 1").select("key", "around"), ["key", "around"], "left_semi")
    whole = whole.select("_hi", "_lo", "start", (F.col("start") + F.col("count") + F.lit(length - 1)).alias("stop"))
    keys = classes.groupBy("key").agg(F.count("*").alias("classes"), F.sum((F.col("n") == 1).cast("int")).alias("singles"))
    open_keys = keys.where("classes > 1 AND singles > 0").select("key", "classes")
    compare = (classes.join(open_keys, "key")
               .select("key", "classes", (F.col("n") == 1).alias("single"), "one._hi", "one._lo", "one.start", "one.count"))
    compare = cut_lineage(compare, "compare")
    bundles = max(1, -(-compare.count() // bundle_runs))
    cut = F.expr(f"substring(cast(text AS binary), cast(start + 1 AS int), count + {length - 1})")
    # one text per row key: a class is compared once, however often its row is repeated
    blobs = (compare.join(texts.dropDuplicates(["_hi", "_lo"]), ["_hi", "_lo"])
             .select("key", "classes", "single", "_hi", "_lo", "start", cut.alias("bytes")).where(f"length(bytes) >= {length}"))
    blobs = cut_lineage(blobs, "blobs")
    small = (blobs.where(F.col("classes") <= hot_classes).drop("classes")
             .groupBy(F.pmod(F.xxhash64("key"), F.lit(bundles)).alias("bundle"))
             .applyInPandas(lambda pdf: _compared(pdf, length), "_hi long, _lo long, start long, stop long"))
    named = (blobs.where(F.col("classes") > hot_classes).select("key", "_hi", "_lo", "start", "single", "bytes")
             .mapInArrow(_positions(length), "key long, name long, _hi long, _lo long, at long, single boolean"))
    twice = named.groupBy("key", "name").agg(F.count("*").alias("n")).where("n > 1").select("key", "name")
    hot = (named.where("single").join(twice, ["key", "name"], "left_semi")
           .select("_hi", "_lo", F.col("at").alias("start"), (F.col("at") + length).alias("stop")))
    return whole.unionByName(small).unionByName(hot)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot_classes: int = HOT_CLASSES, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_text`` all
    columns of ``docs`` in front, ``text`` being what is left (a character that
    lost some of its bytes goes as a whole)."""
    ranges = (repeated_ranges(docs, length, hot_classes).distinct().groupBy("_hi", "_lo")
              .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_ranges")))
    extra = [] if with_text else ["doc_id", "text"]
    base = docs if with_text else docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    joined = _with_key(base).join(ranges, ["_hi", "_lo"], "left").drop("_hi", "_lo")
    keep = [c for c in base.columns if c not in extra or c == "doc_id"]
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    kinds = dict(base.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + fields

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            starts = batch.column("_ranges").to_pylist()
            for text, ranges in zip(batch.column("text").to_pylist(), starts):
                raw = (text or "").encode()
                parts, spans, at, removed = [], 0, 0, 0
                stop_before = -1
                for r in ranges or ():
                    start, stop = max(r["start"], at), min(r["stop"], len(raw))
                    if r["start"] > stop_before and r["start"] < len(raw):
                        spans += 1
                    stop_before = max(stop_before, r["stop"])
                    if stop > start:
                        parts.append(raw[at:start])
                        removed += stop - start
                        at = stop
                parts.append(raw[at:])
                left = b"".join(parts)
                out[0].append(len(raw))
                out[1].append(removed)
                out[2].append(spans)
                out[3].append(hashlib.sha256(left).hexdigest())
                out[4].append(None if text is None else left.decode("utf-8", "ignore"))
            columns = [pa.array(out[4], pa.string()) if c == "text" else batch.column(c) for c in keep]
            yield pa.record_batch(columns + [pa.array(o, pa.int64()) for o in out[:3]] + [pa.array(out[3], pa.string())],
                                  names=[*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, schema)
