"""Best-fit packing by the sum-of-squares rule.

``token_pieces`` turns documents into pieces of at most ``max_tokens`` ids;
``pack_pieces`` places them into sequences.  A piece goes where it makes the
sum over all residual gaps g of N(g)^2 smallest, N(g) being the number of open
sequences with gap g (a new sequence is one of the choices); at equal sums an
open sequence goes before a new one and a smaller gap before a larger one.
Pieces are dealt to shards of about ``shard_pieces`` pieces (the number of
shards follows the data), and each shard is packed on its own, longest pieces
first, then by doc_id (null last) and piece.

Defined results: null text counts as empty; an empty document is the end id
alone; a very long text is tokenized whole and cut into pieces; repeated rows are
packed once each; null doc_ids are kept; an empty table gives no rows; other
columns of ``docs`` are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkTable, bpe_tokenizer, cut_lineage, kept, small_batches, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 4096
END_ID = 1
SHARD_PIECES = 16_384

_WORDLIKE = re.compile("[a-zß-öø-ÿ]+").fullmatch


def _split(text: str) -> list[str]:
    """Blank-separated chunks; the tokenizer drops white space, so no pre-token
    crosses them.  Latin-1 text is lower-cased first, as the tokenizer would
    (it has no combining marks, so lower-casing and NFC commute)."""
    if "<|" not in text:  # special-token strings are matched in their own case
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return text.replace("\n", " ").split(" ")


def _word_table(path: str) -> ChunkTable:
    """Chunk → its ids as little-endian uint32 bytes."""
    tables = kept("packing")
    if path in tables:
        return tables[path]
    tok = bpe_tokenizer(path)
    ends = np.zeros(tok.get_vocab_size(), dtype=bool)
    for piece, i in tok.get_vocab().items():
        ends[i] = piece.endswith("</w>")

    def one_by_one(chunks):
        return [np.asarray(e.ids, dtype="<u4").tobytes()
                for e in tok.encode_batch_fast(chunks, add_special_tokens=False)]

    marks = dict(zip(".,", one_by_one([".", ","])))

    def words(ws):
        """Letter-only words: one pre-token each, so ids split after each word end."""
        out = []
        for k in range(0, len(ws), 4096):
            block = ws[k:k + 4096]
            ids = np.asarray(tok.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) == len(block):
                raw = ids.tobytes()
                at = [0, *(4 * cuts).tolist()]
                out += [raw[a:b] for a, b in zip(at, at[1:])]
            else:
                out += one_by_one(block)
        return out

    def compute(chunks):
        table = tables[path]
        stems, odd = {}, []
        for c in chunks:
            stem = c[:-1] if c[-1:] in marks else c
            if not _WORDLIKE(stem):
                odd.append(c)
            elif stem not in table:
                stems[stem] = None
        stems = dict(zip(stems, words(list(stems))))
        found = dict(zip(odd, one_by_one(odd))) if odd else {}
        for c in chunks:
            if c not in found:
                stem = c[:-1] if c[-1:] in marks else c
                ids = stems[stem] if stem in stems else table[stem]
                found[c] = ids if stem is c else ids + marks[c[-1]]
        return [found[c] for c in chunks]

    tables[path] = ChunkTable(compute, room=400_000, longest=24)
    return tables[path]


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ``ids``
    when ``with_ids``).  Documents are tokenized chunk by chunk through a
    bounded table of distinct chunks, which gives the tokenizer's own ids."""
    small_batches(docs.sparkSession)
    fields = [pa.field("doc_id", pa.int64()), pa.field("piece", pa.int32()), pa.field("start", pa.int64()),
              pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(batches):
        table, end = _word_table(tokenizer_path(tokenizer)), np.asarray([end_id], dtype="<u4").tobytes()
        step = 4 * max_tokens
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            chunks = [_split(t) if t else [] for t in batch.column("text").to_pylist()]
            table.prepare(chunks)
            of = table.__getitem__
            out = [[] for _ in fields]
            for doc_id, cs in zip(ids, chunks):
                raw = b"".join(map(of, cs)) + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at:at + step]
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    for col, v in zip(out, row):
                        col.append(v)
                    if with_ids:
                        out[5].append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(out, fields)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, placed in the given order; at equal
    sums an open bin goes before a new one, a smaller gap before a larger one."""
    n = np.zeros(size + 1, dtype=np.int64)  # open bins by gap; full bins (gap 0) are not counted
    bins: list[list[int]] = [[] for _ in range(size + 1)]
    never = np.int64(1) << 40
    made = 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, s in enumerate(map(int, lengths)):
        gap, have = -1, n[s:size]
        if have.any():
            # change of the sum: gap g becomes g - s, an exact fit leaves none, a new bin has gap size - s
            change = np.where(have > 0, 2 * (n[:size - s] - have) + 2, never)
            if have[0] > 0:
                change[0] = 1 - 2 * have[0]
            j = int(change.argmin())
            if change[j] <= 2 * n[size - s] + 1:
                gap = s + j
        if gap >= 0:
            n[gap] -= 1
            b, left = bins[gap].pop(), gap - s
            offset[k] = size - gap
        else:
            b, left = made, size - s
            made += 1
            offset[k] = 0
        where[k] = b
        if left > 0:
            n[left] += 1
            bins[left].append(b)
    return where, offset


def pack_pieces(pieces: DataFrame, max_tokens: int = MAX_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset.  ``pieces`` is read twice (count, pack):
    pass a materialised table."""
    shards = max(1, -(-pieces.count() // shard_pieces))

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("_shard")[0].as_py()
        table = table.drop_columns("_shard")
        order = pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        table = table.take(order)
        where, offset = sum_of_squares(table.column("length").to_numpy(), max_tokens)
        return table.append_column("sequence_id", pa.array((shard << 40) + where)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    # rows are dealt by their place in the table: equal ids, null ids and copies spread like any others
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    return pieces.withColumn("_shard", shard).groupBy("_shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
                   shard_pieces: int = SHARD_PIECES, with_ids: bool = False) -> DataFrame:
    """Documents → packed pieces (doc_id, piece, start, length, ids_crc32[, ids],
    sequence_id, offset).  Only documents longer than ``max_tokens`` are cut."""
    pieces = cut_lineage(token_pieces(docs, tokenizer, max_tokens, end_id, with_ids), "pieces")
    return pack_pieces(pieces, max_tokens, shard_pieces)
