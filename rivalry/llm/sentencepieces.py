"""SentencePiece encoding and decoding through a table of distinct marked words.

A SentencePiece model writes each space as a marker.  When no piece of the
vocabulary has a marker after another character, no piece crosses from one
marked word (a run of markers and what follows up to the next marker) into the
next, so each distinct marked word is segmented once and its ids are joined
back by position.  The table is kept per Python worker up to a fixed number of
words; words beyond it are segmented once per batch.  A model whose pieces do
cross markers, or a text that holds the marker character itself, is encoded
whole by the library.

Defined results: null text counts as empty (no ids, empty decoded text);
repeated rows give repeated results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkTable, small_batches, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Stands for a text's last marker when nothing follows it (no chunk holds a line of this kind).
_LAST = "\x00" + MARK

_MODELS: dict[str, tuple] = {}


def _model(path: str):
    if path not in _MODELS:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        # "▁" in front of the text, spaces kept, identity normalisation, no piece across a marker
        apart = (sp.normalize(" a  b ") == f"{MARK}{MARK}a{MARK}{MARK}b{MARK}"
                 and sp.normalize("Ａ①é\t\n") == f"{MARK}Ａ①é\t\n"
                 and not any(MARK in p.lstrip(MARK) for p in pieces) and MARK in pieces)

        def compute(chunks):
            ids = sp.encode([c if c != _LAST else "" for c in chunks], num_threads=1)
            ids = [i if c != _LAST else [sp.piece_to_id(MARK)] for c, i in zip(chunks, ids)]
            return [(i, d) for i, d in zip(ids, sp.decode(ids, num_threads=1))]

        _MODELS[path] = (sp, apart, ChunkTable(lambda c: [(",".join(map(str, i)), len(i), d) for i, d in compute(c)],
                                               room=300_000, longest=24))
    return _MODELS[path]


def marked_words(text: str) -> list[str]:
    """The text's marked words, each without its first marker.  A run of k
    markers before a word leaves k - 1 spaces in front of it."""
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0
    for p in parts:
        if p:
            out.append(" " * run + p)
            run = 0
        else:
            run += 1
    if run:
        out.append(" " * (run - 1) if run > 1 else _LAST)
    return out


def encode_decode(docs: DataFrame, model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``with_ids`` also the
    ids (array<int>) and the decoded text."""
    small_batches(docs.sparkSession, 8 << 20)  # a batch's new chunks are encoded together
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()),
              pa.field("decoded_sha256", pa.string())]
    if with_ids:
        fields += [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())]

    def run(batches):
        sp, apart, table = _model(tokenizer_path(model))
        sha = hashlib.sha256
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            whole = [not apart or MARK in t for t in texts]
            chunks = [marked_words(t) if t and not w else [] for t, w in zip(texts, whole)]
            table.prepare(chunks)
            of = table.__getitem__
            out = [[] for _ in fields]
            for doc_id, t, w, cs in zip(batch.column("doc_id").to_pylist(), texts, whole, chunks):
                if w:
                    ids = sp.encode(t)
                    joined, n, decoded = ",".join(map(str, ids)), len(ids), sp.decode(ids)
                else:
                    got = list(map(of, cs))
                    joined, n = ",".join([g[0] for g in got]), sum([g[1] for g in got])
                    decoded = " ".join([g[2] for g in got])
                row = [doc_id, n, sha(joined.encode()).hexdigest(), sha(decoded.encode()).hexdigest()]
                if with_ids:
                    row += [[int(x) for x in joined.split(",")] if joined else [], decoded]
                for col, v in zip(out, row):
                    col.append(v)
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(out, fields)], schema=pa.schema(fields))

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, ddl + (", ids array<int>, decoded string" if with_ids else ""))
