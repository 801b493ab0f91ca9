"""Packing and SentencePiece: equal to the libraries; packing is gapless, whole and tight."""

import collections
import hashlib
import random
import sys
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as E
from conftest import SF_SMALL, duck
from llm_rows import docs, odd_docs  # noqa: F401
from rivalry.llm import common, langid, packing
from rivalry.llm.neardup import sketches
from rivalry.llm.packing import pack_documents, pack_pieces, sum_of_squares, token_pieces
from rivalry.llm.sentencepieces import encode_decode
from rivalry.llm.suffixes import anchor_runs

ALPHABET = list("ab  \n\t.,'sTRe é▁Éß…—́İJ̌字1\x85\xa0\x1c\x00😀") + ["'re", "<|endoftext|>", "<s>", "..", "  "]


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(0)
    return [(n, "".join(rng.choices(ALPHABET, k=rng.randint(0, 30)))) for n in range(3000)] + [
        (3001, None), (3002, ""), (3003, " "), (3004, "  "), (3005, " " * 100), (3006, "x" * 5000), (3006, "x" * 5000)]


def check_layout(rows, size):
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        assert at[r["sequence_id"]] <= size
    return len(at)


def test_ids_equal_the_tokenizers(spark, bpe, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for r in token_pieces(df, with_ids=True).collect():
        want = bpe.encode(dict(texts)[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert list(r["ids"]) == want[r["start"]:r["start"] + 4096]


def test_sentencepiece_equals_the_library(spark, sp, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = encode_decode(df, with_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(dict(texts)[r["doc_id"]] or "")
        assert list(r["ids"]) == ids and r["decoded"] == sp.decode(ids) and r["n_tokens"] == len(ids)


def test_query_op4(spark, bpe):
    rows = E.queries()["op4_best_fit_packing"](spark, SF_SMALL).collect()
    got = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(got) == len(rows)
    total = 0
    for doc_id, text in duck(SF_SMALL).execute("SELECT doc_id, text FROM documents").fetchall():
        ids = bpe.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for k in range(0, len(ids), 4096):
            r, part = got.pop((doc_id, k // 4096)), ids[k:k + 4096]
            assert (r["start"], r["length"], r["ids_crc32"]) == (k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
    assert not got
    assert check_layout(rows, 4096) <= 1.02 * total / 4096 + 1


def test_query_op8(spark, sp):
    rows = {r["doc_id"]: r for r in E.queries()["op8_sentencepiece_chunks"](spark, SF_SMALL).collect()}
    for doc_id, text in duck(SF_SMALL).execute("SELECT doc_id, text FROM documents").fetchall():
        ids = sp.encode(text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        assert (rows[doc_id]["n_tokens"], rows[doc_id]["ids_sha256"], rows[doc_id]["decoded_sha256"]) == want


@pytest.mark.parametrize("kind", ["descending", "any"])
def test_sum_of_squares_follows_the_rule(kind):
    """Every single placement has the smallest sum of squares."""
    rng = np.random.default_rng(1)
    lists = [[90, 70, 70, 10, 1, 1, 1]] + [rng.integers(1, top + 1, rng.integers(1, 60)).tolist() for top in (100, 40, 10) for _ in range(700)]
    for lengths in lists:
        lengths = sorted(lengths, reverse=True) if kind == "descending" else lengths
        where, offset = sum_of_squares(np.asarray(lengths), 100)
        count, gaps = np.zeros(101, int), {}
        for s, b, o in zip(lengths, where, offset):
            def total(old, new):
                c = count.copy()
                if old is not None:
                    c[old] -= 1
                c[new] += 1
                return int((c[1:] ** 2).sum())
            options = [total(g, g - s) for g in set(gaps.values()) if g >= s] + [total(None, 100 - s)]
            assert total(gaps.get(b), gaps.get(b, 100) - s) == min(options)
            assert o == 100 - gaps.get(b, 100)
            if b in gaps:
                count[gaps[b]] -= 1
            gaps[b] = gaps.get(b, 100) - s
            count[gaps[b]] += 1


def test_null_and_equal_ids_spread_over_shards(spark):
    pieces = spark.createDataFrame([(None, 0, 0, 7, 1)] * 4000 + [(3, 0, 0, 9, 1)] * 2000, "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = pack_pieces(pieces, max_tokens=100, shard_pieces=500).collect()
    check_layout(rows, 100)
    sizes = collections.Counter(r["sequence_id"] >> 40 for r in rows)
    assert len(rows) == 6000 and len(sizes) == 12 and max(sizes.values()) < 700
    big = spark.createDataFrame([(2 ** 53 + 1, 0, 0, 7, 1), (None, 0, 0, 7, 1)], pieces.schema)
    assert {r["doc_id"] for r in pack_pieces(big).collect()} == {2 ** 53 + 1, None}


def test_odd_rows(spark, odd_docs):
    n = odd_docs.count()
    assert encode_decode(odd_docs).count() == n
    packed = pack_documents(odd_docs, shard_pieces=3).collect()
    check_layout(packed, 4096)
    assert sum(r["piece"] == 0 for r in packed) == n
    empty = odd_docs.limit(0)
    assert encode_decode(empty).count() == 0 and pack_documents(empty).count() == 0


def test_a_worker_drops_the_table_of_chunks_when_it_begins_another_operator():
    path = public_tokenizers.path("word_bpe_49k.json")
    table = packing._word_table(path)
    table.prepare([["one", "two"]])
    assert packing._word_table(path) is table and len(table) == 2  # kept for the next task
    gone = weakref.ref(table)
    del table
    common.kept("another operator")
    assert gone() is None


def test_stages_of_the_pipeline_let_go_of_what_packing_kept(docs):  # noqa: F811
    df = docs([(n, f"word{n} and some more words", "en") for n in range(64)]).repartition(16)

    def seen(batches):
        for _ in batches:
            pass
        from rivalry.llm import common
        yield pa.record_batch([pa.array(list(common._KEPT), pa.string())], names=["operator"])

    def operators():
        return [r[0] for r in df.select("doc_id").mapInArrow(seen, "operator string").collect()]

    keyed = df.selectExpr("doc_id AS _hi", "doc_id AS _lo", "text")
    for name, job in (("language", lambda: langid.predict(df, None)), ("near duplicates", lambda: sketches(df)),
                      ("repeats", lambda: anchor_runs(keyed))):
        token_pieces(df).collect()
        assert "packing" in operators()
        job().collect()
        assert name in operators()


def test_packing_holds_little_memory_in_a_worker(spark, docs):  # noqa: F811
    token_pieces(docs([(1, "some words", "en")]))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20
    common.kept("another operator")
    table = packing._word_table(public_tokenizers.path("word_bpe_49k.json"))
    table.compute = lambda chunks: [c.encode()[:12] for c in chunks]  # as long as the ids of a word of three tokens
    for k in range(0, 600_000, 50_000):
        words = [f"word{n:08d}" for n in range(k, k + 50_000)]
        table.prepare([words])
        assert all(table[w] == w.encode() for w in words)  # also those that are not kept
    held = sys.getsizeof(table) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in table.items())
    common.kept("another operator")
    assert held < 75e6


def test_chunks_that_end_in_a_mark_equal_the_tokenizers_whatever_is_kept(bpe):
    chunks = ["word", "word,", "word.", "été.", "été", ",", ".", "..", "..,", "!!", "!!,", "a1", "a1.", "", "strasse,", "x" * 60, "x" * 60 + "."]
    for room in (0, 3, 1000):
        common.kept("another operator")
        table = packing._word_table(public_tokenizers.path("word_bpe_49k.json"))
        table.room = room
        for part in (chunks[::2], chunks, chunks[::-1], chunks[1::2]):
            table.prepare([part])
            for c in part:
                assert table[c] == np.asarray(bpe.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
        del table
    common.kept("another operator")
