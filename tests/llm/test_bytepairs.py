"""Byte-level BPE: equal to the library, for whole texts, appends and edits."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as E
from conftest import SF_SMALL, duck
from llm_rows import docs, odd_docs  # noqa: F401
from rivalry.llm import bytepairs

ALPHABETS = ["aeiou thsnr'", "ab", "0123456789 .", "äöüßéñ çλжщ漢字　\x1c\x85 \n\t", "'sdmtlver ", "\U0003d18c\U000323b0ࢗ a",
             list("ab \n'é字\x00") + ["'re", "'ll", "<|endoftext|>", "   "]]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, length, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(0, length))) for _ in range(n)]


def test_ids_equal_the_library(library):
    coder, rng = bytepairs.encoder(), random.Random(1)
    tokens = [b"".join(rng.choices(coder.vocabulary.bytes_of, k=6)).decode("utf-8", "ignore") for _ in range(1500)]
    any_char = ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(1500)]
    long = ["a" * 5000, " " * 3000 + "x", "ab" * 4000, "1" * 3001, "é" * 3000]
    for text in random_texts(6000, 40) + tokens + any_char + long:
        ids = coder.encode(text)
        want = library.encode_ordinary(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert coder.decode(ids) == library.decode_bytes(want)


def test_tables_after_appends_and_edits_equal_new_ones():
    vocabulary, rng = bytepairs.encoder().vocabulary, random.Random(2)
    for text in random_texts(1500, 400, 2):
        data, new = text.encode(), rng.choice(random_texts(5, 6, rng.random())).encode()
        table = bytepairs.PrefixTable(vocabulary, data)
        at = rng.randint(0, len(data))
        drop = rng.randint(0, min(5, len(data) - at))
        table.replace(at, drop, new)
        assert table.last == bytepairs.PrefixTable(vocabulary, data[:at] + new + data[at + drop:]).last
        table.append(b"more")
        assert table.last == bytepairs.PrefixTable(vocabulary, table.data).last and len(table.ids()) > 0


def test_an_edit_computes_only_what_is_near():
    vocabulary = bytepairs.encoder().vocabulary
    table = bytepairs.PrefixTable(vocabulary, b"abcde" * 20_000)
    assert table.replace(50_000, 1, b"xyz") <= 4 * vocabulary.longest


def test_changed_texts_equal_the_library(library):
    coder, rng = bytepairs.encoder(), random.Random(3)
    for k, text in enumerate(random_texts(6000, 60, 3)):
        at = len(text) if k % 4 == 0 else rng.randint(0, len(text))
        drop, new = rng.randint(0, min(5, len(text) - at)), rng.choice(random_texts(5, 6, k))
        result, state = coder.change(text, coder.state(text), at, drop, new)
        assert state == coder.state(result)
        assert np.frombuffer(state[0], "<u4").tolist() == library.encode_ordinary(result)


def test_update_and_decode_on_tables(spark, library):
    texts = dict(enumerate(random_texts(200, 60, 4)))
    stored = bytepairs.encode(spark.createDataFrame(list(texts.items()) + [(900, None)], "doc_id long, text string"))
    changes = [(i, len(t) // 2, min(2, len(t) - len(t) // 2), "'ll x") for i, t in texts.items() if i % 2] + [(900, 0, 0, "new")]
    after = bytepairs.update(stored, spark.createDataFrame(changes, "doc_id long, at int, drop int, new string"))
    want = {i: t[:len(t) // 2] + "'ll x" + t[len(t) // 2 + 2:] if i % 2 else t for i, t in texts.items()} | {900: "new"}
    rows = {r["doc_id"]: r for r in after.collect()}
    assert {i: r["text"] for i, r in rows.items()} == want
    assert all(list(r["ids"]) == library.encode_ordinary(want[i]) for i, r in rows.items())
    assert {r["doc_id"]: bytes(r["data"]).decode() for r in bytepairs.decode(after).collect()} == want


def test_no_token_is_kept_beyond_the_room(library, monkeypatch):
    monkeypatch.setattr(bytepairs, "ROOM", 3)
    kept = bytepairs._Kept(bytepairs.encoder()._encoded)
    texts = random_texts(200, 12, 5)
    assert all(np.frombuffer(b"".join(map(kept.__getitem__, bytepairs.encoder().splitter.split(t))), "<u4").tolist() == library.encode_ordinary(t)
               for t in texts)
    assert len(kept) == 3


def test_query_op13(spark, library):
    rows = {r["doc_id"]: r for r in E.queries()["op13_byte_bpe_prefix"](spark, SF_SMALL).collect()}
    texts = duck(SF_SMALL).execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        ids = library.encode_ordinary(text or "")
        assert (rows[doc_id]["n_tokens"], rows[doc_id]["ids_sha256"], rows[doc_id]["decoded_sha256"]) == (
            len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest())


def test_odd_rows(spark, odd_docs):
    rows = bytepairs.encode_decode(odd_docs).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == odd_docs.count()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows if r["doc_id"] in (1, 2)} == {(0, empty, empty)}
    assert bytepairs.encode_decode(odd_docs.limit(0)).count() == 0 and bytepairs.encode(odd_docs.limit(0)).count() == 0
    assert {tuple(r) for r in bytepairs.encode_decode(odd_docs).collect()} == {tuple(r) for r in rows}
