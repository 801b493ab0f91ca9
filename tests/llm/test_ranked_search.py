"""Ranked search: equal to a plain version that scores every document."""

import collections
import math
import random
import re

import numpy as np
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL, duck
from llm_rows import docs, odd_docs  # noqa: F401
from rivalry.llm.ranked_search import TERM, search, settle, terms

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def plain_search(texts, items, k=50):
    """[(doc_id, text)], [(item_id, text)] → {item_id: [(rank, doc_id, score)]}."""
    counts = [(i, collections.Counter(plain_terms(t))) for i, t in texts]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        scored = []
        for i, c in counts:
            n = sum(c.values())
            score = 0
            for t in set(plain_terms(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * (50 + (50 * n * n_docs) // total)))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out[item] = [(r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return {i: rows for i, rows in out.items() if rows}


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"])):
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return dict(out)


def test_terms_equal_the_pattern():
    rng = random.Random(0)
    alphabet = [chr(c) for c in range(0x250)] + list("漢字\U0001F600 　éÉß")
    for _ in range(2000):
        text = "".join(rng.choices(alphabet, k=40))
        assert [t.decode() for t in terms(text)] == plain_terms(text)


@pytest.mark.parametrize("seed", range(5))
def test_settled_scores_equal_full_sums(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n_docs, k = int(rng.integers(1, 3000)), int(rng.integers(1, 60))
        lists, full = [], np.zeros(n_docs, np.int64)
        for _ in range(int(rng.integers(1, 9))):
            own = rng.choice(n_docs, int(rng.integers(0, n_docs + 1)), replace=False)
            gains = np.sort(rng.integers(1, int(rng.choice([3, 1000])), len(own)))[::-1].astype(np.int64)
            lists.append((own, gains))
            full[own] += gains
        floor = int(rng.choice([0, full.max(), int(np.median(full))]))
        got, scores = settle(lists, n_docs, k, floor)
        assert (full[got] == scores).all()
        kth = max(1, floor, int(np.sort(full)[::-1][k - 1]) if n_docs >= k else 0)
        assert set(np.flatnonzero(full >= kth)) <= set(got.tolist())


@pytest.mark.parametrize("seed,k,sizes", [(0, 5, {}), (1, 3, {"shard_docs": 7}), (2, 50, {"shard_postings": 40, "block_terms": 6})])
def test_equals_the_plain_version(spark, docs, seed, k, sizes):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Één", "x-y", "A.b"]
    texts = [(i, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.choice([0, 1, 3, 30, 200])))) for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)] + [(90, "unknown only"), (91, None), (92, "")]
    got = search(docs([(i, t, None) for i, t in texts]), spark.createDataFrame(items, "item_id long, text string"), k=k, **sizes)
    assert found(got) == plain_search(texts, items, k)


def test_ties_repeats_and_nulls(spark, docs):
    texts = [(5, "a b"), (2, "a b"), (2, "a b"), (None, "a b"), (9, "c d e"), (10, "c d"), (11, None), (12, ""), (13, "z " * 30000 + "a"), (14, "q"), (15, "r")]
    items = [(1, "a a A"), (2, "c"), (2, "d"), (3, "none")]
    got = search(docs([(i, t, None) for i, t in texts]), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_search(texts, items[:1])
    assert [(r["rank"], r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["item_id"] == 1] == want[1]
    assert sorted(r["doc_id"] for r in got if r["item_id"] == 2) == [9, 9, 10, 10]  # both rows of the item are ranked
    assert not [r for r in got if r["item_id"] == 3]


def test_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "one word x", "y"), (1, None, None)], "item_id long, text string, doc_id string")
    assert search(odd_docs, items).count() > 0
    for a, b in ((odd_docs.limit(0), items), (odd_docs, items.limit(0)), (odd_docs.where("text is null"), items)):
        df = search(a, b)
        assert df.columns == ["item_id", "rank", "doc_id", "score"] and df.count() == 0


def test_query_op11(spark):
    con = duck(SF_SMALL)
    want = plain_search(con.execute("SELECT doc_id, text FROM documents").fetchall(), con.execute("SELECT item_id, text FROM benchmark").fetchall())
    assert found(E.queries()["op11_nra_search"](spark, SF_SMALL)) == want
