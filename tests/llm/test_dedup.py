"""Near-dedup, repeat removal and the vector join equal their brute-force versions."""

import random

import pytest

import __spark_entry__ as E
from brute import components as brute_components
from brute import cut_repeats, near_duplicates as brute_near, near_vectors as brute_vectors, shingles
from conftest import SF_MED, SF_SMALL, duck
from llm_rows import docs, odd_docs  # noqa: F401
from rivalry.llm.components import components
from rivalry.llm.neardup import least_matches, near_duplicates
from rivalry.llm.suffixes import remove_repeats
from rivalry.llm.vectors import near_vectors


def texts_of(sf):
    return dict(duck(sf).execute("SELECT doc_id, text FROM documents").fetchall())


def check_near(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_query_op9(spark):
    check_near(E.queries()["op9_minhash_near_dedup"](spark, SF_MED).collect(), brute_near(texts_of(SF_MED), 3, 85))


@pytest.fixture(scope="module")
def edited():
    """Groups of copies of one text with a few words changed."""
    rng = random.Random(4)
    rows = {}
    for g in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 30, 200]))]
        for k in range(25):
            w = list(words)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
            rows[100 * g + k] = rng.choice([" ", "\n", "\t "]).join(w).replace("w1", rng.choice(["w1", "W1"]))
    return rows


@pytest.mark.parametrize("width,percent,block", [(3, 85, 1 << 20), (5, 80, 300)])
def test_near_groups_and_blocks(spark, docs, edited, width, percent, block):
    df = docs([(i, t, None) for i, t in edited.items()])
    check_near(near_duplicates(df, width, percent, block_shingles=block).collect(), brute_near(edited, width, percent))


def test_near_odd_rows(spark, odd_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["component_id"] == r["doc_id"] and r["kept"]
    assert near_duplicates(odd_docs.limit(0)).count() == 0


def test_near_shared_ids_and_long_words(spark, docs):
    """Rows of one doc_id count as one document, whatever stands first; no byte of a word is left out."""
    rng = random.Random(6)
    t = [" ".join(f"{x}{rng.randrange(900)}" for _ in range(60)) for x in "abcd"]
    near = t[0] + " more"
    long = ["".join(rng.choices("abcdefgh", k=4096)) for _ in range(3)]
    swapped = [" ".join([long[i] + long[j] + long[k], "one two three"]) for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 1, 0))]
    base = [(6, near), (7, t[1]), (8, t[1] + " end"), (9, t[2]), (20, swapped[0]), (21, swapped[1]), (22, swapped[2]), (None, t[2]), (30, ""), (31, None)]
    for own in ([(5, None), (5, t[0])], [(5, t[0]), (5, None)], [(5, t[0]), (5, t[1])], [(5, t[1]), (5, t[0]), (5, t[2]), (5, None), (5, t[0])],
                [(50, t[3]), (5, t[3]), (5, ""), (50, t[2])]):
        rows = own + base
        ids = [i for i, _ in rows if i is not None]
        sets = [(i, shingles(x, 3)) for i, x in rows]
        links = [(i, j) for i, a in sets for j, b in sets if None not in (i, j) and a and b and 100 * len(a & b) >= 85 * len(a | b)]
        comp = brute_components(set(ids), links)
        got = near_duplicates(docs([(i, x, None) for i, x in rows])).collect()
        want = sorted(((i, len(s), comp.get(i), comp.get(i, i) == i) for i, s in sets), key=repr)
        assert sorted((tuple(r) for r in got), key=repr) == want


def test_least_matches():
    assert least_matches(64, 85) < 0.85 * 64 and least_matches(64, 100) == 64


def test_components(spark):
    rng = random.Random(0)
    for links in ([(i, i + 1) for i in range(40)], [(rng.randrange(300), rng.randrange(300)) for _ in range(180)], [(5, 5), (2, 3)], []):
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        real = [x for x in links if x[0] != x[1]]
        assert got == brute_components({n for x in real for n in x}, real)


def check_repeats(rows, want):
    assert sorted((tuple(r) for r in rows), key=repr) == sorted((x[:5] for x in want), key=repr)


def test_query_op10(spark):
    check_repeats(E.queries()["op10_suffix_dedup"](spark, SF_SMALL).collect(), cut_repeats(list(texts_of(SF_SMALL).items())))


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats_random(spark, docs, hot):
    rng = random.Random(3)
    base = ["".join(rng.choices("ab é", k=rng.randint(0, 150))) for _ in range(12)]
    rows = [(n, "".join(rng.choices(base, k=rng.randint(0, 6)))) for n in range(120)]
    rows += [(900, None), (901, ""), (902, "x" * 5000), (903, "ab" * 300), (None, "q" * 50), (904, base[3] * 3), (904, base[3] * 3)]
    check_repeats(remove_repeats(docs([(i, t, None) for i, t in rows]), hot_classes=hot).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), cut_repeats(rows))


def test_repeats_keep_columns_and_odd_rows(spark, odd_docs):
    out = remove_repeats(odd_docs, with_text=True)
    assert out.columns[:len(odd_docs.columns)] == odd_docs.columns and out.count() == odd_docs.count()
    assert remove_repeats(odd_docs.limit(0)).count() == 0


def test_repeats_of_shared_and_null_ids(spark, docs):
    """Each row loses its own ranges only, whatever its doc_id."""
    rng = random.Random(5)
    a, b, c, d, e = ("".join(rng.choices("abcdefgh ", k=700)) for _ in range(5))
    rows = [(None, a[:500] + b), (None, c), (1, d + a[:500]), (2, e), (2, b[:300] + "z" * 150 + d[:300]), (None, c[:400] + e[:50]), (None, ""), (2, None)]
    rows += [(None, a), (None, a), (3, a)]
    for hot in (4096, 1):
        out = remove_repeats(docs([(i, t, None) for i, t in rows]), hot_classes=hot)
        check_repeats(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), cut_repeats(rows))


def check_vectors(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        assert (r["n_links"], r["component_id"]) == want[r["vec_id"]]
        assert r["kept"] == (r["component_id"] == r["vec_id"])


def test_query_op6(spark):
    rows = duck(SF_SMALL).execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    check_vectors(E.queries()["op6_metric_range_join"](spark, SF_SMALL).collect(), brute_vectors(rows))


@pytest.mark.parametrize("size", [{}, {"cell_size": 20, "block": 15}])
def test_vectors_random_and_odd(spark, size):
    rng = random.Random(2)
    # multiples of 1/8: the same as float and double
    rows = [(n, [rng.choice([0.0, 1.0, 0.875, -1.0, 0.125]) for _ in range(3)], rng.choice([1, 2, None])) for n in range(300)]
    rows += [(500, None, 1), (501, [1.0, None, 2.0], 1), (502, [float("nan"), 1.0, 1.0], 1), (503, [float("inf"), 1.0, 1.0], 1),
             (504, [], 1), (505, [1.0, 1.0], 1), (506, [1.0, 1.0], 1), (507, [0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    check_vectors(near_vectors(df, **size).collect(), brute_vectors(rows))
    assert near_vectors(df.limit(0)).count() == 0
