"""Conversation trie: equal to a plain version."""

import collections
import hashlib
import random
import zlib

import pytest

import __spark_entry__ as E
from conftest import SF_MED, duck
from rivalry.llm.turn_trie import COLUMNS, conversation_turns, end_digests, prefix_trie, share_heads

SCHEMA = "conv_id long, turn int, role string, text string, depth string, name int"


def plain_trie(rows, shared=True):
    """Rows (conv_id, turn, role, text) → set of result rows."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(ts)] for c, ts in convs.items()}
    if shared:
        built = {}
        for c, own in turns.items():
            h = zlib.crc32(str(c).encode()) % 6
            built[c] = turns.get(c - c % 100, [])[:h] + own[h:]
        turns = built
    nodes = collections.defaultdict(list)
    for c, ts in turns.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * (len(k[-1][1]) if k else 0)
    out = set()
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(turns[c]) == len(k))))
        out.add((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def result(df):
    rows = df.select(*[c for c, _ in COLUMNS]).collect()
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


def random_rows(rng, n, longest, texts):
    return [(c, t, rng.choice(["user", "assistant"][t % 2:t % 2 + 1] + ["user"]), rng.choice(texts))
            for c in range(n) for t in range(rng.choice([1, 2, 3, longest]))]


@pytest.mark.parametrize("seed,n,longest", [(0, 260, 4), (1, 120, 9), (2, 30, 33)])
def test_equals_the_plain_version(spark, seed, n, longest):
    rng = random.Random(seed)
    rows = random_rows(rng, n, longest, ["a", "bb", "é字", ""])
    assert result(prefix_trie(share_heads(conversation_turns(conversations(spark, rows))))) == plain_trie(rows)


def test_one_common_and_one_very_long_conversation(spark):
    rows = [(c, t, "user", "same" if c % 3 else f"{c}") for c in range(90) for t in range(2)] + [(500, t, "user", f"{t}") for t in range(300)]
    got = result(prefix_trie(conversation_turns(conversations(spark, rows))))
    assert got == plain_trie(rows, shared=False)
    assert max(r[1] for r in got) == 300


def test_nulls_ties_and_repeats(spark):
    rows = [(100, 1, "user", "b"), (100, 1, "user", "a"), (100, None, None, None), (100, 1, "user", "a"), (None, 0, "user", "x"), (101, 0, None, "q"),
            (199, None, "user", None), (-7, 0, "user", "n"), (207, 0, "user", "gone"), (207, 1, "user", "stays?")]
    assert result(prefix_trie(share_heads(conversation_turns(conversations(spark, rows))))) == plain_trie(rows)


def test_empty_table(spark):
    empty = conversations(spark, [(1, 1, "user", "a")]).limit(0)
    df = prefix_trie(share_heads(conversation_turns(empty)))
    assert df.columns == [c for c, _ in COLUMNS] and df.count() == 0


def test_conversations_without_turns_end_at_the_root(spark):
    sequences = spark.createDataFrame([(4, []), (9, []), (5, ["a" * 32 + "00000002"])], "conv_id long, turns array<string>")
    got = {r["depth"]: r for r in prefix_trie(sequences).collect()}
    assert got[0]["ends_sha256"] == hashlib.sha256(b"4,9").hexdigest() and got[0]["n_convs"] == 3
    assert (got[1]["conv_id"], got[1]["parent_conv_id"], got[1]["saved_tokens"]) == (5, 4, 0)
    only = prefix_trie(sequences.where("conv_id = 4")).collect()
    assert [(r["depth"], r["n_leaves"], r["n_children"]) for r in only] == [(0, 1, 0)]


def test_digests_of_long_lists(spark):
    members = spark.range(20_000).selectExpr("if(id % 4 = 0, concat('n', id % 50), 'hot') as name", "id * 7 as conv_id").repartition(7)
    want = collections.defaultdict(list)
    for r in members.collect():
        want[r["name"]].append(r["conv_id"])
    got = {r["name"]: r["ends_sha256"] for r in end_digests(members, run=100).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


def test_query_op12(spark):
    rows = duck(SF_MED).execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert result(E.queries()["op12_conversation_trie"](spark, SF_MED)) == plain_trie(rows)
