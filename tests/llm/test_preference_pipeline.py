"""Preference pairs by a plain version; the pipeline stage by stage and as a whole."""

import importlib
import random
import sys
import zlib

import pytest

import __spark_entry__ as E
import corpus_pipeline
from brute import cut_repeats, near_duplicates
from conftest import SF_SMALL, duck
from llm_rows import docs, odd_docs  # noqa: F401
from rivalry.llm.common import cut_lineage
from rivalry.llm.preference import conversations, crossed_pairs, format_pairs, mask_text
from test_text_rules import base_spans
from test_tokens import check_layout


def render(turn):
    return f"<|im_start|>{turn[0]}\n{turn[1]}<|im_end|>\n"


def plain_pair(chosen, rejected):
    k = 0
    while k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
        k += 1

    def side(turns):
        at, mask = 0, []
        for t in turns:
            mask.append(f"{at}:{len(render(t))}:{int(t[0] == 'assistant')}")
            at += len(render(t))
        return "".join(map(render, turns)), ",".join(mask)

    return (k, "".join(map(render, chosen[:k])), *side(chosen[k:]), *side(rejected[k:]))


def test_query_op7(spark):
    turns = {}
    for c, _, role, text in duck(SF_SMALL).execute("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn").fetchall():
        turns.setdefault(c, []).append((role, text))
    want = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = plain_pair(ts, ts[:h] + turns.get(c + 1, [])[h:])
    assert len({w[0] for w in want.values()}) > 2 and any("," in w[3] for w in want.values())  # several lengths, several turns
    rows = E.queries()["op7_preference_format"](spark, SF_SMALL).collect()
    assert {r["pair_id"]: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)


def test_format_pairs_cases(spark):
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "nö")
    cases = {1: ([u, a], [u, b]), 2: ([u, a, u, b], [u, a]), 3: ([], [u]), 4: ([u], [u]), 5: ([a], [u])}
    rows = [(k, [(i, *t) for i, t in enumerate(c)], [(9 * i, *t) for i, t in enumerate(r)]) for k, (c, r) in cases.items()]
    kind = "array<struct<turn:bigint,role:string,text:string>>"
    out = format_pairs(spark.createDataFrame([*rows, (6, None, None)], f"pair_id int, chosen {kind}, rejected {kind}"))
    got = {r[0]: tuple(r)[1:] for r in out.select("pair_id", "n_prompt_turns", "prompt", "chosen", mask_text(out["chosen_mask"]),
                                                  "rejected", mask_text(out["rejected_mask"])).collect()}
    assert got == {k: plain_pair(*v) for k, v in cases.items()} | {6: (0, "", "", "", "", "")}


def test_conversations_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", None), (None, 0, "user", "x"), (3, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS turns", "2 AS chosen")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in conversations(df).collect()}
    assert got == {1: [(None, "", ""), (0, "user", "q"), (1, "assistant", "")], 3: [(0, "assistant", "z")]}
    pairs = crossed_pairs(df.unionByName(df.where("conv_id = 1").selectExpr("0 AS conv_id", *df.columns[1:])))
    assert {r["pair_id"]: (len(r["chosen"]), len(r["rejected"])) for r in pairs.collect()} == {0: (3, 3), 1: (3, 3), 3: (1, 1)}
    assert format_pairs(pairs).count() == 3
    long = spark.createDataFrame([(7, i, "user", f"w{i}" * 50) for i in range(3000)], "conv_id long, turn int, role string, text string")
    assert len(format_pairs(crossed_pairs(long)).first()["chosen"]) > 500_000
    assert format_pairs(crossed_pairs(df.limit(0))).count() == 0


def test_pipeline_equals_plain_version(spark):
    """Every stage against its plain version on the previous stage's real output."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    from rivalry.llm.common import cut_lineage
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF_SMALL), f"test-{name}")
        out.append({r["doc_id"]: r for r in docs.collect()} if name != "pack" else docs.collect())
    first = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    lang, near, cut, clean, packed = out
    assert {i: r["text"] for i, r in lang.items()} == {i: t for i, t in first.items() if t and any(c.isalpha() for c in t)}
    predicted = {r["doc_id"]: r["lang_pred"] for r in E.queries()["op3_string_kernel_langid"](spark, SF_SMALL).collect()}
    assert all(r["lang"] == predicted[i] for i, r in lang.items())
    comp = near_duplicates({i: r["text"] for i, r in lang.items()}, 5, 80)
    assert set(near) == {i for i in lang if comp[i][1] == i} and all(near[i] == lang[i] for i in near)
    left = {x[0]: x[5].decode("utf-8", "ignore") for x in cut_repeats([(i, r["text"]) for i, r in near.items()])}
    assert {i: r["text"] for i, r in cut.items()} == {i: t for i, t in left.items() if t.strip() or t == near[i]["text"]}
    for i, r in clean.items():
        t = r["text"]
        for s, _, e in base_spans(cut[i]["text"]):
            assert cut[i]["text"][s:e] not in t or not base_spans(t)
        assert base_spans(cut[i]["text"]) or t == cut[i]["text"]
    assert set(clean) == set(cut) == {r["doc_id"] for r in packed}
    check_layout(packed, 4096)
    run = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in run) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_pipeline_odd_rows(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, odd_docs.limit(0), SF_SMALL)
        assert nothing.count() == 0
        if name != "pack":
            assert nothing.columns == odd_docs.columns
        docs = stage(spark, docs, SF_SMALL)
    assert docs.count() >= 0 and docs.columns[:2] == ["doc_id", "piece"]


def test_pipeline_keeps_one_copy(spark, docs):
    """Of equal and nearly equal rows one survives all stages, repeated and null ids included."""
    rng = random.Random(8)

    def prose():
        return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(80))

    t = [prose() for _ in range(6)]
    rows = [(7, t[0]), (7, t[0]), (None, t[1]), (3, t[1]), (None, t[2]), (None, t[2]), (5, t[3]), (5, t[4]), (9, t[4] + " end"), (4, t[5])]
    left = docs([(i, x, "en") for i, x in rows])
    for name, stage in corpus_pipeline.STAGES:
        left = cut_lineage(stage(spark, left, SF_SMALL), f"test-copy-{name}")
        if name in ("near_dedup", "repeat_removal", "redact_pii"):
            got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
            assert got == sorted([(7, t[0]), (3, t[1]), (None, t[2]), (5, t[3]), (5, t[4]), (4, t[5])], key=repr), name
    assert {r["doc_id"] for r in left.collect()} == {7, 3, None, 5, 4}


def test_pipeline_without_labels(spark, docs):
    rows = docs([(1, "some text", None), (2, "12 ?", None), (3, None, None), (None, "é", None)])
    left = dict(corpus_pipeline.STAGES)["language_id"](spark, rows, SF_SMALL)
    assert left.columns == rows.columns and {(r["doc_id"], r["text"]) for r in left.collect()} == {(1, "some text"), (None, "é")}


def test_entry_without_the_optional_modules(monkeypatch):
    """Deleting the package or the pipeline leaves the other queries."""
    real = importlib.import_module

    def gone(name, *args):
        if name in ("rivalry.llm.queries", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", gone)
    spec = importlib.util.spec_from_file_location("entry_without_llm", E.__file__)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    keys = set(module.queries())
    assert "prepare_corpus" in keys and not any(k == "pipeline" or k.startswith("op") and k[2].isdigit() for k in keys)
    assert sys.modules["corpus_pipeline"] is corpus_pipeline
    assert {"pipeline", *[k for k in E.queries() if k.startswith("op")]} <= set(E.queries())
    with pytest.raises(KeyError):
        module.queries()["pipeline"]
