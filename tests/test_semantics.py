"""Micro-goldens for the semantics the engine pins down (M1-M16) on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from rivalry.functions import probs, templates as T
from rivalry.functions.lists import parse_list_join, parse_list_strict, parse_list_textual, strip_ws, word_count
from rivalry.operators import calibrate, folds, priors


def one(spark, expr, schema="s string", rows=None):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("x")).collect()]


def test_null_fold_stays_in_train(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 1)], "id int, fold int")
    train, valid = folds.fold_split(df, 0)
    assert sorted(r.id for r in train.collect()) == [1, 3]
    assert [r.id for r in valid.collect()] == [2]


def test_list_dialects(spark):
    rows = [('["a",null]',), ('["a","b"]',), ("bad",)]
    assert one(spark, parse_list_strict("s"), rows=rows) == [[], ["a", "b"], None]
    assert one(spark, parse_list_join("s"), rows=rows) == ["a ", "a b", None]
    assert one(spark, parse_list_textual("s"), rows=[('["a","b"]',)]) == ["a b"]
    # textual keeps a JSON null as text and does not unescape
    assert one(spark, parse_list_textual("s"), rows=[('["a",null]',)]) == ['a",null']


def test_unequal_zip_truncates(spark):
    df = spark.createDataFrame([(["p1", "p2", "p3"], ["a1"], ["b1", "b2"])], "p array<string>, a array<string>, b array<string>")
    text = df.select(T.render_instruction_blocks("p", "a", "b")).first()[0]
    assert text == "Instruction:\np1\n\nResponse A:\na1\n\nResponse B:\nb1\n\n"
    empty = spark.createDataFrame([([], ["a"], ["b"])], "p array<string>, a array<string>, b array<string>")
    assert empty.select(T.render_instruction_blocks("p", "a", "b")).first()[0] == ""


def test_argmax_first_maximum(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 1, 1), (0, 0, 0)], "a int, b int, c int")
    assert [r[0] for r in df.select(probs.argmax("a", "b", "c")).collect()] == [0, 1, 0]


def test_strip_and_words(spark):
    assert one(spark, strip_ws("s"), rows=[(" a\n ",)]) == ["a"]
    assert one(spark, word_count("s"), rows=[("",), ("  two\twords\n",)]) == [0, 2]


def test_qcut_duplicate_edges_raise(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,)], "x int")
    with pytest.raises(ValueError):
        calibrate.qcut_edges(df, "x", 4)


def test_qcut_matches_pandas(spark):
    pd = pytest.importorskip("pandas")
    vals = [((i * 7919) % 97) + 1 for i in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    d, edges = calibrate.with_qcut(df, "x", 10)
    ours = [r.bin for r in d.collect()]
    theirs = list(pd.qcut(pd.Series(vals), q=10, labels=False))
    assert ours == theirs


def test_prior_reversed_pair_swaps_weights(spark):
    pr = spark.createDataFrame([("a", "b", 5, 2, 3)], "m0 string, m1 string, w0 long, w1 long, wt long")
    pred = spark.createDataFrame([(1, "b", "a"), (2, "a", "b"), (3, "a", "c")], "id int, model_a string, model_b string")
    r = {x.id: (x.wa, x.wb, x.wtie) for x in priors.pair_prior_join(pred, pr).collect()}
    assert r[1] == (2.0, 5.0, 3.0) and r[2] == (5.0, 2.0, 3.0) and r[3] == (1.0, 1.0, 1.0)


def test_unnormalised_probabilities_log_loss(spark):
    df = spark.createDataFrame([(0, 0.2, 0.1, 0.1)], "label int, a double, b double, c double")
    v = df.select(probs.row_log_loss("label", "a", "b", "c")).first()[0]
    assert math.isclose(v, -math.log(0.5), rel_tol=1e-12)


def test_clip_zero_probability(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, 0.0)], "label int, a double, b double, c double")
    v = df.select(probs.row_log_loss("label", "a", "b", "c")).first()[0]
    assert math.isclose(v, -math.log(2.220446049250313e-16), rel_tol=1e-6)


def test_hash_coin_is_deterministic(spark):
    from rivalry.functions.text import hash_coin
    df = spark.range(1000)
    c1 = df.select("id", hash_coin(F.col("id")).alias("c")).orderBy("id").collect()
    c2 = df.repartition(7).select("id", hash_coin(F.col("id")).alias("c")).orderBy("id").collect()
    assert c1 == c2
    share = sum(r.c for r in c1) / 1000
    assert 0.4 < share < 0.6


def test_dedup_keeps_first_in_source_order(spark):
    from rivalry.operators.combine import dedup_keep_first
    df = spark.createDataFrame([(5, 1, "t"), (9, 0, "t"), (2, 1, "t"), (7, 0, "u")], "id int, src int, text string")
    got = sorted((r.text, r.id) for r in dedup_keep_first(df, "text", ["src", "id"]).collect())
    assert got == [("t", 9), ("u", 7)]


def test_lookup_last_duplicate_wins(spark):
    from rivalry.operators.combine import left_join_lookup
    base = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    look = spark.createDataFrame([(1, 10.0, 0), (1, 11.0, 5), (2, 20.0, 1)], "key int, v double, pos int")
    got = {r.k: r.v for r in left_join_lookup(base, look, "k", "key", "v", "pos").collect()}
    assert got == {1: 11.0, 2: 20.0, 3: None}


def test_json_unescaping(spark):
    assert one(spark, parse_list_strict("s"), rows=[(r'["b\/c","x\"y"]',)]) == [["b/c", 'x"y']]


def test_swap_apply_flag(spark):
    from rivalry.operators.labels import swap_augment
    df = spark.createDataFrame([(i, "a", "b", i % 3) for i in range(50)], "id int, response_a string, response_b string, label int")
    kept = swap_augment(df, apply=False)
    assert kept.filter("swapped").count() == 0
    assert sorted(kept.drop("swapped").collect()) == sorted(df.collect())


def test_user_tokenizer_matches_word_count(spark):
    from rivalry.functions.text import token_count_with
    rows = [("a b  c",), ("",), (None,), ("one\ttwo\nthree four",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(token_count_with(str.split)("s")).collect()]
    ref = [r[0] for r in df.select(word_count(F.coalesce("s", F.lit("")))).collect()]
    assert got == ref == [3, 0, 0, 4]


def test_pad_and_mask(spark):
    from rivalry.operators.training_log import pad_and_mask
    df = spark.createDataFrame([(0, ["a"] * 3), (0, ["b"] * 10), (1, ["c"] * 2)], "batch long, tok array<string>")
    rows = sorted(pad_and_mask(df, "tok", "batch").collect(), key=lambda r: (r.batch, len(r.tok)))
    assert [len(r.padded) for r in rows] == [16, 16, 8]
    assert rows[0].attention_mask == [1] * 3 + [0] * 13
    assert rows[2].padded == ["c", "c"] + ["<pad>"] * 6
