"""Property and skew tests: invariants, exact-vs-brute-force, hot keys."""

import math
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MED, SF_SMALL
from rivalry.operators import calibrate, combine, folds, knn, labels, metrics, priors
from rivalry.operators.ordered import ordered_index, running_aggregates
from rivalry.plans import fixtures as fx
from rivalry.session import cut_lineage


def test_probabilities_sum_to_one(spark):
    p = metrics.with_probs(fx.battles_big(spark, SF_SMALL))
    worst = p.agg(F.max(F.abs(F.col("A") + F.col("B") + F.col("tie") - 1)).alias("e")).first()["e"]
    assert worst < 1e-12


def test_swap_twice_is_identity(spark):
    df = spark.createDataFrame([(1, "x", "y", 0), (2, "p", "q", 2), (3, "u", "v", 1)],
                               "id int, response_a string, response_b string, label int")
    c = F.lit(True)
    twice = labels.swap_sides(labels.swap_sides(df, c), c)
    assert sorted(twice.collect()) == sorted(df.collect())


def test_pair_counts_total(spark):
    bb = fx.battles_big(spark, SF_SMALL)
    a1 = priors.pair_win_counts(bb)
    tot = a1.agg(F.sum(F.col("w0") + F.col("w1") + F.col("wt")).alias("t"), F.count("*").alias("n")).first()
    battles = bb.filter(F.col("model_a") != F.col("model_b")).count()
    assert tot.t == battles + 3 * tot.n


def test_fold_sizes_balanced_per_class(spark):
    bb = fx.battles_big(spark, SF_MED).select("id", "label")
    f = folds.stratified_kfold(bb, 5, shuffle=True)
    counts = Counter((r.label, r.fold) for r in f.collect())
    for lab in {k[0] for k in counts}:
        sizes = [counts.get((lab, i), 0) for i in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_blend_evaluates_the_whole_grid(spark):
    """Equal to a plain loop over 1001 weights, also on rows that do not sum to 1."""
    import math
    import random
    pz = metrics.with_probs(metrics.with_probs(fx.battles_big(spark, SF_SMALL)), ("g0", "g1", "g2"), ("qa", "qb", "qt"))
    best = calibrate.blend_grid_search(pz, ps=("A", "B", "tie"), qs=("qa", "qb", "qt")).first()
    only_p = metrics.log_loss(pz).first()["log_loss"]
    assert best.best_loss <= best.base_loss + 1e-12 and best.best_loss <= only_p + 1e-12
    for seed in range(4):
        rng = random.Random(seed)
        rows = [(rng.randrange(3), *[rng.random() ** 3 + 1e-3 for _ in range(6)]) for _ in range(12)]

        def loss(w):
            out = 0.0
            for y, *v in rows:
                mix = [w * a + (1 - w) * b for a, b in zip(v[:3], v[3:])]
                out -= math.log(max(1e-15, min(1 - 1e-15, mix[y] / sum(mix)))) / len(rows)
            return out

        want = min((round(loss(i / 1000), 9), i / 1000) for i in range(1001))[1]
        df = spark.createDataFrame(rows, "label int, pa double, pb double, pt double, qa double, qb double, qt double")
        assert calibrate.blend_grid_search(df).first().best_w == want


def test_last_context_row_of_a_prompt_counts(spark):
    """Prompt x asked twice (two samples), y once with a low similarity: no shift."""
    from rivalry.operators.context import context_lookup, inject_context
    battles = spark.createDataFrame([(1, ["x", "y", "x"], ["a1", "a2", "a3"], ["b1", "b2", "b3"])],
                                    "id int, p array<string>, a array<string>, b array<string>")
    ctx = spark.createDataFrame([("x", "s", "stale-one", 0.9, 1), ("y", "s", "weak-one", 0.1, 2), ("x", "s", "new", 0.95, 3)],
                                "prompt string, similar_prompt string, similar_response string, similarity double, row long")
    look = sorted((r.pos, r.similar_response) for r in context_lookup(battles, ctx).collect())
    assert look == [(0, "new"), (1, "weak-one"), (2, "new")]
    r = inject_context(battles, ctx).first()
    assert (r.n_missing, r.n_added) == (0, 2) and "stale-one" not in r.text and "weak-one" not in r.text


def test_null_keys_series_and_labels(spark):
    from rivalry.operators import ordered, training_log
    rows = [(None, 5), (3, 1), (1, 2), (None, 4)]
    df = spark.createDataFrame(rows, "id int, x int")
    got = sorted((r.rn, r.id) for r in ordered.ordered_index(df, ["id", "x"]).collect())
    assert got == [(1, None), (2, None), (3, 1), (4, 3)]
    log = spark.createDataFrame([(None, i, v) for i, v in enumerate([3.0, 2.0, 2.5, 2.6, 1.0])], "fold int, step int, loss double")
    out = training_log.early_stop(log, "loss", "step", ["fold"], patience=2).collect()
    assert [tuple(r) for r in out] == [(None, 4, 2, 2.0)]
    assert tuple(training_log.early_stop(log, "loss", "step", ["fold"], patience=3).first()) == (None, None, 5, 1.0)
    labels = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(20)], "id int, label int")
    sizes = Counter((r.label, r.fold) for r in folds.stratified_kfold(labels, 5).collect())
    assert set(sizes.values()) == {2} and len(sizes) == 10


def test_requested_range_buckets_are_reached(spark):
    from rivalry.operators import ordered
    d = ordered.with_range_bucket(spark.range(200_000), "id", 2000)
    assert d.groupBy(ordered.BUCKET).count().agg(F.max("count")).first()[0] <= 200


def test_knn_ships_the_corpus_once_whatever_the_queries(spark):
    """Rows entering the scoring exchange: corpus rows + wanted query rows; ties keep the smaller id."""
    rows = [(i, [float(i % 3), 1.0]) for i in range(30)]
    c = spark.createDataFrame(rows, "id long, embedding array<double>")
    for n in (5, 50):
        q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(n)], "q_id long, embedding array<double>")
        got = knn.knn_join(q, c, k=2).collect()
        assert {(r.rank, r.id) for r in got} == {(1, 2), (2, 5)} and len(got) == 2 * n
    empty = c.limit(0)
    assert knn.knn_join(q, empty).count() == 0 and knn.knn_join(q.limit(0), c).count() == 0


def test_approx_knn_answers_every_query(spark):
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1])], "id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "q_id long, embedding array<double>")
    got = {r.q_id: r.id for r in knn.knn_approx_join(q, c).collect()}
    assert set(got) == {0, 1} and got[1] == 1


def test_unparsable_list_cells_are_set_aside(spark):
    from rivalry.functions.lists import quarantine_unparsed
    df = spark.createDataFrame([(1, '["a"]', '["b", null]'), (2, "[oops", '["b"]'), (3, None, "also bad"), (4, "[]", "[]")],
                               "id int, p string, a string")
    good, bad = quarantine_unparsed(df, "p", "a")
    assert sorted(r.id for r in good.collect()) == [1, 4] and good.columns == df.columns
    assert {r.id: r.bad_cells for r in bad.collect()} == {2: ["p"], 3: ["a"]}


def test_csv_sink_replaces_bad_bytes(spark, tmp_path):
    from rivalry.sources import io
    df = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"a\xffb"))], "id int, raw binary")
    df = df.selectExpr("id", "cast(raw AS string) AS text")
    io.write_csv(df, str(tmp_path / "out"))
    back = {r.id: r.text for r in io.read_csv(spark, str(tmp_path / "out"), "id int, text string").collect()}
    assert back == {1: "ok", 2: "a\ufffdb"}


def test_one_hot_length_is_spread(spark):
    """All rows of one length: windows hold ranges of the key, the batches stay exact."""
    from rivalry.operators import ordered, training_log
    d = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(F.lit(9)).alias("n"))
    out = {r.id: r.batch for r in training_log.length_sort_batches(d, "n", "id").collect()}
    order = sorted((r.id for r in d.collect()), key=lambda i: (-(i % 7 if i % 50 == 0 else 9), i))
    assert out == {i: k // 8 for k, i in enumerate(order)}
    b = ordered.with_range_bucket(d, "id", ordered.buckets_for(5000, 100))
    assert b.groupBy("n", ordered.BUCKET).count().agg(F.max("count")).first()[0] <= 200


def test_exact_quantiles_of_many_values(spark):
    import numpy as np
    from rivalry.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=20000), np.repeat([0.5, 2.0], 3000)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    ps = [0, 0.01, 0.25, 0.5, 0.77, 0.999, 1]
    assert np.allclose(exact_quantiles(df, "x", ps), np.quantile(x, ps), atol=1e-12)
    assert exact_quantiles(df.limit(0), "x", [0.5]) == [None]


def test_checkpoint_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from rivalry import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Fake:
        conf, sparkContext = Conf(), None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Fake())


def test_dedup_idempotent(spark):
    df = spark.createDataFrame([(i, i % 5, f"t{i % 7}") for i in range(60)], "id int, src int, text string")
    once = combine.dedup_keep_first(df, "text", ["src", "id"])
    twice = combine.dedup_keep_first(once, "text", ["src", "id"])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert once.count() == 7


def test_ordered_index_with_hot_key(spark):
    # one key holds a third of all rows: numbering must equal a plain row_number
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 17}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, key string")
    ours = ordered_index(df, ["id"], ["key"], name="rn")
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    assert sorted(ours.collect()) == sorted(ref.select("id", "key", F.col("rn").cast("long")).collect())


def test_running_min_with_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else "cold", float((i * 37) % 101)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, key string, v double")
    ours = running_aggregates(df, ["id"], ["key"], {"m": ("v", "min"), "s": ("v", "sum")})
    w = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("id", "key", "v", F.min("v").over(w).alias("m"), F.sum("v").over(w).alias("s"))
    assert sorted(ours.select("id", "key", "v", "m", "s").collect()) == sorted(ref.collect())


def test_exact_knn_equals_brute_force(spark):
    q, c = fx.retrieval_queries(spark, SF_MED), fx.retrieval_corpus(spark, SF_MED)
    ours = {(r.q_id, r.rank): r.id for r in knn.knn_join(q, c, k=3).collect()}
    ref = {(r.q_id, r.rank): r.id for r in knn.knn_brute_force(q, c, k=3).collect()}
    assert ours == ref


def test_exact_knn_with_small_chunks(spark):
    # force many corpus and query chunks per cell (a hot cell split across tasks)
    q, c = fx.retrieval_queries(spark, SF_SMALL), fx.retrieval_corpus(spark, SF_SMALL)
    ours = {(r.q_id, r.rank): r.id for r in knn.knn_join(q, c, k=2, block_bytes=8 * 64 * 7, query_chunk=5).collect()}
    ref = {(r.q_id, r.rank): r.id for r in knn.knn_brute_force(q, c, k=2).collect()}
    assert ours == ref


def test_exact_knn_with_many_cells(spark):
    q, c = fx.retrieval_queries(spark, SF_SMALL), fx.retrieval_corpus(spark, SF_SMALL)
    idx = knn.build_cell_index(c, members=7)
    ours = {(r.q_id, r.rank): r.id for r in knn.knn_join(q, c, k=3, index=idx).collect()}
    ref = {(r.q_id, r.rank): r.id for r in knn.knn_brute_force(q, c, k=3).collect()}
    assert ours == ref


@pytest.mark.parametrize("k,dim,spread", [(1, 8, 0.02), (3, 8, 1.0), (1, 3, 1.0)])
def test_exact_knn_in_rounds_equals_shipping_and_brute_force(spark, monkeypatch, k, dim, spread):
    """Cells in one round or several, one cell in many; vectors of different length, repeats, zeros, repeated query ids."""
    monkeypatch.setattr(knn, "SHELL_ROWS", 20)
    rng = np.random.default_rng(9)
    mid = rng.normal(size=(5, dim))
    x = np.round(mid[rng.integers(0, 5, 900)] + spread * rng.normal(size=(900, dim)), 2) * rng.choice([0.5, 1.0, 4.0], 900)[:, None]
    x[::50], x[100:140] = 0.0, x[100]
    c = spark.createDataFrame([(i * 7 % 900, v.tolist()) for i, v in enumerate(x[:700])], "id long, embedding array<double>")
    q = spark.createDataFrame([(min(i, 190), v.tolist()) for i, v in enumerate(x[500:])], "q_id long, embedding array<double>")
    key = lambda rows: sorted((r.q_id, r.rank, round(r.similarity, 9)) for r in rows)
    want = knn.knn_brute_force(q, c, k).collect()
    shipped = knn.knn_join(q, c, k, shipped=math.inf).collect()
    for size in (8 * dim * 30, knn.ROUND_BYTES):
        got = knn.knn_join(q, c, k, shipped=0, round_bytes=size).collect()
        assert key(got) == key(shipped) == key(want)
    vec = {r.id: np.array(r.embedding) for r in c.collect()}
    asked = {}
    for r in q.collect():
        asked.setdefault(r.q_id, []).append(np.array(r.embedding))
    assert all(min(abs(v @ vec[r.id] - r.similarity) for v in asked[r.q_id]) < 1e-9 for r in got)


def test_knn_on_vectors_without_clusters_ships_no_query_to_every_cell(spark, monkeypatch):
    """40 wide cells: the disk holds a few copies of the vectors, not queries x cells."""
    seen, real = [], knn._cells_of
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16)).tolist()
    c = spark.createDataFrame(list(enumerate(x[:800])), "id long, embedding array<double>")
    q = spark.createDataFrame(list(enumerate(x[800:])), "q_id long, embedding array<double>")
    monkeypatch.setattr(knn, "cut_lineage", lambda df, name: seen.append((name, cut_lineage(df, name))) or seen[-1][1])
    index = knn.build_cell_index(c, members=20)
    got = knn.knn_join(q, c, index=index)
    assert {n: d.count() for n, d in seen} == {"knn-index": 800, "knn-queries": 400, "knn-asked": 400}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "knn-found" in plan  # the neighbours are there already: nothing but their ranking is shuffled
    assert {(r.q_id, r.id) for r in got.collect()} == {(r.q_id, r.id) for r in knn.knn_brute_force(q, c).collect()}


def test_lsh_recall(spark):
    q, c = fx.retrieval_queries(spark, SF_MED), fx.retrieval_corpus(spark, SF_MED)
    exact = knn.knn_join(q, c, k=1)
    approx = knn.knn_approx_join(q, c)
    assert knn.recall_at_1(approx, exact) >= 0.9


def test_stream_counts_equal_batch(spark):
    import __spark_entry__ as E
    qs = E.queries()
    a = sorted(qs["stream_pair_counts"](spark, SF_SMALL).collect())
    b = sorted(qs["pair_win_counts"](spark, SF_SMALL).select("m0", "m1", "w0", "w1", "wt").collect())
    assert a == b


def test_linear_head_beats_chance(spark):
    import __spark_entry__ as E
    p = E.queries()["linear_head"](spark, SF_MED)
    acc = p.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert acc > 0.6  # 3 classes: chance is 1/3


def test_stream_ingest_restart_is_idempotent(spark):
    from rivalry.operators import requests as R
    from rivalry.session import scratch_path
    from rivalry.streaming.ingest import ingest_results
    src, good, bad, ck = (scratch_path(spark, n) for n in ("t-in", "t-good", "t-bad", "t-ck"))
    R.result_lines(fx.results_table(spark, SF_SMALL), blank_every=13).repartition(3).write.text(src)
    ingest_results(spark, src, good, bad, ck, max_files_per_trigger=1)
    first = sorted(r.custom_id for r in spark.read.parquet(good).collect())
    ingest_results(spark, src, good, bad, ck, max_files_per_trigger=1)  # restart: nothing new
    again = sorted(r.custom_id for r in spark.read.parquet(good).collect())
    assert first == again and len(first) == len(set(first))
    n_bad = spark.read.parquet(bad).count()
    assert len(first) + n_bad == fx.results_table(spark, SF_SMALL).count()


def test_tree_and_svm_heads_beat_chance(spark):
    import __spark_entry__ as E
    for key in ("gbm_classify", "svm_classify", "model_store"):
        p = E.queries()[key](spark, SF_MED)
        acc = p.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        assert acc > 0.6, key


def test_numbering_with_many_buckets(spark, monkeypatch):
    # force the large-table paths: tiny buckets and no literal offsets
    from rivalry.operators import ordered
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 7)
    monkeypatch.setattr(ordered, "MIN_BUCKETS", 2)
    monkeypatch.setattr(ordered, "LITERAL_OFFSETS", 3)
    rows = [(i * 3 + (i % 5), "hot" if i % 3 == 0 else "cold", float((i * 37) % 101)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, key string, v double")
    glob = ordered.ordered_index(df, ["id"], name="rn")
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("id")).cast("long"))
    assert sorted(glob.collect()) == sorted(ref.collect())
    run = ordered.running_aggregates(df, ["id"], [], {"s": ("v", "sum"), "m": ("v", "max")})
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    ref2 = df.select("id", "key", "v", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"))
    assert sorted(run.select("id", "key", "v", "s", "m").collect()) == sorted(ref2.collect())
    part = ordered.ordered_index(df, ["id"], ["key"], name="rn")
    ref3 = df.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("id")).cast("long"))
    assert sorted(part.collect()) == sorted(ref3.collect())


def test_retrieval_augmentation_end_to_end(spark):
    import __spark_entry__ as E
    out = E.queries()["retrieval_augmentation"](spark, SF_SMALL)
    rows = out.collect()
    assert len(rows) == fx.battles_text(spark, SF_SMALL).count()
    assert all(r.n_missing == 0 for r in rows)  # every prompt turn has a nearest corpus prompt
    assert all(r.text.startswith("<|begin_of_text|>") for r in rows)
