"""Boosting, kernel machines, out-of-fold scores, text features and the vector index."""

import math
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF_MED, SF_SMALL
from rivalry.operators import ann, boosting, kernel_svm, knn, ml, text_features, training_log
from rivalry.plans import fixtures as fx
from rivalry.plans.q_retrieval import retrieval_augmentation


def vectors(spark, x, y, first_id=0):
    rows = [(first_id + i, None if v is None else [None if e is None else float(e) for e in v], None if t is None else float(t))
            for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "vec_id long, features array<double>, label double")


def blobs(n, seed):
    """Three classes by the sign of a product and a threshold: not linear."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    y = np.where(x[:, 0] * x[:, 1] > 0, 0, np.where(x[:, 2] > 0.3, 1, 2))
    return x, y


def log_loss(rows, p="p"):
    return -np.mean([math.log(max(r[f"{p}{int(r['label'])}"], 1e-15)) for r in rows])


@pytest.fixture(scope="module")
def boosted(spark):
    (x, y), (vx, vy) = blobs(1500, 0), blobs(500, 1)
    train, watch = vectors(spark, x, y).cache(), vectors(spark, vx, vy, 10_000).cache()
    params = boosting.Params(max_rounds=25, patience=4, learning_rate=0.4)
    return train, watch, boosting.fit(train, watch, "vec_id", params=params), params


def test_boosting_is_one_model_for_all_classes(spark, boosted):
    train, watch, model, _ = boosted
    rows = boosting.predict(model, watch).collect()
    assert len(rows) == 500 and all(abs(r["p0"] + r["p1"] + r["p2"] - 1) < 1e-9 for r in rows)
    assert np.mean([r["label"] == r["prediction"] for r in rows]) > 0.9
    assert all(r["prediction"] == max(range(3), key=lambda c: (r[f"p{c}"], -c)) for r in rows)
    # the log's best loss is the loss of the predictions
    best = min(w for _, _, w in model.log)
    assert abs(best - log_loss(rows)) < 1e-9
    assert all(a >= b for (_, a, _), (_, b, _) in zip(model.log, model.log[1:]))  # full steps never raise the training loss here


def test_boosting_stops_where_the_early_stopping_operator_does(spark, boosted):
    _, _, model, params = boosted
    log = spark.createDataFrame([(0, r, w) for r, _, w in model.log if r > 0], "fold int, step int, loss double")
    stop = training_log.early_stop(log, "loss", "step", ["fold"], patience=params.patience).first()
    assert stop["best_round"] == model.best_round
    assert stop["stop_round"] == model.log[-1][0] or model.log[-1][0] == params.max_rounds


def test_boosting_is_no_worse_than_one_model_per_class(spark, boosted):
    train, watch, model, params = boosted
    d = ml.vector_frame(train.withColumnRenamed("features", "x"), "x").select("vec_id", "features", "label")
    v = ml.vector_frame(watch.withColumnRenamed("features", "x"), "x").select("vec_id", "features", "label")
    for c in range(3):
        gbt = GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.4, seed=1, labelCol="_y")
        fitted = gbt.fit(d.withColumn("_y", (F.col("label") == c).cast("double")))
        v = fitted.transform(v).withColumn(f"_m{c}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    total = F.col("_m0") + F.col("_m1") + F.col("_m2")
    others = v.select("label", *[(F.col(f"_m{c}") / total).alias(f"p{c}") for c in range(3)]).collect()
    assert log_loss(boosting.predict(model, watch).collect()) <= log_loss(others)


def test_boosting_equals_a_plain_first_tree(spark):
    """One feature, one split: the leaf values of a hand-made Newton step."""
    x = [[i / 100] for i in range(100)]
    y = [0 if i < 37 else 1 for i in range(100)]
    d = vectors(spark, x, y)
    p = boosting.Params(max_rounds=1, max_depth=1, learning_rate=1.0, reg_lambda=2.0, reg_alpha=0.0, feature_fraction=1.0, max_bin=128, min_rows=1)
    model = boosting.fit(d, d, "vec_id", params=p)
    assert model.edges[0][model.cut[0][0][0]] == 0.36
    p0 = 0.37
    left, right = -(37 * (p0 - 1)) / (37 * p0 * (1 - p0) + 2), -(63 * p0) / (63 * p0 * (1 - p0) + 2)
    assert np.allclose(model.leaf[0][0], [left, right])


def test_boosting_store_nulls_and_extra_trees(spark, boosted, tmp_path):
    _, watch, model, _ = boosted
    boosting.save(model, spark, str(tmp_path / "m"))
    again = boosting.load(spark, str(tmp_path / "m"))
    odd = vectors(spark, [None, [None] * 6, [float("nan"), 0, 0, 0, 0, 0]], [0, 1, 2], 90_000).unionByName(watch)
    a = {r["vec_id"]: tuple(r) for r in boosting.predict(model, odd).drop("features").collect()}
    assert a == {r["vec_id"]: tuple(r) for r in boosting.predict(again, odd).drop("features").collect()}
    assert a[90_000][2:] == a[90_001][2:] and again.log == model.log
    x, y = blobs(600, 3)
    labelled = vectors(spark, list(x) + [None, x[0]], list(y) + [1, None])
    random_cuts = boosting.fit(labelled, labelled, "vec_id", params=boosting.Params(max_rounds=6, extra_trees=True, refresh=2))
    rows = boosting.predict(random_cuts, labelled.where("label IS NOT NULL")).collect()
    assert log_loss(rows) < 0.9
    with pytest.raises(ValueError):
        boosting.fit(labelled.where("label = 1"), labelled, "vec_id")


def test_kernel_machine_on_a_ring(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 2))
    y = ((x ** 2).sum(axis=1) > 1.4).astype(int)
    d = vectors(spark, x, y)
    train, valid = d.where("vec_id < 900"), d.where("vec_id >= 900")
    model = kernel_svm.fit(train, "vec_id", c=25.0, n_features=200)
    rows = kernel_svm.predict(model, valid).collect()
    linear = ml.linear_head(ml.vector_frame(train, "features"), ml.vector_frame(valid, "features"))
    lin = np.mean([r["label"] == r["prediction"] for r in linear.select("label", "prediction").collect()])
    acc = np.mean([r["label"] == r["prediction"] for r in rows])
    assert acc > 0.94 > lin + 0.1
    assert all(abs(r["p0"] + r["p1"] - 1) < 1e-9 for r in rows)
    base = np.mean([r["label"] for r in rows])
    assert log_loss(rows) < 0.5 * -(base * math.log(base) + (1 - base) * math.log(1 - base))
    assert np.isclose(model.gamma, 1 / (2 * x[:900].var()), rtol=0.02)
    wide = kernel_svm.fit(train, "vec_id", c=0.001, gamma=1e-4, n_features=200)  # a nearly linear kernel
    assert np.mean([r["label"] == r["prediction"] for r in kernel_svm.predict(wide, valid).collect()]) < acc - 0.1
    odd = kernel_svm.predict(model, vectors(spark, [None, [1.0, None], [0.0, 0.0]], [0, 0, 0])).collect()
    assert [r["prediction"] for r in sorted(odd, key=lambda r: r["vec_id"])] == [None, None, 0.0]


def test_out_of_fold_scores(spark):
    x, y = blobs(300, 7)

    def scores(labels):
        d = ml.vector_frame(vectors(spark, x, labels), "features")
        out = ml.out_of_fold(d, "vec_id", 4, ml.fit_linear, lambda m, rows: m.transform(rows).select("vec_id", vector_to_array("probability").alias("p")))
        return {r["vec_id"]: tuple(r["p"]) for r in out.collect()}

    before, changed = scores(y), list(y)
    changed[17] = (changed[17] + 1) % 3
    after = scores(changed)
    assert set(before) == set(range(300))
    assert np.allclose(before[17], after[17], atol=1e-12)  # its own label is never seen
    assert sum(not np.allclose(before[i], after[i], atol=1e-9) for i in before) > 100  # but by the other folds


def test_every_battle_gets_a_stacked_score(spark):
    import __spark_entry__ as E
    rows = E.queries()["predictions_as_features"](spark, SF_SMALL).collect()
    assert len(rows) == fx.battles_big(spark, SF_SMALL).count()
    assert all(abs(r["A_log"] + r["B_log"] + r["tie_log"] - 1) < 1e-6 for r in rows)


# ---------------------------------------------------------------- vector index

def test_index_is_stored_once_and_reused(spark, tmp_path):
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(60, 16)) * 3
    base = middle[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.4
    base /= np.linalg.norm(base, axis=1)[:, None]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)] + [(9000, None), (9001, [None] * 16)], "id long, embedding array<double>")
    ask = base[:400] + rng.normal(size=(400, 16)) * 0.02
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ask)] + [(500, None)], "q_id long, embedding array<double>")
    path = str(tmp_path / "index")
    built = ann.build_index(c, path, members=100)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*") if p.is_file()}
    for index in (built, ann.open_index(spark, path)):
        rows = ann.search(q, index, k=3).collect()
        exact = (ask @ base.T)
        assert len(rows) == 1200
        first = {r["q_id"]: r for r in rows if r["rank"] == 1}
        assert np.mean([first[i]["id"] == exact[i].argmax() for i in range(400)]) >= 0.9
        assert all(abs(r["similarity"] - exact[r["q_id"], r["id"]]) < 1e-9 for r in rows)
        assert 3 <= max(r["n_candidates"] for r in rows) < 3000  # half of the stored vectors at most
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*") if p.is_file()}
    more = ann.search(q, built, k=1, probes=len(built.members), rerank=200).collect()
    assert np.mean([r["id"] == exact[r["q_id"]].argmax() for r in more]) > 0.99


def test_index_recall_without_clusters(spark, tmp_path):
    q, c = fx.retrieval_queries(spark, SF_MED), fx.retrieval_corpus(spark, SF_MED)
    approx = ann.search(q, ann.build_index(c, str(tmp_path / "i")))
    assert knn.recall_at_1(approx, knn.knn_join(q, c, k=1)) >= 0.9


# ---------------------------------------------------------------- text features

TEXTS = [(1, "The cat, the dog."), (2, "a cat"), (3, None), (4, "Dog dog DOG cat"), (5, "?!"), (6, "zebra cat")]


def plain_tfidf(texts, min_df, max_df):
    import collections
    import regex
    split = [collections.Counter(regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", (t or "").lower())) for _, t in texts]
    df = collections.Counter(w for c in split for w in c)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items() if min_df <= n <= max_df * len(texts)}
    out = {}
    for (i, _), c in zip(texts, split):
        v = {w: n * idf[w] for w, n in c.items() if w in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        out[i] = {w: x / size for w, x in v.items()}
    return out


@pytest.mark.parametrize("min_df,max_df", [(1, 1.0), (2, 0.5)])
def test_tfidf_equals_a_plain_version(spark, min_df, max_df):
    d = spark.createDataFrame(TEXTS, "doc_id long, text string")
    model = text_features.fit_tfidf(d, min_df=min_df, max_df=max_df)
    got = {r["doc_id"]: {model.tokens[i]: w for i, w in zip(r["at"], r["weight"])} for r in
           text_features.sparse_entries(model.transform(d), "doc_id").collect()}
    want = plain_tfidf(TEXTS, min_df, max_df)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i].keys() == want[i].keys() and all(abs(got[i][w] - want[i][w]) < 1e-12 for w in want[i])
    top = text_features.fit_tfidf(d, max_features=2)
    assert top.tokens == ["cat", "dog"]
    with pytest.raises(ValueError):
        text_features.fit_tfidf(d.limit(0))


def test_stacked_sparse_and_dense_columns_feed_the_trees(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        good, size = rng.random() < 0.5, rng.random()
        rows.append((i, " ".join(["nice" if good else "dull"] + rng.choices(["one", "two", "three"], k=4)), size, float(2 * good + (size > 0.5))))
    d = spark.createDataFrame(rows, "id long, text string, size double, label double")
    x = text_features.stack_features(text_features.fit_tfidf(d).transform(d), ["tfidf", "size"])
    model = boosting.fit(x.where("id < 300"), x.where("id >= 300"), "id", params=boosting.Params(max_rounds=10, feature_fraction=1.0))
    out = boosting.predict(model, x.where("id >= 300")).collect()
    assert np.mean([r["label"] == r["prediction"] for r in out]) > 0.97


def test_learned_embeddings_find_paraphrases(spark):
    """Pairs that share topic words but half of their other words."""
    rng = random.Random(2)
    topics = [[f"t{k}x{j}" for j in range(12)] for k in range(40)]
    common = [f"c{j}" for j in range(30)]
    rows = []
    for k, words in enumerate(topics):
        for side in (0, 1):
            rows.append((2 * k + side, " ".join(rng.sample(words, 8) + rng.choices(common, k=10))))
        rows += [(1000 + 20 * k + j, " ".join(rng.sample(words, 7) + rng.choices(common, k=10))) for j in range(3)]
    d = spark.createDataFrame(rows, "id long, text string")
    model = text_features.fit_embedder(d, dim=40, max_df=0.9)
    got = {r["id"]: np.array(r["embedding"]) for r in ml.batch_embed(d, embedder=model).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values())
    ids = [2 * k + 1 for k in range(40)]
    wall = np.stack([got[i] for i in ids])
    assert np.mean([ids[int((wall @ got[2 * k]).argmax())] == 2 * k + 1 for k in range(40)]) >= 0.9
    blank = spark.createDataFrame([(1, None), (2, "unseen")], "id long, text string")
    assert all(not any(r["embedding"]) for r in model.transform(blank).collect())


def test_embedder_holds_one_slice_of_rows():
    """A batch of 600,000 tokens: memory stays far below tokens x directions (400 MB), the sums are the whole batch's."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(2000)]
    model = text_features.Tfidf(words, rng.uniform(1, 3, len(words)))
    basis = rng.normal(size=(len(words), 80))
    sizes = [*[300] * 1900, 0, 0, 30000]
    at = [rng.integers(0, len(words) + 50, n) for n in sizes]  # the last 50 are unknown tokens
    rows = pa.array([[words[i] if i < len(words) else f"x{i}" for i in a] for a in at], pa.list_(pa.string())).slice(1)
    sums = np.zeros((len(words), 80))
    tracemalloc.start()
    got = text_features.Embedder(model, basis).vectors(rows)
    text_features._add_products(sums, model, rows, basis)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    x = np.stack([np.bincount(a[a < len(words)], minlength=len(words)) for a in at[1:]]) * model.idf
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    assert np.allclose(sums, x.T @ (x @ basis))
    y = x @ basis
    assert np.allclose(np.stack(got.to_pylist()), y / np.maximum(np.linalg.norm(y, axis=1), 1e-12)[:, None])
    assert len(text_features.Embedder(model, basis).vectors(rows.slice(0, 0))) == 0


def test_embedder_sums_come_from_a_few_tasks(spark, monkeypatch):
    """Each task writes its whole sums: rows in 100 partitions are summed by two tasks a core at most, to the same vectors."""
    d = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c{i % 3}") for i in range(200)], "id long, text string")
    parts, real = [], type(d).mapInArrow
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, *a, **b: parts.append(self.rdd.getNumPartitions()) or real(self, *a, **b))
    few = text_features.fit_embedder(d, dim=8)
    monkeypatch.setattr(text_features, "cut_lineage", lambda df, name: df.repartition(100))
    many = text_features.fit_embedder(d, dim=8)
    assert len(parts) == 6 and max(parts) <= 2 * spark.sparkContext.defaultParallelism < 100
    assert few.tfidf.tokens == many.tfidf.tokens and np.allclose(abs(few.basis), abs(many.basis))


def test_retrieval_embeds_prompts_and_corpus_in_one_space(spark):
    """Prompts that share topic words with a few corpus prompts get an answer of their topic; a corpus prompt gets its own."""
    rng = random.Random(6)
    topics = [[f"t{k}x{j}" for j in range(12)] for k in range(30)]
    common = [f"c{j}" for j in range(30)]
    ask = lambda k: " ".join(rng.sample(topics[k], 8) + rng.choices(common, k=6))
    asked = [[ask(k) for _ in range(4)] for k in range(30)]
    talk = [(4 * k + j, t, role, text) for k in range(30) for j in range(4)
            for t, role, text in ((0, "user", asked[k][j]), (1, "assistant", f"answer {k} {j}."))]
    fights = [(k, [ask(k), asked[k][1], " ".join(rng.choices(common, k=5) + ["novel", f"only{k % 3}"])], ["a"] * 3, ["b"] * 3) for k in range(30)]
    battles = spark.createDataFrame(fights, "id long, p array<string>, a array<string>, b array<string>")
    conversations = spark.createDataFrame(talk, "conv_id long, turn int, role string, text string")
    out = {r["id"]: r for r in retrieval_augmentation(battles, conversations, threshold=-2.0, dim=30).collect()}
    assert len(out) == 30 and all(r["n_missing"] == 0 and r["n_added"] == 3 for r in out.values())
    found = {k: re.findall(r"<response>answer (\d+) (\d+)\.</response>", r["text"]) for k, r in out.items()}
    assert all(found[k][1] == (str(k), "1") for k in found)
    assert np.mean([found[k][0][0] == str(k) for k in found]) >= 0.9


def test_trained_scorer(spark):
    rng = random.Random(3)
    words = [["alpha", "beta"], ["gamma", "delta"], ["omega", "sigma"]]
    rows = [(i, " ".join(rng.choices(words[i % 3] + ["the", "and", "of"], k=9)), i % 3) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, text string, label int")
    out = ml.out_of_fold(d, "id", 2, text_features.train_scorer, lambda m, part: ml.batch_score(part, m)).collect()
    assert len(out) == 300 and all(abs(r["A"] + r["B"] + r["tie"] - 1) < 1e-6 for r in out)
    assert np.mean([max(range(3), key=lambda c: (r["A"], r["B"], r["tie"])[c]) == r["label"] for r in out]) > 0.9


# ---------------------------------------------------------------- exact neighbours

def test_query_cell_pairs_leave_in_pieces():
    """2,000 queries that reach all 300 cells: 600,000 pairs, no frame larger than PAIR_BYTES."""
    rng = np.random.default_rng(4)
    n, cells, dim = 2000, 300, 64
    asked = pd.DataFrame({"_q": np.arange(n), "_qv": list(rng.normal(size=(n, dim))), "_lb": np.full(n, np.nan)})
    centre = rng.normal(size=(cells, dim))
    args = np.arange(cells) * 2, centre / np.linalg.norm(centre, axis=1)[:, None], np.full(cells, math.pi), np.ones(cells), np.ones(cells)
    pairs = []
    for frame in knn._cells_of(iter([asked, asked[:0]]), *args, None):
        assert len(frame) * dim * 8 <= knn.PAIR_BYTES
        pairs.append(frame[["_q", "_cell"]])
    pairs = pd.concat(pairs)
    assert len(pairs.drop_duplicates()) == len(pairs) == n * cells
    assert sum(len(f) for f in knn._cells_of(iter([asked]), *args, 2)) == 2 * n


# ---------------------------------------------------------------- projection

def test_projection_keeps_neighbours_on_a_curve(spark):
    """A long curve that winds through eight dimensions: neighbours along it stay neighbours in three."""
    t = np.linspace(0, 1, 700)
    x = np.stack([f(2 * np.pi * k * t) for k in (4, 6, 9, 11) for f in (np.sin, np.cos)], axis=1)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [None] * 8)], "vec_id long, embedding array<double>")

    def kept(df):
        pc = {r["vec_id"]: r["pc"] for r in df.collect()}
        y = np.array([pc[i] for i in range(700)])
        assert y.shape == (700, 3)
        share = []
        for i in range(700):
            near = np.argsort(np.abs(np.arange(700) - i), kind="stable")[1:9]
            found = np.argsort(((y - y[i]) ** 2).sum(axis=1), kind="stable")[1:9]
            share.append(len(set(near) & set(found)) / 8)
        return np.mean(share), pc

    curved, pc = kept(ml.project_3d(d))
    linear, _ = kept(ml.project_linear(d.where("vec_id < 9000")))
    assert curved > 0.95 and curved > linear + 0.2
    assert pc[9000] is None and pc[9001] is None
    few = ml.project_3d(d.where("vec_id < 2")).collect()
    assert all(len(r["pc"]) == 3 for r in few)
