"""Every registered query with a SQL twin equals DuckDB on sf0.001 (order-insensitive)."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL, duck
from tools.oracle_check import norm

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def _rows(cols, rows, order):
    idx = [cols.index(c) for c in order]
    return sorted((tuple(norm(r[i]) for i in idx) for r in rows), key=repr)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_duckdb(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    cols = df.columns
    srows = df.collect()
    cur = con.execute(ORACLES[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    order = sorted(cols)
    assert _rows(cols, srows, order) == _rows(dcols, drows, order)


def test_every_key_has_a_builder():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 130


# what SQL can state about the queries without a twin: a condition for every row, and the row count
ONE = "abs({} - 1) < 1e-5"
BIG, TEXT = "(SELECT count(*) FROM orders)", "(SELECT count(DISTINCT conv_id) FROM conversations)"
VALID = "(SELECT count(*) FROM embeddings WHERE vec_id % 5 = 0)"
STATED = {
    "batch_score": (ONE.format("A + B + tie"), TEXT),
    "batch_embed": ("dim = 64 AND (abs(norm_sq - 1) < 1e-5 OR norm_sq = 0)", "(SELECT count(*) FROM documents)"),
    "gbm_classify": (ONE.format("p0 + p1 + p2") + " AND prediction IN (0, 1, 2)", VALID),
    "svm_classify": (ONE.format("p0 + p1 + p2") + " AND prediction IN (0, 1, 2)", VALID),
    "linear_head": (ONE.format("aggregate(probability, 0D, (a, x) -> a + x)") + " AND prediction IN (0, 1, 2)", VALID),
    "project_3d": ("size(pc) = 3", "(SELECT count(*) FROM embeddings)"),
    "predictions_as_features": (ONE.format("A_log + B_log + tie_log"), BIG),
    "model_store": ("prediction IN (0, 1, 2)", VALID),
    "knn_approx_join": ("similarity <= 1.000001 AND n_candidates > 0", VALID),
    "retrieval_augmentation": ("n_missing = 0 AND text LIKE '<|begin_of_text|>%'", TEXT),
}


def test_every_other_key_states_something():
    optional = {k for k in QUERIES if k == "pipeline" or re.match(r"op\d+_", k)}  # tests/llm
    assert set(QUERIES) - set(ORACLES) - optional == set(STATED)


@pytest.mark.parametrize("key", sorted(STATED))
def test_queries_without_a_twin(spark, con, key):
    condition, count = STATED[key]
    df = QUERIES[key](spark, SF_SMALL)
    total, good = df.selectExpr("count(*)", f"count_if({condition})").first()
    assert total == good == con.execute(f"SELECT {count}").fetchone()[0]
