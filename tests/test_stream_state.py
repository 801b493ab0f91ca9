"""Ingestion state over repeated deliveries, retry lists, versions of the pair counts."""

import json

import pytest
from pyspark.sql import functions as F

from rivalry.operators import priors
from rivalry.streaming import ingest


def line(i, content="<prompt>p</prompt><response_a>a</response_a><response_b>b</response_b>"):
    return json.dumps({"custom_id": f"request-{i}", "response": {"body": {"choices": [{"message": {"content": content}}],
                                                                         "usage": {"prompt_tokens": 5, "completion_tokens": 6}}}})


def test_repeated_deliveries_broken_lines_and_retries(spark, tmp_path):
    src, good, bad, ck = (str(tmp_path / n) for n in ("in", "good", "bad", "ck"))
    (tmp_path / "in").mkdir()
    half = "<prompt>p</prompt><response_a>a</response_a>"

    def deliver(name, *lines):
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
        ingest.ingest_results(spark, src, good, bad, ck, max_files_per_trigger=1)

    deliver("one.json", line(1), line(2), line(3, half), '{"custom_id": "request-4", "resp', "", "not json at all")
    deliver("two.json", line(1), line(2), line(3, half), "not json at all")   # the same file once more
    deliver("three.json", line(3), line(1, half))                              # a good answer after a rejected one
    g = spark.read.parquet(good).select("custom_id", "prompts", "prompt_tokens").collect()
    assert sorted(r["custom_id"] for r in g) == ["request-1", "request-2", "request-3"] and all(list(r["prompts"]) == ["p"] for r in g)
    b = spark.read.parquet(bad).collect()
    assert sorted((r["custom_id"] or "", r["raw_line"] or "") for r in b) == sorted(
        [("request-3", ""), ("request-1", ""), ("", '{"custom_id": "request-4", "resp'), ("", "not json at all")])
    asked = spark.createDataFrame([(f"request-{i}", 100 * i) for i in range(1, 8)] + [("request-5", 900)], "custom_id string, requested_at long")
    asked = asked.unionByName(spark.createDataFrame([("request-8", 50)], asked.schema))
    deliver("four.json", line(8, half), line(8, half), line(8, half + " "))
    late = ingest.unanswered(asked, spark.read.parquet(good), spark.read.parquet(bad), 600)
    assert sorted(tuple(r) for r in late.collect()) == [("request-4", 400, 0), ("request-5", 500, 0), ("request-8", 50, 2)]


def test_an_answer_without_tags_is_rejected_only_if_turns_differ(spark):
    from rivalry.operators import requests as R
    rows = spark.createDataFrame([("r1", "no tags"), ("r2", None), (None, "x")], "custom_id string, content string")
    got = {r["custom_id"]: r["status"] for r in R.with_parity_status(R.extract_turns(rows)).collect()}
    assert got == {"r1": "good", "r2": "quarantine", None: "quarantine"}


def test_pair_counts_keep_the_old_version_when_a_batch_dies(spark, tmp_path, monkeypatch):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "id long, model_a string, model_b string, label int"

    def more(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def read():
        return {(r["m0"], r["m1"]): (r["w0"], r["w1"], r["wt"]) for r in ingest.read_pair_counts(spark, out).collect()}

    with pytest.raises(ValueError):
        ingest.read_pair_counts(spark, out)
    more([(1, "x", "y", 0), (2, "y", "x", 0), (3, "x", "z", 2)])
    ingest.stream_pair_counts(spark, src, schema, out, ck)
    first = read()
    assert first == {("x", "y"): (2, 2, 1), ("x", "z"): (1, 1, 2)}
    more([(4, "x", "y", 0), (5, "v", "w", 1)])

    def dies(*a):
        raise RuntimeError("lost in the middle of a batch")

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", dies)  # the version is written, its number is not committed
        with pytest.raises(Exception):
            ingest.stream_pair_counts(spark, src, schema, out, ck)
    assert read() == first
    ingest.stream_pair_counts(spark, src, schema, out, ck)
    all_rows = spark.read.schema(schema).parquet(src)
    want = {(r["m0"], r["m1"]): (r["w0"], r["w1"], r["wt"]) for r in priors.pair_win_counts(all_rows).collect()}
    assert read() == want and want[("x", "y")] == (3, 2, 1)
    assert spark.read.parquet(f"{out}/commits").agg(F.max("version")).first()[0] == ingest.committed_version(spark, out)
