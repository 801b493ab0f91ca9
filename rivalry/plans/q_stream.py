"""Registered queries: Structured Streaming ingestion and incremental pair counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.operators import requests as R
from rivalry.plans import fixtures as fx
from rivalry.plans.oracle_fixtures import with_fixtures as W
from rivalry.plans.registry import register
from rivalry.session import scratch_path
from rivalry.streaming.ingest import ingest_results, read_pair_counts, stream_pair_counts


def _tags(tag):
    return (f"list_transform(regexp_extract_all(content, '(?s)<{tag}>(.*?)</{tag}>', 1), "
            f"lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))")


@register("stream_ingest_results", W(f"""SELECT custom_id, len(p) AS n_turns, content FROM (
  SELECT custom_id, content, {_tags('prompt')} AS p, {_tags('response_a')} AS ra, {_tags('response_b')} AS rb FROM res)
WHERE len(p) = len(ra) AND len(ra) = len(rb)""", "res"))
def q_stream_ingest_results(spark, sf):
    src, good, bad, ck = (scratch_path(spark, n) for n in ("results-in", "results-good", "results-bad", "ckpt-st1"))
    lines = R.result_lines(fx.results_table(spark, sf), blank_every=13)
    lines.write.mode("overwrite").text(src)
    ingest_results(spark, src, good, bad, ck, max_files_per_trigger=2)
    g = spark.read.parquet(good)
    return g.select("custom_id", F.size("prompts").cast("bigint").alias("n_turns"), "content")


@register("stream_pair_counts", W("""SELECT least(model_a, model_b) AS m0, greatest(model_a, model_b) AS m1,
  CAST(1 + count(*) FILTER (WHERE (label = 0 AND model_a < model_b) OR (label = 1 AND model_b < model_a)) AS BIGINT) AS w0,
  CAST(1 + count(*) FILTER (WHERE (label = 0 AND model_a > model_b) OR (label = 1 AND model_b > model_a)) AS BIGINT) AS w1,
  CAST(1 + count(*) FILTER (WHERE label = 2) AS BIGINT) AS wt
FROM bb WHERE model_a <> model_b GROUP BY 1, 2""", "bb"))
def q_stream_pair_counts(spark, sf):
    src, out, ck = (scratch_path(spark, n) for n in ("battles-in", "pair-counts", "ckpt-st2"))
    bb = fx.battles_big(spark, sf).select("id", "model_a", "model_b", "label")
    bb.write.mode("overwrite").parquet(src)
    stream_pair_counts(spark, src, bb.schema, out, ck)
    return read_pair_counts(spark, out)
