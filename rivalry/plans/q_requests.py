"""Registered queries: request/result JSONL round trip, validation, cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.functions import templates as T
from rivalry.functions.text import md5_seed, md5_uuid
from rivalry.operators import combine, folds, requests as R
from rivalry.plans import fixtures as fx
from rivalry.plans.oracle_fixtures import with_fixtures as W
from rivalry.plans.oracle_fixtures import zip_render
from rivalry.plans.registry import register
from rivalry.plans.sqlgen import fill_sql, kfold_sql, shuffle_key_sql
from rivalry.session import scratch_path, table

_T4 = zip_render("p", "a", "b", "'Instruction:\n' || p_i || '\n\nResponse A:\n' || a_i || '\n\nResponse B:\n' || b_i || '\n\n'")
_SEED = "CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT % 1001 AS INTEGER)"
_LABEL_SENT = "CASE label WHEN 0 THEN 'A is better' WHEN 1 THEN 'B is better' ELSE 'Both are equal' END"
_REQ_CTE = (f"t AS (SELECT id, label, {_T4} AS text FROM pb), "
            f"f AS (SELECT * FROM {kfold_sql('t', 4, shuffle_key_sql('s.id'), cols='id, label, text')} WHERE fold <> 0)")
_USER = fill_sql(T.template_parts(T.PARAPHRASE_TEMPLATE), conversation="text", label=_LABEL_SENT)


def _train_rows(spark, sf):
    """Prepared battles (instruction-block text) outside validation fold 0."""
    pb = fx.parsed_battles(spark, sf)
    t = pb.select("id", "label", T.render_instruction_blocks("p", "a", "b").alias("text"))
    train, _ = folds.fold_split(folds.stratified_kfold(t, 4, shuffle=True, seed=42), 0)
    return train


def _req_fields(req):
    b = F.col("request.body")
    return req.select(F.col("request.custom_id").alias("custom_id"), b["model"].alias("model"),
                      b["temperature"].alias("temperature"), b["seed"].alias("seed"),
                      b["max_tokens"].alias("max_tokens"), F.get(b["messages"], 1)["content"].alias("user_content"))


@register("paraphrase_request", W(f"""WITH {_REQ_CTE}
SELECT 'request-' || CAST(id AS VARCHAR) AS custom_id, 'gpt-4o-mini' AS model, CAST(1.1 AS DOUBLE) AS temperature,
  {_SEED} AS seed, 16384 AS max_tokens, {_USER} AS user_content FROM f""", "pb"))
def q_paraphrase_request(spark, sf):
    return _req_fields(R.paraphrase_request(_train_rows(spark, sf)))


@register("request_id_seed", W(f"""SELECT id, 'request-' || CAST(id AS VARCHAR) AS custom_id,
  substr(md5(CAST(id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(id AS VARCHAR)), 9, 4) || '-' ||
  substr(md5(CAST(id AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(id AS VARCHAR)), 17, 4) || '-' ||
  substr(md5(CAST(id AS VARCHAR)), 21, 12) AS uuid, {_SEED} AS seed FROM bb""", "bb"))
def q_request_id_seed(spark, sf):
    bb = fx.battles_big(spark, sf)
    return bb.select("id", R.custom_id().alias("custom_id"), md5_uuid("id").alias("uuid"), md5_seed("id").alias("seed"))


@register("sink_request_jsonl", W(f"""WITH {_REQ_CTE}
SELECT 'request-' || CAST(id AS VARCHAR) AS custom_id, 'gpt-4o-mini' AS model, {_SEED} AS seed,
  {_USER} AS user_content FROM f""", "pb"))
def q_sink_request_jsonl(spark, sf):
    path = scratch_path(spark, "requests")
    R.request_lines(R.paraphrase_request(_train_rows(spark, sf))).write.mode("overwrite").text(path)
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.custom_id").alias("custom_id"),
                        F.get_json_object("value", "$.body.model").alias("model"),
                        F.get_json_object("value", "$.body.seed").cast("int").alias("seed"),
                        F.get_json_object("value", "$.body.messages[1].content").alias("user_content"))


def _results_path(spark, sf) -> str:
    """Write the batch results as JSON lines (with blank lines) to the shared folder."""
    path = scratch_path(spark, "results")
    R.result_lines(fx.results_table(spark, sf), blank_every=13).write.mode("overwrite").text(path)
    return path


def read_results(spark, path: str):
    return R.parse_results(spark.read.schema(R.RESULT_SCHEMA).json(path))


@register("scan_result_jsonl", W("SELECT custom_id, content, prompt_tokens, completion_tokens FROM res", "res"))
def q_scan_result_jsonl(spark, sf):
    return read_results(spark, _results_path(spark, sf))


@register("blank_line_filter", W("SELECT custom_id FROM res", "res"))
def q_blank_line_filter(spark, sf):
    lines = spark.read.text(_results_path(spark, sf))
    return R.non_blank(lines).select(F.get_json_object("value", "$.custom_id").alias("custom_id"))


@register("json_field_extract", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  event_type FROM events""")
def q_json_field_extract(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")


def _tags_sql(tag: str) -> str:
    return (f"list_transform(regexp_extract_all(content, '(?s)<{tag}>(.*?)</{tag}>', 1), "
            f"lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))")


_TAGS = f"{_tags_sql('prompt')} AS prompts, {_tags_sql('response_a')} AS responses_a, {_tags_sql('response_b')} AS responses_b"


@register("extract_tag_blocks", W(f"SELECT custom_id, {_TAGS} FROM res", "res"))
def q_extract_tag_blocks(spark, sf):
    t = R.extract_turns(fx.results_table(spark, sf))
    return t.select("custom_id", "prompts", "responses_a", "responses_b")


@register("turn_parity_check", W(f"""SELECT custom_id, len(prompts) AS n_prompts, len(responses_a) AS n_a, len(responses_b) AS n_b,
  CASE WHEN len(prompts) = len(responses_a) AND len(responses_a) = len(responses_b) THEN 'good' ELSE 'quarantine' END AS status
FROM (SELECT custom_id, {_TAGS} FROM res)""", "res"))
def q_turn_parity_check(spark, sf):
    out = R.with_parity_status(R.extract_turns(fx.results_table(spark, sf)))
    return out.select("custom_id", F.size("prompts").cast("bigint").alias("n_prompts"),
                      F.size("responses_a").cast("bigint").alias("n_a"),
                      F.size("responses_b").cast("bigint").alias("n_b"), "status")


@register("result_row_join", W("SELECT res.custom_id, pb.id, pb.label FROM res JOIN pb ON pb.id = res.id", "res", "pb"))
def q_result_row_join(spark, sf):
    res = fx.results_table(spark, sf).select("custom_id")
    src = fx.parsed_battles(spark, sf).select("id", "label")
    return combine.result_row_join(res, src).select("custom_id", "id", "label")


_COST = ("prompt_tokens * CAST(0.075 AS DOUBLE) / CAST(1e6 AS DOUBLE) + "
         "completion_tokens * CAST(0.3 AS DOUBLE) / CAST(1e6 AS DOUBLE)")
_BATCH_CTE = (f"bt_ AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 150 AS batch FROM res), "
              f"pc AS (SELECT batch, sum({_COST}) AS cost FROM bt_ GROUP BY batch)")


def _per_batch(spark, sf):
    res = R.with_batches(fx.results_table(spark, sf), "id", 150)
    return R.batch_cost(res)


@register("batch_cost", W(f"WITH {_BATCH_CTE} SELECT batch, round(cost, 9) AS cost FROM pc", "res"))
def q_batch_cost(spark, sf):
    return _per_batch(spark, sf).select("batch", F.round("cost", 9).alias("cost"))


@register("running_cost", W(f"""WITH {_BATCH_CTE} SELECT batch, round(cost, 9) AS cost,
  round(sum(cost) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS total FROM pc""", "res"))
def q_running_cost(spark, sf):
    r = R.running_cost(_per_batch(spark, sf))
    return r.select("batch", F.round("cost", 9).alias("cost"), F.round("total", 9).alias("total"))


@register("microbatch_ids", W("SELECT id, (row_number() OVER (ORDER BY id) - 1) // 150 AS batch FROM bb", "bb"))
def q_microbatch_ids(spark, sf):
    return R.with_batches(fx.battles_big(spark, sf).select("id"), "id", 150)
