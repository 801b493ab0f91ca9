"""Registered queries: list dialects, templates, chat format, tokens, turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.functions import templates as T
from rivalry.functions import text as X
from rivalry.functions.lists import parse_list_join, parse_list_textual, strip_ws, word_count
from rivalry.operators import turns
from rivalry.operators.ordered import ordered_index
from rivalry.plans import fixtures as fx
from rivalry.plans.oracle_fixtures import with_fixtures as W
from rivalry.plans.oracle_fixtures import zip_render
from rivalry.plans.registry import register
from rivalry.plans.sqlgen import (fill_sql, join_mode_sql, lit, strip_sql, textual_mode_sql, tokens_sql,
                                  words_sql)
from rivalry.session import table


@register("parse_list_strict", W("SELECT id, p, a, b FROM pb", "pb"))
def q_parse_list_strict(spark, sf):
    return fx.parsed_battles(spark, sf).select("id", "p", "a", "b")


@register("parse_list_join", W(f"""SELECT id, {join_mode_sql('prompt')} AS prompt, {join_mode_sql('response_a')} AS response_a,
  {join_mode_sql('response_b')} AS response_b FROM bt""", "bt"))
def q_parse_list_join(spark, sf):
    bt = fx.battles_text(spark, sf)
    return bt.select("id", *[parse_list_join(c).alias(c) for c in ("prompt", "response_a", "response_b")])


@register("parse_list_textual", W(f"""SELECT id, {textual_mode_sql('prompt')} AS prompt,
  {textual_mode_sql('response_a')} AS response_a, {textual_mode_sql('response_b')} AS response_b FROM bt""", "bt"))
def q_parse_list_textual(spark, sf):
    bt = fx.battles_text(spark, sf)
    return bt.select("id", *[parse_list_textual(c).alias(c) for c in ("prompt", "response_a", "response_b")])


_T4 = zip_render("p", "a", "b", "'Instruction:\n' || p_i || '\n\nResponse A:\n' || a_i || '\n\nResponse B:\n' || b_i || '\n\n'")


@register("render_turns", W(f"SELECT id, {_T4} AS text FROM pb", "pb"))
def q_render_turns(spark, sf):
    pb = fx.parsed_battles(spark, sf)
    return pb.select("id", T.render_instruction_blocks("p", "a", "b").alias("text"))


@register("render_first_turn", W("""SELECT id, CASE WHEN least(len(p), len(a), len(b)) > 0
  THEN '<prompt>:' || p[1] || ' <response_a>:' || a[1] || ' <response_b>:' || b[1] || ' ' ELSE '' END AS text FROM pb""",
                                 "pb"))
def q_render_first_turn(spark, sf):
    pb = fx.parsed_battles(spark, sf)
    return pb.select("id", T.render_first_turn("p", "a", "b").alias("text"))


_T6 = (lit(T.HASH_HEADER) + " || " + zip_render(
    "p", "a", "b", "'\n###Instruction:: ' || p_i || ' \n###Response A: ' || a_i || ' \n###Response B: ' || b_i")
    + " || '[RESULT]:'")


@register("render_hash_blocks", W(f"SELECT id, {_T6} AS text FROM pb", "pb"))
def q_render_hash_blocks(spark, sf):
    pb = fx.parsed_battles(spark, sf)
    return pb.select("id", T.render_hash_blocks("p", "a", "b", result_suffix=True).alias("text"))


@register("render_flat_tags", W(f"""SELECT id, '<prompt>: ' || {join_mode_sql('prompt')} || '\n\n<response_a>: ' ||
  {join_mode_sql('response_a')} || '\n\n<response_b>: ' || {join_mode_sql('response_b')} AS text FROM bt""", "bt"))
def q_render_flat_tags(spark, sf):
    bt = fx.battles_text(spark, sf)
    return bt.select("id", T.render_flat_tags(parse_list_join("prompt"), parse_list_join("response_a"),
                                              parse_list_join("response_b")).alias("text"))


_T8 = (f"'User prompt: ' || {textual_mode_sql('prompt')} || '\n\nModel A :\n' || {textual_mode_sql('response_a')}"
       f" || '\n\n--------\n\nModel B:\n' || {textual_mode_sql('response_b')}")


def _t8(bt):
    return T.render_user_prompt(parse_list_textual("prompt"), parse_list_textual("response_a"),
                                parse_list_textual("response_b"))


@register("render_user_prompt", W(f"SELECT id, {_T8} AS text FROM bt", "bt"))
def q_render_user_prompt(spark, sf):
    bt = fx.battles_text(spark, sf)
    return bt.select("id", _t8(bt).alias("text"))


@register("word_count", W(f"SELECT id, {words_sql(_T8)} AS text_len FROM bt", "bt"))
def q_word_count(spark, sf):
    bt = fx.battles_text(spark, sf)
    return bt.select("id", word_count(_t8(bt)).cast("bigint").alias("text_len"))


@register("length_stats", W(f"""SELECT avg(n) AS mean_len, min(n) AS min_len, max(n) AS max_len,
  quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99
FROM (SELECT {words_sql(_T8)} AS n FROM bt)""", "bt"))
def q_length_stats(spark, sf):
    bt = fx.battles_text(spark, sf)
    n = bt.select(word_count(_t8(bt)).cast("bigint").alias("n"))
    return turns.length_stats(n, "n")


def _chat_sql(template: str, gen: bool) -> str:
    t = T.CHAT_TEMPLATES[template]
    role = "CASE role " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in t["roles"].items()) + " ELSE role END"
    body = (f"string_agg({lit(t['prefix'])} || {role} || {lit(t['sep'])} || {strip_sql('text')} || "
            f"{lit(t['suffix'])}, '' ORDER BY turn)")
    return f"{lit(t['bos'])} || {body}" + (f" || {lit(t['generation'])}" if gen else "")


@register("chat_template", f"SELECT conv_id, {_chat_sql('llama3', True)} AS text FROM conversations GROUP BY conv_id")
def q_chat_template(spark, sf):
    msgs = turns.conversation_messages(table(spark, sf, "conversations"))
    return msgs.select("conv_id", T.chat_template("messages", "llama3", add_generation_prompt=True).alias("text"))


@register("conversation_collect", """SELECT conv_id, count(*) AS n_turns,
  string_agg(role || ': ' || text, '\n' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def q_conversation_collect(spark, sf):
    return turns.conversation_collect(table(spark, sf, "conversations"))


@register("flatten_prompts", W("SELECT id, CAST(i AS INTEGER) AS pos, p[i + 1] AS prompt FROM pb, range(len(p)) r(i)", "pb"))
def q_flatten_prompts(spark, sf):
    pb = fx.parsed_battles(spark, sf)
    return pb.select("id", F.posexplode("p").alias("pos", "prompt"))


@register("qa_pairs", """WITH t AS (SELECT conv_id, role, text,
  row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
SELECT u.conv_id, u.k, u.text AS prompt, a.text AS response FROM t u JOIN t a
  ON u.conv_id = a.conv_id AND u.k = a.k AND u.role = 'user' AND a.role = 'assistant'""")
def q_qa_pairs(spark, sf):
    return turns.qa_pairs(table(spark, sf, "conversations"))


@register("role_filter", """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' ELSE 'gpt' END AS "from", text AS value
FROM conversations WHERE role IN ('user', 'assistant')""")
def q_role_filter(spark, sf):
    return turns.role_filter(table(spark, sf, "conversations"))


_JUDGE_FILLED = fill_sql(T.template_parts(T.JUDGE_TEMPLATE), original_prompt='prompt', response_a='response_a',
                         response_b='response_b',
                         better_response="CASE WHEN winner_model_a = 1 THEN 'A' WHEN winner_model_b = 1 THEN 'B' ELSE 'tie' END")


@register("judge_prompt", W(f"""SELECT id, '<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n' ||
  {strip_sql(_JUDGE_FILLED)} || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n' AS prompt
FROM bt""", "bt"))
def q_judge_prompt(spark, sf):
    from rivalry.operators.labels import label_from_cases
    bt = label_from_cases(fx.battles_text(spark, sf))
    filled = T.fill_template(T.JUDGE_TEMPLATE, original_prompt="prompt", response_a="response_a",
                             response_b="response_b", better_response=T.label_text("label"))
    return bt.select("id", T.chat_template(T.user_message(filled), "llama3", add_generation_prompt=True)
                     .alias("prompt"))


# ---------------------------------------------------------------- tokens

@register("token_count", f"SELECT doc_id, len({tokens_sql('text')}) AS n_tokens FROM documents")
def q_token_count(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.token_count("text").cast("bigint").alias("n_tokens"))


@register("max_len_filter", f"""SELECT doc_id, n_tokens FROM (SELECT doc_id, len({tokens_sql('text')}) AS n_tokens
  FROM documents) WHERE n_tokens < 512""")
def q_max_len_filter(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.token_count("text").cast("bigint").alias("n_tokens")).filter(F.col("n_tokens") < 512)


@register("total_tokens", f"SELECT CAST(sum(len({tokens_sql('text')})) AS BIGINT) AS total_tokens FROM documents")
def q_total_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.sum(X.token_count("text")).cast("bigint").alias("total_tokens"))


@register("truncate_tokens", f"""SELECT doc_id, array_to_string({tokens_sql('text')}[1:64], ' ') AS text FROM documents""")
def q_truncate_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.truncate_tokens("text", 64).alias("text"))


@register("spread_truncate", W(f"""SELECT id, len(ids) AS n_ids, len(list_transform(ids, lambda x: 1)) AS n_mask FROM (
  SELECT id, list_concat(list_concat({tokens_sql(join_mode_sql('prompt'))}[1:341],
    {tokens_sql(join_mode_sql('response_a'))}[1:341]), {tokens_sql(join_mode_sql('response_b'))}[1:341]) AS ids FROM bt)""",
                               "bt"))
def q_spread_truncate(spark, sf):
    bt = fx.battles_text(spark, sf)
    ids = X.spread_truncate([X.tokens(parse_list_join(c)) for c in ("prompt", "response_a", "response_b")], 1024)
    t = bt.select("id", ids.alias("ids"))
    return t.select("id", F.size("ids").cast("bigint").alias("n_ids"),
                    F.size(F.array_repeat(F.lit(1), F.size("ids"))).cast("bigint").alias("n_mask"))


@register("pad_and_mask", f"""WITH t AS (SELECT doc_id, len({tokens_sql('text')}) AS n,
  (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch FROM documents)
SELECT doc_id, batch, CAST(ceil(max(n) OVER (PARTITION BY batch) / 8) * 8 AS BIGINT) AS padded_len,
  CAST(ceil(max(n) OVER (PARTITION BY batch) / 8) * 8 AS BIGINT) - n AS n_pad FROM t""")
def q_pad_and_mask(spark, sf):
    from rivalry.operators.training_log import pad_and_mask
    d = table(spark, sf, "documents").select("doc_id", X.tokens("text").alias("tok"))
    d = ordered_index(d, ["doc_id"], name="rn").withColumn("batch", F.floor((F.col("rn") - 1) / 8))
    p = pad_and_mask(d, "tok", "batch")
    return p.select("doc_id", "batch", F.size("padded").cast("bigint").alias("padded_len"),
                    (F.size("padded") - F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x))
                    .cast("bigint").alias("n_pad"))


@register("strip_special", """SELECT conv_id, turn, split_part(text, '.', 1) AS head FROM conversations""")
def q_strip_special(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.strip_special("text", ".").alias("head"))


@register("strip_whitespace", f"""SELECT conv_id, turn, {strip_sql("' ' || text || chr(10) || ' '")} AS text FROM conversations""")
def q_strip_whitespace(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", strip_ws(F.concat(F.lit(" "), "text", F.lit("\n "))).alias("text"))

