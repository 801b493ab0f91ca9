"""Registered queries: labels, folds, priors, unions, joins, dedup and the
corpus-preparation plan (E1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.functions import templates as T
from rivalry.functions.lists import parse_list_join, parse_list_strict
from rivalry.operators import combine, folds, labels, priors
from rivalry.plans import fixtures as fx
from rivalry.plans.oracle_fixtures import with_fixtures as W
from rivalry.plans.oracle_fixtures import zip_render
from rivalry.plans.registry import register
from rivalry.plans.sqlgen import kfold_sql, shuffle_key_sql
from rivalry.session import table

# ---------------------------------------------------------------- priors (A1 …)

_A1_SQL = W("""SELECT least(model_a, model_b) AS m0, greatest(model_a, model_b) AS m1,
  CAST(1 + count(*) FILTER (WHERE (label = 0 AND model_a < model_b) OR (label = 1 AND model_b < model_a)) AS BIGINT) AS w0,
  CAST(1 + count(*) FILTER (WHERE (label = 0 AND model_a > model_b) OR (label = 1 AND model_b > model_a)) AS BIGINT) AS w1,
  CAST(1 + count(*) FILTER (WHERE label = 2) AS BIGINT) AS wt
FROM bb WHERE model_a <> model_b GROUP BY 1, 2""", "bb")


@register("pair_win_counts", _A1_SQL)
def q_pair_win_counts(spark, sf):
    return priors.pair_win_counts(fx.battles_big(spark, sf))


@register("min_support", W("""SELECT least(model_a, model_b) AS m0, greatest(model_a, model_b) AS m1,
  count(*) AS n_battles FROM bb WHERE model_a <> model_b GROUP BY 1, 2 HAVING count(*) > 0""", "bb"))
def q_min_support(spark, sf):
    c = priors.pair_battle_counts(fx.battles_big(spark, sf))
    return c.filter(F.col("n") > 0).select("m0", "m1", F.col("n").alias("n_battles"))


@register("battle_pair_theta", W("""SELECT least(model_a, model_b) AS m0, greatest(model_a, model_b) AS m1,
  count(*) FILTER (WHERE model_a < model_b) AS n_ab, count(*) FILTER (WHERE model_a > model_b) AS n_ba,
  count(*) AS n FROM bb WHERE model_a <> model_b GROUP BY 1, 2""", "bb"))
def q_battle_pair_theta(spark, sf):
    return priors.pair_battle_counts(fx.battles_big(spark, sf))


@register("distinct_models", W("SELECT model_a AS model FROM bb UNION SELECT model_b FROM bb", "bb"))
def q_distinct_models(spark, sf):
    return priors.distinct_models(fx.battles_big(spark, sf))


@register("model_pair_combinations", W("""WITH m AS (SELECT model_a AS model FROM bb UNION SELECT model_b FROM bb)
SELECT x.model AS m0, y.model AS m1 FROM m x JOIN m y ON x.model < y.model""", "bb"))
def q_model_pair_combinations(spark, sf):
    return priors.model_pair_combinations(fx.battles_big(spark, sf))


def _softmax_cols(prefix="z"):
    from rivalry.functions.probs import softmax
    return softmax(f"{prefix}0", f"{prefix}1", f"{prefix}2")


_PRIOR_SQL = W("""WITH pr AS (
  SELECT least(model_a, model_b) AS m0, greatest(model_a, model_b) AS m1,
  1 + count(*) FILTER (WHERE (label = 0 AND model_a < model_b) OR (label = 1 AND model_b < model_a)) AS w0,
  1 + count(*) FILTER (WHERE (label = 0 AND model_a > model_b) OR (label = 1 AND model_b > model_a)) AS w1,
  1 + count(*) FILTER (WHERE label = 2) AS wt
  FROM bb WHERE model_a <> model_b GROUP BY 1, 2),
sm AS (SELECT id, label, model_a, model_b, greatest(z0, z1, z2) AS m, z0, z1, z2 FROM bb),
p AS (SELECT id, label, model_a, model_b,
  exp(z0 - m) / (exp(z0 - m) + exp(z1 - m) + exp(z2 - m)) AS A,
  exp(z1 - m) / (exp(z0 - m) + exp(z1 - m) + exp(z2 - m)) AS B,
  exp(z2 - m) / (exp(z0 - m) + exp(z1 - m) + exp(z2 - m)) AS tie FROM sm),
j AS (SELECT p.*,
  CAST(coalesce(CASE WHEN model_a > model_b THEN pr.w1 ELSE pr.w0 END, 1) AS DOUBLE) AS wa,
  CAST(coalesce(CASE WHEN model_a > model_b THEN pr.w0 ELSE pr.w1 END, 1) AS DOUBLE) AS wb,
  CAST(coalesce(pr.wt, 1) AS DOUBLE) AS wtie
  FROM p LEFT JOIN pr ON least(model_a, model_b) = pr.m0 AND greatest(model_a, model_b) = pr.m1)
SELECT id, wa, wb, wtie,
  round(wa * A * (A + B + tie) / (wa * A + wb * B + wtie * tie), 6) AS A_adj,
  round(wb * B * (A + B + tie) / (wa * A + wb * B + wtie * tie), 6) AS B_adj,
  round(wtie * tie * (A + B + tie) / (wa * A + wb * B + wtie * tie), 6) AS tie_adj
FROM j""", "bb")


@register("pair_prior_join", _PRIOR_SQL)
def q_pair_prior_join(spark, sf):
    bb = fx.battles_big(spark, sf)
    pa, pb_, pt = _softmax_cols()
    pred = bb.select("id", "label", "model_a", "model_b", pa.alias("A"), pb_.alias("B"), pt.alias("tie"))
    j = priors.prior_adjust(priors.pair_prior_join(pred, priors.pair_win_counts(bb)))
    return j.select("id", "wa", "wb", "wtie", *[F.round(f"{c}_adj", 6).alias(f"{c}_adj") for c in ("A", "B", "tie")])


@register("prior_adjust", _PRIOR_SQL.replace(
    "SELECT id, wa, wb, wtie,", "SELECT id,"))
def q_prior_adjust(spark, sf):
    return q_pair_prior_join(spark, sf).drop("wa", "wb", "wtie")


# ---------------------------------------------------------------- labels (P*)

@register("label_from_flags", W("""SELECT id, CAST(list_position([winner_model_a, winner_model_b, winner_tie],
  list_max([winner_model_a, winner_model_b, winner_tie])) - 1 AS INTEGER) AS label FROM bt""", "bt"))
def q_label_from_flags(spark, sf):
    return labels.label_from_flags(fx.battles_text(spark, sf)).select("id", "label")


@register("label_from_cases", W("""SELECT id, CAST(CASE WHEN winner_model_a = 1 THEN 0 WHEN winner_model_b = 1 THEN 1
  ELSE 2 END AS INTEGER) AS label FROM bb""", "bb"))
def q_label_from_cases(spark, sf):
    return labels.label_from_cases(fx.battles_big(spark, sf)).select("id", "label")


@register("label_text_map", W("""SELECT id, CASE label WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'tie' END AS label_short,
  CASE label WHEN 0 THEN 'A is better' WHEN 1 THEN 'B is better' WHEN 2 THEN 'Both are equal' END AS label_sentence
  FROM bb""", "bb"))
def q_label_text_map(spark, sf):
    bb = fx.battles_big(spark, sf)
    return bb.select("id", T.label_text("label").alias("label_short"),
                     T.label_text("label", T.LABEL_SENTENCE).alias("label_sentence"))


@register("fold_default", W("SELECT id, CAST(-1 AS INTEGER) AS fold FROM bb", "bb"))
def q_fold_default(spark, sf):
    return labels.fold_default(fx.battles_big(spark, sf)).select("id", "fold")


@register("cast_id", W("SELECT CAST(id AS VARCHAR) AS id, model_a FROM bb", "bb"))
def q_cast_id(spark, sf):
    return labels.cast_id(fx.battles_big(spark, sf)).select("id", "model_a")


@register("project_common_columns", W("SELECT id, prompt, response_a, response_b FROM bt", "bt"))
def q_project_common_columns(spark, sf):
    bt = fx.battles_text(spark, sf)
    syn = fx.battles_synth(spark, sf)
    return labels.project_common_columns(bt, syn)


@register("drop_columns", W("SELECT id, model_a, model_b, label, len FROM bb", "bb"))
def q_drop_columns(spark, sf):
    drop = ["winner_model_a", "winner_model_b", "winner_tie", "z0", "z1", "z2", "g0", "g1", "g2"]
    return labels.drop_columns(fx.battles_big(spark, sf), drop)


@register("rename_target", W("SELECT id, label AS labels FROM bb", "bb"))
def q_rename_target(spark, sf):
    bb = fx.battles_big(spark, sf).select("id", F.col("label").alias("target"))
    return labels.rename_target(bb)


def _join_text_sql(x: str) -> str:
    return f"array_to_string(list_transform(from_json({x}, '[\"VARCHAR\"]'), lambda e: coalesce(e, '')), ' ')"


_COIN = "instr('13579bdf', substr(md5('42:' || CAST(id AS VARCHAR)), 1, 1)) > 0"


@register("swap_augment", W(f"""SELECT id, {_COIN} AS swapped,
  '<prompt>: ' || {_join_text_sql('prompt')} || '\n\n<response_a>: ' ||
    CASE WHEN {_COIN} THEN {_join_text_sql('response_b')} ELSE {_join_text_sql('response_a')} END ||
  '\n\n<response_b>: ' ||
    CASE WHEN {_COIN} THEN {_join_text_sql('response_a')} ELSE {_join_text_sql('response_b')} END AS text,
  CAST(CASE WHEN {_COIN} AND label < 2 THEN 1 - label ELSE label END AS INTEGER) AS label
FROM (SELECT *, CASE WHEN winner_model_a = 1 THEN 0 WHEN winner_model_b = 1 THEN 1 ELSE 2 END AS label FROM bt)""",
                              "bt"))
def q_swap_augment(spark, sf):
    bt = labels.label_from_cases(fx.battles_text(spark, sf))
    j = bt.select("id", "label", parse_list_join("prompt").alias("prompt"),
                  parse_list_join("response_a").alias("response_a"),
                  parse_list_join("response_b").alias("response_b"))
    s = labels.swap_augment(j, seed=42)
    return s.select("id", "swapped", T.render_flat_tags("prompt", "response_a", "response_b").alias("text"), "label")


@register("swap_union", W(f"""SELECT id, false AS swapped, {_join_text_sql('response_a')} AS response_a,
  {_join_text_sql('response_b')} AS response_b, label FROM pb JOIN bt USING (id)
UNION ALL
SELECT id, true, {_join_text_sql('response_b')}, {_join_text_sql('response_a')},
  CAST(CASE WHEN label < 2 THEN 1 - label ELSE label END AS INTEGER) FROM pb JOIN bt USING (id)""", "pb", "bt"))
def q_swap_union(spark, sf):
    bt = labels.label_from_flags(fx.battles_text(spark, sf))
    j = bt.select("id", parse_list_join("response_a").alias("response_a"),
                  parse_list_join("response_b").alias("response_b"), "label")
    return labels.swap_union(j)


def _textual_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split(trim({x}, '[]'), '\",\"'), lambda e: trim(e, '\"')), ' ')"


@register("chosen_rejected", W(f"""SELECT id, p AS prompt,
  p || '\n\n' || CASE WHEN label = 0 THEN ra ELSE rb END AS chosen,
  p || '\n\n' || CASE WHEN label = 0 THEN rb ELSE ra END AS rejected
FROM (SELECT id, {_textual_sql('prompt')} AS p, {_textual_sql('response_a')} AS ra, {_textual_sql('response_b')} AS rb,
  CASE WHEN winner_model_a = 1 THEN 0 WHEN winner_model_b = 1 THEN 1 ELSE 2 END AS label FROM bt)
WHERE label <> 2""", "bt"))
def q_chosen_rejected(spark, sf):
    from rivalry.functions.lists import parse_list_textual
    bt = labels.label_from_cases(fx.battles_text(spark, sf))
    t = bt.select("id", "label", parse_list_textual("prompt").alias("prompt"),
                  parse_list_textual("response_a").alias("response_a"),
                  parse_list_textual("response_b").alias("response_b"))
    return labels.chosen_rejected(t).select("id", "prompt", "chosen", "rejected")


@register("drop_ties", W("SELECT id, label FROM bb WHERE label <> 2", "bb"))
def q_drop_ties(spark, sf):
    return labels.drop_ties(fx.battles_big(spark, sf)).select("id", "label")


_FOLD_EXPR = "CASE WHEN id % 17 = 0 THEN NULL ELSE CAST(id % 4 AS INTEGER) END"


@register("fold_split", W(f"""SELECT id, fold, CASE WHEN fold IS NOT DISTINCT FROM 0 THEN 'valid' ELSE 'train' END AS split
FROM (SELECT id, {_FOLD_EXPR} AS fold FROM bb)""", "bb"))
def q_fold_split(spark, sf):
    bb = fx.battles_big(spark, sf).select(
        "id", F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.col("id") % 4).cast("int").alias("fold"))
    train, valid = folds.fold_split(bb, 0)
    return train.withColumn("split", F.lit("train")).unionByName(valid.withColumn("split", F.lit("valid")))


@register("class_distribution", W("""SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS ratio
FROM bb GROUP BY label""", "bb"))
def q_class_distribution(spark, sf):
    return labels.class_distribution(fx.battles_big(spark, sf))


@register("class_weights", W("""SELECT label, (1 / ratio) / sum(1 / ratio) OVER () AS weight FROM (
  SELECT label, count(*) / sum(count(*)) OVER () AS ratio FROM bb GROUP BY label)""", "bb"))
def q_class_weights(spark, sf):
    return labels.class_weights(fx.battles_big(spark, sf))


@register("n_classes", W("SELECT count(DISTINCT label) AS n_classes FROM bb", "bb"))
def q_n_classes(spark, sf):
    return fx.battles_big(spark, sf).agg(F.count_distinct("label").alias("n_classes"))


# ---------------------------------------------------------------- folds

@register("stratified_kfold", W("SELECT id, label, fold FROM " + kfold_sql("bb", 4, shuffle_key_sql()), "bb"))
def q_stratified_kfold(spark, sf):
    bb = fx.battles_big(spark, sf).select("id", "label")
    return folds.stratified_kfold(bb, 4, shuffle=True, seed=42)


@register("stratified_kfold_unshuffled", W("SELECT id, label, fold FROM " + kfold_sql("bb", 5, "s.id"), "bb"))
def q_stratified_kfold_unshuffled(spark, sf):
    bb = fx.battles_big(spark, sf).select("id", "label")
    return folds.stratified_kfold(bb, 5, shuffle=False)


@register("pair_stratified_kfold", W("""SELECT id, model_a, model_b, CAST(
  (row_number() OVER (PARTITION BY model_a, model_b ORDER BY md5('42:' || CAST(id AS VARCHAR))) - 1
   + ('0x' || substr(md5(model_a || model_b), 1, 8))::BIGINT % 10) % 10 AS INTEGER) AS fold FROM bb""", "bb"))
def q_pair_stratified_kfold(spark, sf):
    bb = fx.battles_big(spark, sf).select("id", "model_a", "model_b")
    return folds.pair_stratified_kfold(bb, 10)


@register("dense_index", W("""WITH d AS (SELECT model_a AS value, CAST(row_number() OVER (ORDER BY min(id), model_a) - 1 AS INTEGER) AS idx
  FROM bb GROUP BY model_a)
SELECT bb.id, da.idx AS model_a_idx, db.idx AS model_b_idx FROM bb
JOIN d da ON bb.model_a = da.value JOIN d db ON bb.model_b = db.value""", "bb"))
def q_dense_index(spark, sf):
    bb = fx.battles_big(spark, sf).select("id", "model_a", "model_b")
    return folds.dense_index(bb).select("id", "model_a_idx", "model_b_idx")


# ---------------------------------------------------------------- unions / joins / dedup

@register("union_missing_columns", W("""SELECT CAST(id AS VARCHAR) AS id, label, CAST(fold AS INTEGER) AS fold, model_a FROM (
  SELECT id, label, CAST(id % 4 AS INTEGER) AS fold, model_a FROM pb
  UNION ALL BY NAME SELECT id, label FROM bs)""", "pb", "bs"))
def q_union_missing_columns(spark, sf):
    pb = labels.label_from_flags(fx.battles_text(spark, sf)).select(
        F.col("id").cast("string").alias("id"), "label", (F.col("id") % 4).cast("int").alias("fold"), "model_a")
    syn = fx.battles_synth(spark, sf).select("id", "label")
    return combine.union_missing_columns(pb, syn)


@register("union_common_columns", W("""SELECT CAST(id AS VARCHAR) AS id, prompt, label FROM pb JOIN bt USING (id)
UNION ALL SELECT id, prompt, label FROM bs""", "pb", "bt", "bs"))
def q_union_common_columns(spark, sf):
    bt = labels.label_from_flags(fx.battles_text(spark, sf)).withColumn("id", F.col("id").cast("string"))
    syn = fx.battles_synth(spark, sf)
    out = combine.union_common_columns(bt, syn)
    return out.select("id", "prompt", "label")


_TEXT_SQL = zip_render("p", "a", "b",
                       "'Instruction:\n' || p_i || '\n\nResponse A:\n' || a_i || '\n\nResponse B:\n' || b_i || '\n\n'")


@register("dedup_keep_first", W(f"""SELECT id, src FROM (
  SELECT id, src, row_number() OVER (PARTITION BY text ORDER BY src, id) AS rn FROM (
    SELECT id, 0 AS src, {_TEXT_SQL} AS text FROM pb
    UNION ALL
    SELECT bx.id, 1 AS src, {_TEXT_SQL} AS text FROM (SELECT id, {'''
      CASE WHEN list_count(from_json(prompt, '["VARCHAR"]')) < len(from_json(prompt, '["VARCHAR"]')) THEN []::VARCHAR[] ELSE from_json(prompt, '["VARCHAR"]') END AS p,
      CASE WHEN list_count(from_json(response_a, '["VARCHAR"]')) < len(from_json(response_a, '["VARCHAR"]')) THEN []::VARCHAR[] ELSE from_json(response_a, '["VARCHAR"]') END AS a,
      CASE WHEN list_count(from_json(response_b, '["VARCHAR"]')) < len(from_json(response_b, '["VARCHAR"]')) THEN []::VARCHAR[] ELSE from_json(response_b, '["VARCHAR"]') END AS b'''}
      FROM bx) bx)) WHERE rn = 1""", "pb", "bx"))
def q_dedup_keep_first(spark, sf):
    def rendered(df, src):
        return df.select("id", F.lit(src).alias("src"), T.render_instruction_blocks(
            parse_list_strict("prompt"), parse_list_strict("response_a"), parse_list_strict("response_b")).alias("text"))
    u = rendered(fx.battles_text(spark, sf), 0).unionByName(rendered(fx.battles_extra(spark, sf), 1))
    return combine.dedup_keep_first(u, "text", ["src", "id"]).select("id", "src")


@register("semi_join_models", W("""SELECT id, model_a, model_b FROM bx
WHERE model_a IN (SELECT model_a FROM bt) AND model_b IN (SELECT model_b FROM bt)""", "bx", "bt"))
def q_semi_join_models(spark, sf):
    return combine.semi_join_models(fx.battles_extra(spark, sf), fx.battles_text(spark, sf)).select(
        "id", "model_a", "model_b")


@register("lookup_join_lastwins", """SELECT c.c_custkey, d.o_totalprice AS last_total FROM customer c LEFT JOIN (
  SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey) d
  ON c.c_custkey = d.o_custkey""")
def q_lookup_join_lastwins(spark, sf):
    cust = table(spark, sf, "customer").select("c_custkey")
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    return combine.left_join_lookup(cust, orders, "c_custkey", "o_custkey", "o_totalprice", "o_orderkey",
                                    out="last_total")


_PRED_SQL = """SELECT CAST(id AS VARCHAR) AS id, round(z0, 6) AS A_log, round(z1, 6) AS B_log, round(z2, 6) AS tie_log
  FROM bb WHERE id % 3 = 0"""


@register("left_join_predictions", W(f"""SELECT CAST(bt.id AS VARCHAR) AS id, bt.model_a, p.A_log, p.B_log, p.tie_log
FROM bt LEFT JOIN ({_PRED_SQL}) p ON CAST(bt.id AS VARCHAR) = p.id""", "bt", "bb"))
def q_left_join_predictions(spark, sf):
    bb = fx.battles_big(spark, sf).filter(F.col("id") % 3 == 0)
    preds = bb.select("id", F.round("z0", 6).alias("A_log"), F.round("z1", 6).alias("B_log"),
                      F.round("z2", 6).alias("tie_log"))
    bt = fx.battles_text(spark, sf).select("id", "model_a")
    return combine.left_join_predictions(bt, preds)


