"""E1 — corpus preparation as one lazy plan (the flagship query).

battles → label → strict list parse → chat-formatted text → stratified folds
→ second corpus (label/parse/render, semi-join on known models) → union →
keep-first dedup on text → left join stacked predictions → union synthetic
rows (no fold).  Stages break only at the fold statistics, the dedup shuffle
and the joins; nothing is collected except the per-class counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.functions import templates as T
from rivalry.functions.lists import parse_list_strict
from rivalry.operators import combine, folds, labels
from rivalry.plans.oracle_fixtures import with_fixtures, zip_render
from rivalry.plans.registry import ORACLES, register
from rivalry.plans.sqlgen import kfold_sql, shuffle_key_sql, strip_sql
from rivalry.session import cut_lineage


def render_text(df: DataFrame) -> DataFrame:
    """Chat-formatted prompt text from the three list cells (strict dialect)."""
    body = T.render_instruction_blocks(parse_list_strict("prompt"), parse_list_strict("response_a"),
                                       parse_list_strict("response_b"))
    msg = T.user_message(F.concat(F.lit(T.CHATBOT_HEADER), body))
    return df.withColumn("text", T.chat_template(msg, "gemma"))


def prepare_corpus(battles: DataFrame, extra: DataFrame, synth: DataFrame, preds: DataFrame,
                   k: int = 5, seed: int = 42) -> DataFrame:
    cols = ["id", "model_a", "model_b", "label", "text"]
    # the rendered main corpus feeds the fold statistics, the ranking and the
    # semi-join: write it once to the shared folder instead of recomputing it
    main = cut_lineage(render_text(labels.label_from_flags(battles)).select(*cols), "corpus-main")
    # the extra corpus is filtered on its model names before its texts are rendered
    ext = combine.semi_join_models(extra, main)
    ext = cut_lineage(render_text(labels.label_from_flags(ext)).select(*cols), "corpus-extra")
    plain = [d.select(F.lit(src).alias("src"), "id", "text") for src, d in enumerate((main, ext))]
    main = folds.stratified_kfold(main, k, shuffle=True, seed=seed)
    u = combine.union_missing_columns(main.withColumn("src", F.lit(0)), ext.withColumn("src", F.lit(1)))
    u = combine.dedup_keep_first(u, "text", ["src", "id"], plain=plain[0].unionByName(plain[1]))
    u = combine.left_join_predictions(u, preds)
    syn = render_text(synth).select("id", "label", "text").withColumn("src", F.lit(2))
    out = combine.union_missing_columns(u, syn)
    return out.select("id", "src", "label", "fold", "text", "model_a", "model_b", "A_log", "B_log", "tie_log")


_TEXT = ("'<bos><start_of_turn>user\n' || " + strip_sql(
    "'" + T.CHATBOT_HEADER + "' || " + zip_render(
        "p", "a", "b", "'Instruction:\n' || p_i || '\n\nResponse A:\n' || a_i || '\n\nResponse B:\n' || b_i || '\n\n'"))
    + " || '<end_of_turn>\n'")

ORACLES["prepare_corpus"] = with_fixtures(f"""WITH main0 AS (SELECT id, model_a, model_b, label, {_TEXT} AS text FROM pb),
main AS (SELECT * FROM {kfold_sql('main0', 5, shuffle_key_sql('s.id'), cols='id, model_a, model_b, label, text')}),
ext AS (SELECT id, model_a, model_b, label, {_TEXT} AS text FROM px
  WHERE model_a IN (SELECT model_a FROM main) AND model_b IN (SELECT model_b FROM main)),
u AS (SELECT id, model_a, model_b, label, fold, text, 0 AS src FROM main
  UNION ALL SELECT id, model_a, model_b, label, NULL, text, 1 FROM ext),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY src, id) AS rn FROM u) WHERE rn = 1),
pr AS (SELECT CAST(id AS VARCHAR) AS id, round(z0, 6) AS A_log, round(z1, 6) AS B_log, round(z2, 6) AS tie_log
  FROM bb WHERE id % 3 = 0)
SELECT CAST(d.id AS VARCHAR) AS id, src, label, CAST(fold AS INTEGER) AS fold, text, model_a, model_b,
  pr.A_log, pr.B_log, pr.tie_log
FROM d LEFT JOIN pr ON CAST(d.id AS VARCHAR) = pr.id
UNION ALL
SELECT id, 2, label, NULL, {_TEXT}, NULL, NULL, NULL, NULL, NULL FROM ps""", "pb", "px", "ps", "bb")


def stacked_predictions(bb: DataFrame) -> DataFrame:
    """Side table of a stacked model's outputs per id (every third battle)."""
    return bb.filter(F.col("id") % 3 == 0).select(
        F.col("id").cast("string").alias("id"), F.round("z0", 6).alias("A_log"),
        F.round("z1", 6).alias("B_log"), F.round("z2", 6).alias("tie_log"))


@register("prepare_corpus")
def q_prepare_corpus(spark, sf):
    from rivalry.plans import fixtures as fx
    bt = cut_lineage(fx.battles_text(spark, sf), "battles")
    return prepare_corpus(bt, fx.battles_extra(spark, sf, bt), fx.battles_synth(spark, sf, bt),
                          stacked_predictions(fx.battles_big(spark, sf)))
