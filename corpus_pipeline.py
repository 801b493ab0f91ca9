"""Corpus preparation: language ID, near-dedup, repeat removal, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.  All stages but the last
return the columns of ``documents``; the last one returns packed pieces.

1. ``language_id`` writes the predicted language into ``lang`` and drops documents
   without one (null text, no letters).  When no labelled document is there to
   learn a model from, ``lang`` stays as it is and only the latter are dropped.
2. ``near_dedup`` keeps one row of each near-duplicate component (five-word
   shingles, similarity of 0.8 or more): the one with the smallest doc_id, null
   last.  Rows are linked by their texts alone, so repeated rows, rows that
   share a doc_id and rows without one are treated like any others.
3. ``repeat_removal`` cuts every byte covered by a 200-byte string that starts
   anywhere else; a document with nothing but blanks left goes.
4. ``redact_pii`` replaces personal data by tags.
5. ``pack`` gives the packed pieces of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.llm import langid, pii
from rivalry.llm.common import cut_lineage, ship_package, table
from rivalry.llm.neardup import near_duplicates
from rivalry.llm.packing import pack_documents
from rivalry.llm.suffixes import remove_repeats

SHINGLE_WORDS, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(langid.LETTER))
    # all columns travel in one struct, so that none clashes with those of the prediction
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col("text").cast("string").alias("text"))
    known = langid.predict(rows, model).where(F.col("lang_pred") != langid.UND)
    lang = F.col("lang_pred").cast(dict(docs.dtypes)["lang"]).alias("lang")
    return known.select(*[lang if c == "lang" else F.col(f"_all.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    # rows get a key of their own; written, so that it stays the same for all readers
    rows = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    verdict = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), width=SHINGLE_WORDS, percent=PERCENT)
    part = verdict.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_part"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row")
    part = cut_lineage(rows.select("_row", order.alias("_order")).join(part, "_row"), "near-parts")
    kept = part.groupBy("_part").agg(F.min("_order").alias("_order")).select("_order._row")
    dropped = part.select("_row").join(kept, "_row", "left_anti")
    return rows.join(dropped, "_row", "left_anti").select(*docs.columns)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    left = remove_repeats(docs, with_text=True)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    clean = pii.redact(docs, pii.train(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("repeat_removal", repeat_removal),
          ("redact_pii", redact_pii), ("pack", pack)]
ORACLE_SQL = None  # tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate results go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
