"""LLM batch request/result round trip.

Requests are built as nested structs and serialised with ``to_json``; results
are read with a declared nested schema (no inference pass), validated and
split into good / quarantined rows.  Nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from rivalry.functions import templates as T
from rivalry.functions.text import extract_tag_blocks, md5_seed
from rivalry.operators.ordered import ordered_index, running_aggregates

# Request envelope and batch prices (USD per token).
MODEL = "gpt-4o-mini"
URL = "/v1/chat/completions"
TEMPERATURE = 1.1
MAX_TOKENS = 16384
PROMPT_PRICE = 0.075 / 1e6
COMPLETION_PRICE = 0.3 / 1e6

RESULT_SCHEMA = T_.StructType([
    T_.StructField("custom_id", T_.StringType()),
    T_.StructField("response", T_.StructType([
        T_.StructField("body", T_.StructType([
            T_.StructField("choices", T_.ArrayType(T_.StructType([
                T_.StructField("message", T_.StructType([T_.StructField("content", T_.StringType())]))]))),
            T_.StructField("usage", T_.StructType([
                T_.StructField("prompt_tokens", T_.LongType()),
                T_.StructField("completion_tokens", T_.LongType())])),
        ]))])),
])

#: The same with the text of a line that is not such a document.
RAW_LINE = "raw_line"
RESULT_LINE_SCHEMA = T_.StructType([*RESULT_SCHEMA.fields, T_.StructField(RAW_LINE, T_.StringType())])


def custom_id(id_col: str = "id"):
    """``request-{id}``."""
    return F.concat(F.lit("request-"), F.col(id_col).cast("string"))


def paraphrase_request(df: DataFrame, text: str = "text", label: str = "label", id_col: str = "id") -> DataFrame:
    """One request struct per row (system + user message, repeatable seed)."""
    prompt = T.fill_template(T.PARAPHRASE_TEMPLATE, conversation=text,
                             label=T.label_text(label, T.LABEL_SENTENCE))
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(T.SYSTEM_MESSAGE).alias("content")),
                   F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    body = F.struct(F.lit(MODEL).alias("model"), msgs.alias("messages"), F.lit(TEMPERATURE).alias("temperature"),
                    md5_seed(id_col).alias("seed"), F.lit(MAX_TOKENS).alias("max_tokens"))
    return df.select(F.struct(custom_id(id_col).alias("custom_id"), F.lit("POST").alias("method"),
                              F.lit(URL).alias("url"), body.alias("body")).alias("request"))


def request_lines(requests: DataFrame) -> DataFrame:
    """One JSON document per row in a ``value`` column (write with ``.write.text``)."""
    return requests.select(F.to_json("request").alias("value"))


def result_lines(results: DataFrame, blank_every: int | None = None, id_col: str = "id") -> DataFrame:
    """Serialise result rows as batch-API JSON lines (optionally with blank lines)."""
    doc = F.struct(F.col("custom_id"), F.struct(F.struct(
        F.array(F.struct(F.struct(F.col("content").alias("content")).alias("message"))).alias("choices"),
        F.struct("prompt_tokens", "completion_tokens").alias("usage")).alias("body")).alias("response"))
    lines = results.select(F.to_json(doc).alias("value"), F.col(id_col))
    if blank_every:
        blanks = results.filter(F.col(id_col) % blank_every == 0).select(F.lit("").alias("value"), F.col(id_col))
        lines = lines.unionByName(blanks)
    return lines.select("value")


def non_blank(lines: DataFrame, col: str = "value") -> DataFrame:
    """drop empty / whitespace-only lines."""
    return lines.filter(F.trim(F.col(col)) != "")


def parse_results(raw: DataFrame) -> DataFrame:
    """Nested access into the parsed result documents; the raw text of
    broken lines comes along when ``raw`` was read with ``RESULT_LINE_SCHEMA``."""
    body = F.col("response.body")
    return raw.select("custom_id", F.get(body["choices"], 0)["message"]["content"].alias("content"),
                      body["usage"]["prompt_tokens"].alias("prompt_tokens"),
                      body["usage"]["completion_tokens"].alias("completion_tokens"), *[c for c in raw.columns if c == RAW_LINE])


def extract_turns(results: DataFrame, content: str = "content") -> DataFrame:
    """Tagged prompt / answer blocks of every result."""
    return results.withColumns({"prompts": extract_tag_blocks(content, "prompt"),
                                "responses_a": extract_tag_blocks(content, "response_a"),
                                "responses_b": extract_tag_blocks(content, "response_b")})


def parity_ok():
    return (F.size("prompts") == F.size("responses_a")) & (F.size("responses_a") == F.size("responses_b"))


def answered(df: DataFrame):
    """Whether a row is an answer at all: it has an id and content, and was a whole document."""
    known = F.col("custom_id").isNotNull() & F.col("content").isNotNull() if "custom_id" in df.columns else F.lit(True)
    return known & F.col(RAW_LINE).isNull() if RAW_LINE in df.columns else known


def with_parity_status(turns: DataFrame, out: str = "status") -> DataFrame:
    """F5 in one pass: ``good`` when prompts and answers pair up, else ``quarantine``
    (so are lines without an id or content, and broken ones)."""
    return turns.withColumn(out, F.when(parity_ok() & answered(turns), F.lit("good")).otherwise(F.lit("quarantine")))


def parity_split(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) — good rows have equally many prompts and answers.
    Both outputs read the same input: persist it first when writing both."""
    ok = parity_ok() & answered(turns)
    return turns.filter(ok), turns.filter(~ok)


def with_batches(df: DataFrame, order: str, size: int = 150, out: str = "batch") -> DataFrame:
    """L3: fixed-size batches in ``order`` (skew-safe global numbering)."""
    d = ordered_index(df, [order], name="_rn")
    return d.withColumn(out, F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")


def batch_cost(results: DataFrame, batch: str = "batch") -> DataFrame:
    """Price of each batch."""
    cost = F.col("prompt_tokens") * F.lit(0.075) / F.lit(1e6) + F.col("completion_tokens") * F.lit(0.3) / F.lit(1e6)
    return results.groupBy(batch).agg(F.sum(cost).alias("cost"))


def running_cost(per_batch: DataFrame, batch: str = "batch") -> DataFrame:
    """Cumulative price after each batch (on the per-batch aggregate)."""
    return running_aggregates(per_batch, [batch], [], {"total": ("cost", "sum")})
