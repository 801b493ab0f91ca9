"""Readers and writers.

Every writer is a Spark job writing to a folder (committed by Spark's output
protocol); every reader declares its schema, so no inference pass runs.
Dense ``.npz`` shards are written and read by tasks through ``pyarrow.fs``,
so the same code works on a shared POSIX mount, HDFS or an object store.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATTLE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("model_a", T.StringType()),
    T.StructField("model_b", T.StringType()), T.StructField("prompt", T.StringType()),
    T.StructField("response_a", T.StringType()), T.StructField("response_b", T.StringType()),
    T.StructField("winner_model_a", T.IntegerType()), T.StructField("winner_model_b", T.IntegerType()),
    T.StructField("winner_tie", T.IntegerType()),
])

NESTED_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("conversations", T.ArrayType(T.StructType([
        T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]))),
])


def _csv_writer(df: DataFrame, escape: str):
    """Bytes that are not valid UTF-8 are written as the replacement character."""
    text = [c for c, t in df.dtypes if t == "string"]
    return (df.withColumns({c: F.make_valid_utf8(F.col(c)) for c in text}).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", escape)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_csv(df: DataFrame, path: str, escape: str = '"') -> None:
    """S1/S2 sink: header, quoted multi-line text, ``""`` (or backslash) escapes."""
    _csv_writer(df, escape).csv(path)


def read_csv(spark: SparkSession, path: str, schema, escape: str = '"') -> DataFrame:
    """S1 scan: the same dialect, multi-line records, declared schema."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"')
            .option("escape", escape).option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).csv(path))


# ---------------------------------------------------------------- dense vectors

def _fs(path: str):
    """(filesystem, path) for a plain path, ``file:/x`` / ``file:///x`` or another URI scheme."""
    from pyarrow import fs
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    elif "://" not in path:
        path = "file://" + path
    return fs.FileSystem.from_uri(path)


def write_vectors(df: DataFrame, path: str, id_col: str, vec_col: str, extra: str | None = None,
                  rows_per_shard: int = 1_000_000) -> DataFrame:
    """Each task writes its rows as ``.npz`` shards (``ids``, ``vectors`` and an
    optional ``extra`` column) of up to ``rows_per_shard`` rows, buffering Arrow
    batches so a task emits a few large files, not one per batch.  The
    manifest of committed shards is written as Parquet by Spark and returned;
    shards of failed task attempts are not in it, so readers never see them."""
    cols = [id_col, vec_col] + ([extra] if extra else [])

    def flush(buf: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(buf, ignore_index=True)
        name = f"{path}/shard-{uuid.uuid4().hex}.npz"
        out = io.BytesIO()
        arrays = {"ids": pdf[id_col].to_numpy(np.int64),
                  "vectors": np.stack([np.asarray(v, dtype=np.float32) for v in pdf[vec_col].to_numpy()])}
        if extra:
            arrays["extra"] = pdf[extra].to_numpy()
        np.savez_compressed(out, **arrays)
        fsys, p = _fs(name)
        fsys.create_dir(p.rsplit("/", 1)[0], recursive=True)
        with fsys.open_output_stream(p) as f:
            f.write(out.getvalue())
        return pd.DataFrame({"file": [name], "rows": [len(pdf)]})

    def write_part(it):
        buf, n = [], 0
        for pdf in it:
            if pdf.empty:
                continue
            buf.append(pdf)
            n += len(pdf)
            if n >= rows_per_shard:
                yield flush(buf)
                buf, n = [], 0
        if buf:
            yield flush(buf)

    manifest = df.select(*cols).mapInPandas(write_part, "file string, rows long")
    mpath = f"{path}/_manifest"
    manifest.write.mode("overwrite").parquet(mpath)
    return df.sparkSession.read.parquet(mpath)


def read_vectors(spark: SparkSession, path: str, id_col: str = "id", vec_col: str = "embedding",
                 extra: str | None = None, extra_type: str = "int") -> DataFrame:
    """S3: one task per shard reads it (no driver pass) → (id, vector[, extra])."""
    manifest = spark.read.parquet(f"{path}/_manifest")
    n = max(1, manifest.count())
    schema = f"{id_col} long, {vec_col} array<float>" + (f", {extra} {extra_type}" if extra else "")

    def read_part(it):
        for pdf in it:
            for name in pdf["file"]:
                fsys, p = _fs(name)
                with fsys.open_input_file(p) as f:
                    z = np.load(io.BytesIO(f.read()))
                ids, vecs = z["ids"], z["vectors"]
                ext = z["extra"] if extra else None
                for s in range(0, len(ids), 100_000):  # bounded Arrow batches per shard
                    out = {id_col: ids[s:s + 100_000], vec_col: list(vecs[s:s + 100_000])}
                    if extra:
                        out[extra] = ext[s:s + 100_000]
                    yield pd.DataFrame(out)

    return manifest.repartition(n, "file").mapInPandas(read_part, schema)


# ---------------------------------------------------------------- nested corpus / priors

def nested_corpus(conv: DataFrame) -> DataFrame:
    """S5 producer: (conv_id, turn, role, text) → conv_id, conversations[{from, value}]."""
    t = conv.filter(F.col("role").isin("user", "assistant"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return t.groupBy("conv_id").agg(F.transform(turns, lambda s: F.struct(
        F.when(s["role"] == "user", "human").otherwise("gpt").alias("from"), s["text"].alias("value")))
        .alias("conversations"))


def read_nested_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with nested turns, declared schema."""
    return spark.read.schema(NESTED_SCHEMA).json(path)


def write_pair_priors(priors: DataFrame, path: str) -> None:
    """One JSON object per pair ``{"m0 m1": [w0, w1, wt]}`` per line (a map,
    split across lines so no single task holds every pair)."""
    doc = F.to_json(F.create_map(F.concat_ws(" ", "m0", "m1"), F.array("w0", "w1", "wt")))
    priors.select(doc.alias("value")).write.mode("overwrite").text(path)


def read_pair_priors(spark: SparkSession, path: str) -> DataFrame:
    m = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("k", "w"))
    return m.select(F.split("k", " ")[0].alias("m0"), F.split("k", " ")[1].alias("m1"),
                    F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"), F.col("w")[2].alias("wt"))


# ---------------------------------------------------------------- run artefacts

def append_run_metadata(spark: SparkSession, path: str, run: str, params: dict[str, str], score_df: DataFrame,
                        score_col: str) -> DataFrame:
    """Append ``(run, params, score)``; the score comes from a one-row metric DataFrame."""
    pm = F.create_map(*[x for k, v in sorted(params.items()) for x in (F.lit(k), F.lit(str(v)))])
    row = score_df.select(F.lit(run).alias("run"), pm.alias("params"), F.col(score_col).alias("score"))
    row.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append-only metrics table, partitioned by fold."""
    df.write.mode("append").partitionBy("fold").parquet(path)
