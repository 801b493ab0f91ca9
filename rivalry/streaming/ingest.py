"""Structured Streaming jobs (ST1, ST2).

ST1 replaces the reference's poll-and-append loop: result files landing in a
folder are a file source with a declared schema; each line is parsed and
validated (tag parity), and goes to the good or the quarantine table, broken
lines with their raw text.  A streaming state keyed by ``custom_id`` lets every
answer in once, whatever batch or restart delivers it again; requests without a
good answer are listed for a retry by ``unanswered``.  Progress and state live in
the checkpoint, so a restarted query resumes where it stopped.

ST2 keeps the pair win counts up to date as battle files arrive: a streaming
``groupBy`` in update mode whose state is one row per model pair (bounded by the
number of pairs, so no watermark is needed).  Each micro-batch writes a new
version of the result and then commits its number: a reader sees the last
committed version, also while a batch is being written or after one has failed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.operators import priors
from rivalry.operators import requests as R


def ingest_results(spark: SparkSession, source: str, good_path: str, bad_path: str, checkpoint: str,
                   max_files_per_trigger: int | None = None) -> None:
    """ST1: file source → parse → parity split → two append sinks; runs all
    available files and stops (``availableNow``).

    Good answers are kept once per custom_id, rejected lines once per content; a
    good answer that follows a rejected one is kept.  The state is one key per
    kept line."""
    reader = spark.readStream.schema(R.RESULT_LINE_SCHEMA).option("columnNameOfCorruptRecord", R.RAW_LINE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    parsed = R.with_parity_status(R.extract_turns(R.parse_results(reader.json(source))))
    content = F.md5(F.concat_ws("\u0000", F.coalesce("custom_id", F.lit("")), F.coalesce("content", F.lit("")), F.coalesce(R.RAW_LINE, F.lit(""))))
    once = parsed.withColumn("_key", F.when(F.col("status") == "good", F.col("custom_id")).otherwise(content)).dropDuplicates(["status", "_key"])

    def sink(batch: DataFrame, batch_id: int) -> None:
        # one folder per micro-batch, overwritten on replay → idempotent appends;
        # the batch feeds two sinks, so it is persisted for the two writes
        batch = batch.drop("_key").persist()
        try:
            batch.where("status = 'good'").drop("status", R.RAW_LINE).write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
            batch.where("status <> 'good'").drop("status").write.mode("overwrite").parquet(f"{bad_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    q = (once.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def unanswered(requests: DataFrame, good: DataFrame, bad: DataFrame, before, requested_at: str = "requested_at") -> DataFrame:
    """The retry list: custom_id, requested_at and n_rejected (rejected lines) of
    the requests made before ``before`` that have no good answer."""
    rejected = bad.where("custom_id IS NOT NULL").groupBy("custom_id").agg(F.count("*").alias("n_rejected"))
    late = requests.where(F.col(requested_at) < F.lit(before)).groupBy("custom_id").agg(F.min(requested_at).alias(requested_at))
    return (late.join(good.select("custom_id"), "custom_id", "left_anti").join(rejected, "custom_id", "left")
            .select("custom_id", requested_at, F.coalesce("n_rejected", F.lit(0)).alias("n_rejected")))


PAIR = ["m0", "m1"]


def committed_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The last committed version (smaller than ``below``), or None."""
    try:
        commits = spark.read.schema("version long").parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return commits.where(F.lit(True) if below is None else F.col("version") < below).agg(F.max("version")).first()[0]


def read_pair_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last committed version of the counts that ``stream_pair_counts`` keeps at ``path``."""
    version = committed_version(spark, path)
    if version is None:
        raise ValueError(f"no committed version at {path}")
    return spark.read.parquet(f"{path}/data/{version}")


def stream_pair_counts(spark: SparkSession, source: str, schema, out_path: str, checkpoint: str,
                       max_files_per_trigger: int | None = None) -> None:
    """ST2: incremental A1 over a folder of battle files.  A micro-batch brings
    the pairs that changed; the new version is the last one with those replaced."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    counts = priors.pair_win_counts(reader.parquet(source))

    def sink(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        last = committed_version(session, out_path, batch_id)
        batch = batch.persist()
        try:
            new = batch
            if last is not None:
                new = session.read.parquet(f"{out_path}/data/{last}").join(batch, PAIR, "left_anti").unionByName(batch)
            new.write.mode("overwrite").parquet(f"{out_path}/data/{batch_id}")
            # one small file, written after the version is whole
            session.createDataFrame([(batch_id,)], "version long").coalesce(1).write.mode("append").parquet(f"{out_path}/commits")
        finally:
            batch.unpersist()

    q = (counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
