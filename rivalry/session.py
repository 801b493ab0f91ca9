"""Session construction and the shared scratch folder.

Intermediate tables (lineage cuts, round-trip sinks, streaming checkpoints)
live under the folder the cluster names in ``spark.checkpoint.dir``.  Only
when that setting is absent (local tests) do we create a private folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "rivalry", extra: dict | None = None) -> SparkSession:
    """A session with AQE, skew-join handling and Arrow enabled.

    ``shuffle_partitions`` is the *initial* partition count; AQE coalesces
    small partitions and splits skewed ones at run time, so on a cluster this
    should be sized for the largest stage (e.g. input bytes / 128 MB).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FALLBACK_ROOT: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder from ``spark.checkpoint.dir`` (or the
    context's checkpoint dir).  Only when neither is configured (local tests)
    a private folder is created and registered with ``setCheckpointDir`` —
    ``spark.checkpoint.dir`` itself cannot be changed on a running session."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        try:
            jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
            root = jdir.get() if jdir.isDefined() else None
        except Exception:  # Spark Connect has no SparkContext
            root = None
    if not root:
        key = getattr(spark, "sparkContext", None) and spark.sparkContext.applicationId
        root = _FALLBACK_ROOT.get(str(key))
        if root is None:
            master = spark.conf.get("spark.master", "local")
            if not re.match(r"local($|\[)", master):
                raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
            root = tempfile.mkdtemp(prefix="rivalry-ckpt-")
            _FALLBACK_ROOT[str(key)] = root
            try:
                spark.sparkContext.setCheckpointDir(root)
            except Exception:
                pass
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the checkpoint root for one job's output."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and read it back.

    Survives executor loss (files are on shared storage, unlike local
    checkpoints) and gives later stages real statistics for AQE.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def small_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Arrow batches of about ``size`` bytes at most, however long the texts are,
    so that a Python worker holds a few MB of text at a time.  A session setting,
    read when a plan runs; each operator sets its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rivalry`` importable in the Python workers (pandas UDFs,
    ``mapInPandas``, ``applyInPandas``) by shipping a zip of its sources with
    ``addPyFile`` — once per SparkContext.  Executors then need no install."""
    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # Spark Connect: ship with the session's artifact API instead
        return
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="rivalry-pkg-"), "rivalry.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
