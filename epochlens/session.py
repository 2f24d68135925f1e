"""Session settings and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot series or pair must be split even when that costs one more exchange above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows handed to Python may hold a whole raster block; keep a batch of them well inside a worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def build_session(master: str = "local[8]", app: str = "epochlens", **conf: str) -> SparkSession:
    """Session for local runs and tests; on a cluster pass the session you already have to `tune`."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in {**_RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on; sizes and parallelism stay as the cluster set them."""
    for key, value in _RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the one the cluster names, or a fresh one on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="epochlens-ckpt-")
    context.setCheckpointDir(named)
    return named


_STAGES: list[list[str]] = []


@contextmanager
def stage(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables that `cut` and `scratch` made inside. Write results elsewhere before."""
    made: list[str] = []
    _STAGES.append(made)
    try:
        yield
    finally:
        _STAGES.remove(made)
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch(spark: SparkSession) -> str:
    """A new path in the checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/epochlens-{uuid.uuid4().hex}"
    if _STAGES:
        _STAGES[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the checkpoint folder and go on from there.

    Lineage ends at the files, so several consumers share one computation and a lost executor only re-reads;
    the table is columnar, so consumers prune it and joins see its real size.
    """
    path = scratch(df.sparkSession)
    # Written once, read a few times and gone with the stage: zstd takes less disk than Spark's default.
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
