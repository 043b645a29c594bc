"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Plans show all filters of a scan; by default they are cut after 100 characters.
    "spark.sql.maxMetadataStringLength": "2000",
}

STREAM_STATE_STORE = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app: str = "proofgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; `conf` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="proofgrid-")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a session in one process (plain local tests) that names none gets a temporary folder: on a cluster each executor
    would write its part to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Later steps then start from a table that survives lost executors, is read column by
    column, and is computed once however many steps use it. The folder's owner removes it.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/proofgrid/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_out(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Like `cut_lineage`, in buckets by `key`, at least `parts`: joins by that column read them as they lie, without a shuffle."""
    spark, name = df.sparkSession, f"proofgrid_{uuid.uuid4().hex}"
    # Fewer buckets than a shuffle has partitions would be dealt out again.
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = f"{shared_folder(spark).rstrip('/')}/proofgrid/{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(name, format="parquet")
    out = spark.table(name)
    # The rows stay in the shared folder, as `out` knows; only the name goes.
    spark.sql(f"DROP TABLE {name}")
    return out
