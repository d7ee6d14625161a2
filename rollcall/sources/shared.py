"""Storage that driver and executors share, to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's checkpoint folder. A temporary one of this machine only where
    both are unset and all runs on this machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rollcall-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, in at most `files` files if its size is known.

    Unlike checkpoint() the copy is columnar and compressed; unlike localCheckpoint() it outlives executors. Snappy,
    as zstd's native buffers pile up over many small files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df = df if files is None else df.coalesce(max(1, files))
    df.write.option("compression", "snappy").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def kept(df: DataFrame) -> DataFrame:
    """stash(df), whose shuffle files go when it is written, not when the driver happens to collect its garbage: nothing reads them
    again."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return stash(df)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def discard(*stashes: DataFrame) -> None:
    """Delete the files of stashes that nothing reads any more."""
    for df in stashes:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stash_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df by these columns in spark.sql.shuffle.partitions parts, which adaptive execution leaves alone: it would put rows that
    are few bytes but much work into one task, and what is made of them after."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
