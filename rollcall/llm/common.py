"""What the operators of this subpackage share: table access, shared storage, whole-text batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources.shared import discard, shared_dir, stash  # noqa: F401


#: Bytes of an Arrow batch.
BATCH = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with Arrow batches of about BATCH bytes.

    The default, 64 MB, is what a JVM holds outside its heap for every task, twice while a buffer grows.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose column holds about most_bytes, one row at least: memory stays bounded by the longest text."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def numbered(docs: DataFrame, key: str, text: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(id long, key, text string, null as empty). The key itself is the id where it is a whole number, unique and never null."""
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *also)
    if src.schema["key"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        bad = src.groupBy("key").count().where("key is null or count > 1").limit(1).count()
        if not bad:
            return src.select(F.col("key").cast("long").alias("id"), "key", "text", *also)
    return stash(src.select(F.monotonically_increasing_id().alias("id"), "key", "text", *also))
