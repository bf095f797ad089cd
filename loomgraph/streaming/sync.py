"""Incremental sync as Structured Streaming: new files become upserts, one batch at a time.

The query's checkpoint plays the part of the last good state: a batch that fails is run again from it. Windowed counts
with a watermark are an extension of this library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.sinks import upsert


def sync_upserts(source: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], checkpoint: str) -> StreamingQuery:
    """Upsert each batch of a streaming source into a table given by its read and write functions, until none is left."""

    def apply(batch: DataFrame, _: int) -> None:
        write(upsert(read(), batch, keys))

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_table(source: DataFrame, folder: str, keys: list[str], checkpoint: str, buckets: int = 256, bucket: str = "bucket") -> StreamingQuery:
    """Upsert each batch of a streaming source into a Parquet table at `folder` that is dealt out by a hash of its keys.

    A batch reads and writes only the buckets that its keys fall into; `buckets` has to stay the same for a table, and
    is chosen so that one fits a task. The first batch sets the columns; further ones are left out later on.

    What a batch makes of its buckets is first written below the checkpoint as `staged/<number of the batch>`. A driver
    that ends while buckets are swapped loses no row: the batch is run again under its number, finds what it staged whole
    (marked by _SUCCESS) and swaps the same buckets once more, without reading the table.
    """
    spark = source.sparkSession

    def exists(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def apply(batch: DataFrame, number: int) -> None:
        staged = f"{checkpoint}/staged/{number}"
        if not exists(f"{staged}/_SUCCESS"):
            place = F.pmod(F.hash(*keys), F.lit(buckets))
            touched = [r[0] for r in batch.select(place).distinct().collect()]  # at most `buckets` numbers
            if not touched:
                return
            old = spark.read.parquet(folder).where(F.col(bucket).isin(touched)).drop(bucket) if exists(folder) else batch.limit(0)
            upsert(old, batch, keys).withColumn(bucket, place).write.mode("overwrite").parquet(staged)
        new = spark.read.parquet(staged).repartition(bucket)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(folder)
        at = spark._jvm.org.apache.hadoop.fs.Path(staged)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def not_seen(batch: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a batch whose key is not among those done."""
    return batch.join(done.select(key), key, "left_anti")


def stream_folder(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events by time window and key; rows later than the watermark are left out. For streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), by, "n")
