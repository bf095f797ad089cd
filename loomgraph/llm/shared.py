"""Session helpers of the llm operators: the shared checkpoint folder, materialised tables, and carried columns."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir or one set earlier; only a local session (tests) may do without either."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomgraph-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared checkpoint folder; its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(spark: SparkSession, size: int) -> int:
    """Partitions to coalesce a checkpointed table to, of about `size` bytes at most: no more than a shuffle has, no
    fewer than there are cores, and between these 64 MB each.

    Every file that a task creates starts processes on its executor (chmod, unless Hadoop's native library is there),
    which share the JVM's memory until they run their command. Coalesced partitions are computed one after another, so
    a wrong guess costs cores, not memory.
    """
    return min(width(spark), max(spark.sparkContext.defaultParallelism, -(-size // (64 << 20))))


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(names: tuple[str, ...]) -> list[Column]:
    """Columns that go through an operator, as one struct `carried` with fields c0, c1, ...; nothing for no names."""
    return [F.struct(*(quoted(c).alias(f"c{i}") for i, c in enumerate(names))).alias("carried")] if names else []


def restored(names: tuple[str, ...]) -> dict[str, Column]:
    """The carried columns again, by name."""
    return {c: F.col(f"carried.c{i}").alias(c) for i, c in enumerate(names)}


def schema(own: str, df: DataFrame, names: tuple[str, ...]) -> StructType:
    """An operator's schema: its own columns, and the struct of carried ones."""
    out = StructType.fromDDL(own)
    return out.add(StructField("carried", StructType([StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(names)]))) if names else out


def width(spark: SparkSession, size: int = 0, each: int = 128 << 20) -> int:
    """Partitions of a shuffle: as the session sets them, or more, so that `size` bytes make parts of about `each`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))
