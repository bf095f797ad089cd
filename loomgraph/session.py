"""Session helpers: the shared checkpoint folder and materialised intermediate tables of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: A rest of so many edges or fewer is worked off by one task of some megabytes; larger tables go on in rounds.
SMALL = 100_000


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the folder of spark.checkpoint.dir, so that loops don't grow the plan.

    Only a local session (tests) may do without that folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="loomgraph-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def laid_out(df: DataFrame, *by: str) -> DataFrame:
    """As cut, with the rows dealt out by columns, so that joins on them in a loop leave this side where it is."""
    return cut(df.repartition(width(df.sparkSession), *by))


def at_most(df: DataFrame, n: int) -> bool:
    return df.limit(n + 1).count() <= n
