"""Tables in the folder that all executors share: what is read more than once is written there once. And rows dealt over all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session that names none, as in tests, gets a private one."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievemark-"))
    return context.getCheckpointDir().get()


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df, its rows dealt by key over at least four tasks a core.

    A file of few row groups is read by as few tasks, and all that is done to its rows row by row stays in them.
    The number is fixed, as work on a row has little to do with its bytes, by which Spark would join small parts.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def written_once(df: DataFrame, what: str) -> DataFrame:
    """df, computed now and read from a table; it survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
