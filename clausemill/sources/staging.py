"""Tables between the steps of a job, in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local session gets a
    temporary folder of its own; any other is an error, as its machines would not see each other's files."""
    if at := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return at
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return jsc.getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: what follows neither computes it again nor loses it with an executor."""
    at = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt by its keys over a few tasks a core, which are not joined again: rows of a small file that unfold into much would
    else be one task's."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
