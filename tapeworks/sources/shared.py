"""The folder that driver and executors share, and how much goes to Python at once."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, and in it one for this application, which clear() removes.

    Where none is set, a local session gets a temporary one; on a cluster that
    would be another folder on each machine, so it is an error there.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    named = named or (held.get() if held.isDefined() else None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), f"checkpoints-{os.getuid()}")
    return f"{named}/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, kind: str) -> str:
    return f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again, so that lost executors cost no recomputation."""
    to = fresh(df.sparkSession, "cut")
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def small_batches(spark: SparkSession, most_bytes: int = 1 << 22) -> None:
    """Rows go to Python in batches of some 4 MiB, whatever a row holds, so that a worker's memory stops growing at once; a setting of one's own that is lower stays."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > most_bytes:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def clear(spark: SparkSession) -> None:
    """Removes what this application has cut; DataFrames that read it must be done with."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(conf).delete(path, True)
