"""Tables that cut a plan in two: what several branches read is made once, where any executor can read it again."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that goes to all tasks.
LOOKUP = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one of our own if all runs on this
    machine; on a cluster that is an error, since executors couldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lectern/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, packing: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and any executor can read it again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path, compression=packing)
    return spark.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame, name: str) -> DataFrame:
    """A narrow table, stored, that goes to all tasks if it has LOOKUP rows at most, so that what it is joined to doesn't
    move; of more rows Spark joins it as it sees fit."""
    table = stored(df, name)
    return F.broadcast(table) if table.count() <= LOOKUP else table


def let_go(spark: SparkSession) -> None:
    """Let the driver collect plans that have run and that nothing refers to, so that executors delete their shuffle files:
    in a long query these would otherwise stay until its end. For between steps that move much. It takes two rounds: the
    first frees what Python has let go of, the second what that has held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.15)


def discarded(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
