"""Session helpers: shared scratch folders, eager reliable checkpoints, table loading."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is missing (local tests). The
    context's checkpoint directory is set from it, if it isn't set yet.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None)
    current = sc._jsc.sc().getCheckpointDir()
    if not configured:
        if current.isDefined():
            return current.get()
        configured = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    if not current.isDefined():
        sc.setCheckpointDir(configured)
    return configured


def tidy(spark: SparkSession) -> None:
    """Lets the driver notice what it no longer needs: Spark deletes shuffle and checkpoint files of collected objects only."""
    gc.collect()
    spark._jvm.System.gc()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage reliably: the rows are written to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    cut = df.checkpoint(eager=True)
    tidy(df.sparkSession)
    return cut


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A compressed table in the shared folder instead of a checkpoint, and its path for :func:`drop_path`."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
