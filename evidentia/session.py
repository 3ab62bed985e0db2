"""Small helpers that every operator needs from its session."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as JSON text) up to which a table counts as small enough for a broadcast join.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Bytes of input up to which spread() may shuffle; larger inputs have enough splits of their own.
SPREAD_BYTES = 2 << 30


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not where:
        where = os.path.join(tempfile.gettempdir(), "evidentia-checkpoints")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables below the shared one; it is deleted when the application ends."""
    where = f"{shared_dir(spark)}/evidentia-{spark.sparkContext.applicationId}"
    if where not in _MARKED:
        path, fs = _hadoop(spark, where)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(where)
    return where


_MARKED: set[str] = set()


def _hadoop(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application has cut so far. Results that were not written yet can't be read any more."""
    where = run_dir(spark)
    path, fs = _hadoop(spark, where)
    fs.delete(path, True)
    _MARKED.discard(where)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again.

    This ends the lineage, survives the loss of any executor and gives the optimizer the true size.
    """
    path = f"{run_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() has written and that nothing will read again."""
    for df in tables:
        own = f"{run_dir(df.sparkSession)}/table-"
        for folder in {os.path.dirname(x) for x in df.inputFiles()}:
            path, fs = _hadoop(df.sparkSession, folder)
            if path.toUri().getPath().startswith(_hadoop(df.sparkSession, own)[0].toUri().getPath()):
                fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that have run and are held no longer; else they stay until its memory fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes; looks at no more rows than that."""
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return n <= rows and (size or 0) <= most


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its rows and bytes are within the limits, else df as it is: the join then shuffles.

    Give it tables that cut() has written, as it reads them once for the check.
    """
    return F.broadcast(df) if is_small(df, limit) else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is a small input whose files give far fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() * 2 < cores
    return df.repartition(cores) if few and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
