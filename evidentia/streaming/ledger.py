"""The ledger kept by a stream of articles, in partitions by hash of the URL: a batch rewrites the partitions it touches."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from evidentia.operators.identity import latest
from evidentia.operators.ledger import HISTORY, upserted
from evidentia.operators.snapshots import with_paths

SCHEMA = f"url string, snapshot_id string, snapshot_path string, fetch_status string, content_hash string, first_seen date, fetched_at timestamp, history {HISTORY}"
#: Partitions of a ledger; a parameter of keep(), fixed for the life of the ledger.
PARTS = 64


def entries(articles: DataFrame) -> DataFrame:
    """Ledger rows of a batch, one a URL: its latest version."""
    rows = with_paths(latest(articles.where("url <> ''"), "url"))
    at = F.col("fetched_at").cast("timestamp")
    return rows.select("url", "snapshot_id", "snapshot_path", "fetch_status", "content_hash", F.coalesce("first_seen", F.to_date(at)).alias("first_seen"), at.alias("fetched_at"), F.array().cast(HISTORY).alias("history"))


def _versions(spark: SparkSession, root: str) -> dict[int, int]:
    """The last complete version of each partition: folders part=P/version=V that hold _SUCCESS."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = jvm.Path(os.path.join(root, "ledger", "part=*", "version=*", "_SUCCESS"))
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    out: dict[int, int] = {}
    for status in found or []:
        version = status.getPath().getParent()
        p, v = int(version.getParent().getName().split("=")[1]), int(version.getName().split("=")[1])
        out[p] = max(v, out.get(p, -1))
    return out


def read(spark: SparkSession, root: str, parts: list[int] | None = None) -> DataFrame:
    """The ledger, or some of its partitions, as it stands."""
    paths = [os.path.join(root, "ledger", f"part={p}", f"version={v}") for p, v in sorted(_versions(spark, root).items()) if parts is None or p in parts]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def keep(articles: DataFrame, root: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Starts the stream. A batch writes the version of its number in each partition it touches, from the last one before it, and then
    drops older ones; tried again, it gives the same ledger."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = F.pmod(F.xxhash64("url"), F.lit(parts)).cast("int")
        new = entries(batch).withColumn("_part", place).persist()
        try:
            last = _versions(spark, root)
            for p in sorted(r._part for r in new.select("_part").distinct().collect()):  # no more than there are partitions
                if last.get(p, -1) >= number:
                    continue
                where = os.path.join(root, "ledger", f"part={p}")
                upserted(read(spark, root, [p]), new.where(F.col("_part") == p).drop("_part")).write.mode("overwrite").parquet(os.path.join(where, f"version={number}"))
                if p in last:
                    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
                    old = jvm.Path(os.path.join(where, f"version={last[p]}"))
                    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        finally:
            new.unpersist()

    return articles.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
