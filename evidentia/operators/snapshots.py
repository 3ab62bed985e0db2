"""Immutable snapshots, the index that is swapped as a whole, and the readable archive."""

from __future__ import annotations

import json
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import content_hash, snapshot_id

_BAD = re.compile(r"^(?:[A-Za-z]:|[\\/])|(?:^|[\\/])\.\.(?:[\\/]|$)")


#: What a version of a record is told by, besides its body.
META = ("title", "pub_date", "effective_date", "issuer", "docno", "policy_status", "fetch_status", "fetch_method", "evidence_layer", "notes")


def source_dir(source_key: Column, source: Column) -> Column:
    """The folder of a source: letters, digits, _ and - only, 40 at most."""
    return F.left(F.regexp_replace(F.coalesce(F.nullif(source_key, F.lit("")), source, F.lit("")), r"(?U)[^\w-]+", "_"), F.lit(40))


def meta_hash(articles: DataFrame) -> Column:
    """12 hex digits over the metadata that articles have; NULL and the empty string differ."""
    return F.left(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(META) if c in articles.columns]), {"ignoreNullFields": "false"}), 256), F.lit(12))


def with_paths(articles: DataFrame) -> DataFrame:
    """Adds y, ym, source_dir, snapshot_id, content_hash and snapshot_path. The path names one acquisition: url, body, metadata, time
    and arrival. It is worked out from the row, so a task that runs again gives the same one."""
    there = lambda *names: [F.col(c) for c in names if c in articles.columns]
    day = F.coalesce(*there("pub_date", "first_seen"), F.lit(None).cast("date"))
    known = lambda c: F.coalesce(c, F.lit("unknown-date"))
    acquired = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "fetched_at", "arrival") if c in articles.columns]
    rows = articles.withColumns({"y": known(F.date_format(day, "yyyy")), "ym": known(F.date_format(day, "yyyy-MM")), "source_dir": source_dir(F.col("source_key"), F.coalesce(*there("source"), F.lit(""))), "snapshot_id": snapshot_id(F.col("url"), F.col("text")), "content_hash": content_hash(F.col("text")), "meta_hash": meta_hash(articles)})
    version = F.left(F.sha2(F.concat_ws("\n", "snapshot_id", "meta_hash", *acquired), 256), F.lit(32))
    return rows.withColumn("snapshot_path", F.concat_ws("/", F.lit("snapshots"), "y", "ym", "source_dir", F.concat_ws("_", "snapshot_id", "meta_hash", version)))


def append(articles: DataFrame, root: str) -> None:
    """Adds one version of each article below root/snapshots, by year, month and source; nothing is overwritten."""
    with_paths(articles).write.mode("append").partitionBy("y", "ym", "source_dir").parquet(os.path.join(root, "snapshots"))


def is_contained(path: str, root: str) -> bool:
    """Whether a stored path stays below root: not absolute, no drive, no step up, no link that leads out."""
    if not path or _BAD.search(path):
        return False
    real = os.path.realpath(os.path.join(root, path))
    return real == os.path.realpath(root) or real.startswith(os.path.realpath(root) + os.sep)


def contained(path: Column) -> Column:
    """is_contained() by the path's spelling, before anything is read."""
    return F.coalesce((path != "") & ~path.rlike(_BAD.pattern), F.lit(False))


def snapshot_texts(index: DataFrame, snapshots: DataFrame) -> DataFrame:
    """url and text of the snapshot that each index row points to; empty where there is none, or where its path leads out."""
    texts = snapshots.select("snapshot_path", F.col("text").alias("_text"))
    pointed = index.select("url", F.when(contained(F.col("snapshot_path")), F.col("snapshot_path")).alias("snapshot_path"))
    return pointed.join(texts, "snapshot_path", "left").select("url", F.coalesce("_text", F.lit("")).alias("text"))


def _files(spark: SparkSession, path: str):
    """The Hadoop path and the file context that holds it: local, HDFS or an object store alike."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointer(spark: SparkSession, root: str) -> str | None:
    path, fs = _files(spark, os.path.join(root, "index.json"))
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        name = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))["index"]
    except (ValueError, KeyError, TypeError, Py4JJavaError) as e:  # what can't be read, or fails its checksum
        raise ValueError(f"the index pointer below {root} is broken") from e
    finally:
        stream.close()
    if not is_contained(name, root):
        raise ValueError(f"the index lies outside: {name!r}")
    return name


def swap_index(index: DataFrame, root: str, key: str = "url") -> str:
    """Writes the index to a new folder, then moves the pointer file to it in one step; readers see the old or the new one.

    A broken pointer, or an index with a missing or repeated key, raises before the pointer moves.
    """
    spark = index.sparkSession
    _pointer(spark, root)
    name = f"index-{uuid.uuid4().hex}"
    index.write.parquet(os.path.join(root, name))
    written = spark.read.schema(index.schema).parquet(os.path.join(root, name))
    if key in index.columns and not written.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        raise ValueError(f"the index has rows without {key}, or more than one for it")
    new, fs = _files(spark, os.path.join(root, f".index.json.{uuid.uuid4().hex}"))
    stream = fs.create(new, False)
    try:
        stream.write(bytearray(json.dumps({"index": name}).encode("utf-8")))
        stream.hsync()
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
    over[0] = getattr(jvm, "Options$Rename").OVERWRITE
    jvm.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(jvm.Path(os.path.join(root, "index.json"))), over)
    return name


def load_index(spark: SparkSession, root: str, schema) -> DataFrame:
    """The current index; empty where there is none yet; a broken pointer raises before anything is written."""
    name = _pointer(spark, root)
    return spark.createDataFrame([], schema) if name is None else spark.read.schema(schema).parquet(os.path.join(root, name))


def archive_sections(articles: DataFrame) -> DataFrame:
    """arrival and a Markdown section of each article; one that has no text says so."""
    given = lambda c, to: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(to))
    head = F.format_string("## %s\n\n- %s\n- %s\n- %s\n- %s\n", given("title", "-"), given("url", "-"), given("source", "-"), given("pub_date", "-"), given("fetch_status", "-"))
    body = F.when(F.coalesce("text", F.lit("")) == "", F.concat(F.lit("(no text) "), F.coalesce("notes", F.lit("")))).otherwise(F.col("text"))
    return articles.select("arrival", F.concat(head, F.lit("\n"), body, F.lit("\n")).alias("section"))
