"""The log of fetch attempts: failures that no later try mended, the best outcome, slices by article."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unmended(attempts: DataFrame) -> DataFrame:
    """Failed attempts whose request never succeeded."""
    good = attempts.where("ok").select("request_id", "article_id").distinct()
    return attempts.where("not ok").join(good, ["request_id", "article_id"], "left_anti")


def best(attempts: DataFrame) -> DataFrame:
    """One attempt an article: successful before failed, then the most characters, then the earliest."""
    order = Window.partitionBy("article_id").orderBy(F.col("ok").desc_nulls_last(), F.col("chars").desc_nulls_last(), F.col("tried_at").asc_nulls_last(), "attempt_id")
    return attempts.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def by_article(attempts: DataFrame) -> DataFrame:
    """article_id and its attempts in order, without whole-row repeats."""
    each = F.struct("attempt_id", "tier", "status", "ok", "chars", "error", "elapsed_ms", "request_id", "url")
    return attempts.distinct().groupBy("article_id").agg(F.array_sort(F.collect_list(each)).alias("attempts"))


def unparsed(captured: DataFrame, payload: str = "payload") -> DataFrame:
    """Captured JSON (source_key, url, payload) that is none, as failed attempts: ok is false, the error says so."""
    bad = captured.where(F.col(payload).isNotNull() & F.try_parse_json(payload).isNull())
    return bad.select("source_key", "url", F.lit(False).alias("ok"), F.length(payload).alias("chars"), F.lit("not JSON").alias("error"))


def listing_failures(attempts: DataFrame, captured_json: DataFrame) -> DataFrame:
    """source_key, url, error of listings that failed: requests that no later try mended, and answers that are no JSON. The last 500
    characters of an error are kept."""
    one = unmended(attempts).select("source_key", "url", "error")
    return one.unionByName(unparsed(captured_json).select("source_key", "url", "error")).withColumn("error", F.right(F.coalesce("error", F.lit("")), F.lit(500))).distinct()


def documents(captured: DataFrame, content: str = "content", keep: int | None = None) -> DataFrame:
    """One capture a URL (the first by path), with its kind: pdf by its first bytes, whatever it was served as, json if it parses,
    else text. Bodies beyond `keep` bytes are refused, not cut."""
    from evidentia.functions.bytes import decoded, is_pdf

    rows = captured.where(F.col(content).isNotNull())
    rows = rows.where(F.length(content) <= keep) if keep is not None else rows
    first = rows.groupBy("url").agg(F.min_by(content, "path").alias(content), F.min("path").alias("path"))
    text = decoded(F.col(content), F.lit(None).cast("string"))
    typed = first.withColumn("_text", text)
    kind = F.when(is_pdf(F.col(content)), "pdf").when(F.try_parse_json("_text").isNotNull() & F.col("_text").rlike(r"^\s*[\[{]"), "json").otherwise("text")
    return typed.select("url", "path", kind.alias("kind"), content, F.when(kind != "pdf", F.col("_text")).alias("payload"))
