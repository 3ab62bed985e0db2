"""Figures on evidence, sources and claims, each one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def core_allowed(status: Column) -> Column:
    """Whether evidence of this status may carry a core conclusion."""
    return status == "full"


def any_allowed(status: Column) -> Column:
    """Whether evidence of this status may carry any conclusion."""
    return status.isin("full", "partial")


def with_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with name and layer of their source; those of unknown sources are left out."""
    from evidentia.session import small

    return articles.join(small(sources.select("source_key", F.col("name").alias("source_name"), F.col("layer").alias("source_layer"))), "source_key")


def first_seen(articles: DataFrame, known: DataFrame) -> DataFrame:
    """Articles with the earliest of their own first_seen and that of the ledger for their URL."""
    before = known.where("url <> ''").groupBy("url").agg(F.min("first_seen").alias("_seen"))
    return articles.join(before, "url", "left").withColumn("first_seen", F.least("first_seen", "_seen")).drop("_seen")


def first_fetched(articles: DataFrame) -> DataFrame:
    """url and the day it was first fetched."""
    return articles.groupBy("url").agg(F.min(F.to_date("fetched_at")).alias("first_fetched"))


def evidence_counts(entries: DataFrame, missing: str = "invalid") -> DataFrame:
    """Entries by status; those without one under `missing`."""
    return entries.groupBy(F.coalesce("fetch_status", F.lit(missing)).alias("fetch_status")).agg(F.count("*").alias("n"))


def coverage(sources: DataFrame) -> DataFrame:
    """One row: sorted regions, layers and keys of the enabled sources."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return sources.where("enabled").agg(joined("region").alias("regions"), joined("layer").alias("layers"), joined("source_key").alias("keys"))


def citations(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: distinct cited URLs, and those known and unknown."""
    cited = claims.select(F.explode("evidence").alias("url")).distinct()
    known = articles.select("url").distinct().withColumn("_known", F.lit(True))
    return cited.join(known, "url", "left").agg(F.count("*").alias("cited"), F.count_if("_known").alias("known"), F.count_if(F.col("_known").isNull()).alias("unknown"))


def claim_counts(claims: DataFrame, errors: DataFrame) -> DataFrame:
    """kind, importance, claims, core claims and verified ones: those without an error (errors: claim_id) that name evidence or need none."""
    bad = errors.select("claim_id").distinct().withColumn("_bad", F.lit(True))
    one = claims.groupBy("claim_id").agg(F.max(F.struct("kind", "importance", F.size("evidence").alias("n"))).alias("c")).select("claim_id", "c.*")
    rows = one.join(bad, "claim_id", "left")
    core = F.coalesce((F.col("importance") == "core") & F.col("kind").isin("fact", "inference"), F.lit(False))
    verified = F.col("_bad").isNull() & ((F.col("n") > 0) | F.col("kind").isin("company", "assumption"))
    return rows.groupBy("kind", "importance").agg(F.count("*").alias("claims"), F.count_if(core).alias("core"), F.count_if(F.coalesce(verified, F.lit(False))).alias("verified"))


def by_source(articles: DataFrame) -> DataFrame:
    """source_key and whether any text is full, and none blocked."""
    return articles.groupBy("source_key").agg(F.bool_or(F.col("fetch_status") == "full").alias("any_full"), F.bool_and(F.col("fetch_status") != "blocked").alias("none_blocked"))


def ledger_rate(entries: DataFrame) -> DataFrame:
    """One row: entries, URLs and the rate of full texts over all history."""
    from evidentia.operators.ledger import full_text_rate

    return entries.agg(F.count("*").alias("total"), F.count_distinct("url").alias("urls"), F.round(full_text_rate(F.col("fetch_status")), 4).alias("rate"))


def newest(articles: DataFrame, n: int) -> DataFrame:
    """The n articles dated last, unknown dates at the end, as they arrived among equals."""
    return articles.orderBy(F.col("pub_date").desc_nulls_last(), "arrival").limit(n)


def short_errors(attempts: DataFrame, n: int = 200) -> DataFrame:
    """Failed attempts with the beginning of their error."""
    return attempts.where("error <> ''").withColumn("error", F.left("error", F.lit(n)))
