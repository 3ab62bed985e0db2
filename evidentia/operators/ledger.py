"""The evidence ledger: projection, keyed upsert with history, version chains and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import content_hash, snapshot_id, title_key

STATUSES = ["full", "partial", "listing_only", "scanned_pdf", "blocked"]


def ledger_row(articles: DataFrame) -> DataFrame:
    """The ledger's projection; placeholders (fixed values) stand for what isn't known."""
    given = lambda c, to: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(to))
    return articles.select(
        "article_id", "arrival", "url", "source", "source_key", "region", "title", given("docno", "无/未标明").alias("docno"), given("pub_date", "未标明").alias("pub_date"),
        given("effective_date", "不适用").alias("effective_date"), F.coalesce("issuer", F.lit("")).alias("issuer"), "policy_status", "fetch_status", "fetch_method",
        F.length(F.coalesce("text", F.lit(""))).alias("text_chars"), "evidence_layer", F.coalesce("notes", F.lit("")).alias("notes"),
    )


def index_entry(articles: DataFrame) -> DataFrame:
    """url with the fingerprints of the body."""
    return articles.select("article_id", "arrival", "url", snapshot_id(F.col("url"), F.col("text")).alias("snapshot_id"), content_hash(F.col("text")).alias("content_hash"), title_key(F.col("title")).alias("title_key"))


#: What the history keeps of a row that a newer acquisition replaced, oldest first.
HISTORY = "array<struct<snapshot_id:string,snapshot_path:string,fetch_status:string,content_hash:string,fetched_at:timestamp>>"
_KEPT = ("snapshot_id", "snapshot_path", "fetch_status", "content_hash", "fetched_at")


def upserted(ledger: DataFrame, batch: DataFrame, key: str = "url") -> DataFrame:
    """The ledger after a batch: new rows win, the earliest first_seen stays, another snapshot pushes the old row on the history.

    Both sides have key, snapshot_id, snapshot_path, fetch_status, content_hash, first_seen, fetched_at and history. A snapshot path
    names one acquisition, so a changed status counts even where the body is the same. One full outer join on the key;
    bucket both by it to save the shuffle.
    """
    old, new = ledger.alias("o"), batch.alias("n")
    changed = F.col("o.snapshot_path").isNotNull() & (F.col("o.snapshot_path") != F.col("n.snapshot_path"))
    past = F.coalesce("o.history", F.array().cast(HISTORY))
    pushed = F.array_append(past, F.struct(*[F.col(f"o.{c}").alias(c) for c in _KEPT]))
    pick = lambda c: F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[pick(c) for c in _KEPT[:4]], F.least("o.first_seen", "n.first_seen").alias("first_seen"), pick("fetched_at"),
        F.when(F.col(f"n.{key}").isNotNull() & changed, pushed).otherwise(past).alias("history"),
    )


def folded(rows: DataFrame, key: str = "url", order: str = "arrival") -> DataFrame:
    """The ledger after all rows were upserted one by one in their order, by one ordered pass per key.

    rows have key, order and the columns of upserted() but history; the result is that of upserted().
    """
    by = Window.partitionBy(key).orderBy(order)
    before = lambda c: F.lag(c).over(by)
    changed = before("snapshot_path").isNotNull() & (before("snapshot_path") != F.col("snapshot_path"))
    past = F.struct(F.col(order).alias("at"), *[before(c).alias(c) for c in _KEPT])
    each = rows.select("*", F.when(changed, past).alias("_past"))
    last = lambda c: F.max_by(c, order).alias(c)
    history = F.transform(F.array_sort(F.collect_list("_past")), lambda x: x.dropFields("at")).alias("history")
    return each.groupBy(key).agg(*[last(c) for c in _KEPT[:4]], F.min("first_seen").alias("first_seen"), last("fetched_at"), history)


def version_chain(articles: DataFrame) -> DataFrame:
    """Each version of a URL with the one before it."""
    order = Window.partitionBy("url").orderBy(F.col("fetched_at").asc_nulls_first(), "arrival")
    return articles.where("url <> ''").select("url", "arrival", "fetched_at", F.row_number().over(order).alias("version"), F.lag("arrival").over(order).alias("before"))


def source_counters(articles: DataFrame, sources: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """One row a source, also for sources without items: kept items and items by status, and what was listed where that is given."""
    counts = articles.groupBy("source_key").agg(F.count("*").alias("kept"), *[F.count_if(F.col("fetch_status") == s).alias(s) for s in STATUSES])
    out = sources.select("source_key").join(counts, "source_key", "left")
    if listed is not None:
        out = out.join(listed.groupBy("source_key").agg(F.count("*").alias("listed")), "source_key", "left")
    return out.na.fill(0)


def summary(kept: DataFrame, listed: DataFrame, entries: DataFrame) -> DataFrame:
    """One row on a run: listed, kept and full items, its rate of full texts, and the rate over the whole ledger."""
    run = kept.agg(F.count("*").alias("kept"), F.count_if(F.col("fetch_status") == "full").alias("full"), full_text_rate(F.col("fetch_status")).alias("run_full_text_rate"), F.sort_array(F.collect_set("source_key")).alias("sources"))
    known = entries.agg(F.count("*").alias("total"), full_text_rate(F.col("fetch_status")).alias("full_text_rate"))
    one = lambda df: df.withColumn("_", F.lit(1))
    return one(run).join(one(listed.agg(F.count("*").alias("listed"))), "_").join(one(known), "_").drop("_")


def full_text_rate(status: Column) -> Column:
    """The share of full texts; 0 without rows."""
    return F.coalesce(F.avg((status == "full").cast("double")), F.lit(0.0))
