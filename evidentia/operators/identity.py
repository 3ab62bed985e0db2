"""Which articles are the same policy: equal URL, equal folded body, or equal number and issuer, taken transitively."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.documents import UNKNOWN
from evidentia.functions.text import fold
from evidentia.operators.components import components
from evidentia.session import cut, is_small, spread

#: Parts into which the rows of an alias are split where first rows can't be broadcast.
SALTS = 16


def aliases(articles: DataFrame, row: str = "arrival") -> DataFrame:
    """row, alias: one row for each thing that identifies an article."""
    text, number, by = fold(F.col("text")), F.lower(fold(F.col("docno"))), F.lower(fold(F.col("issuer")))
    url = F.nullif(F.col("url"), F.lit(""))
    known = ~number.isin(UNKNOWN) & ~by.isin(UNKNOWN)
    each = F.array(
        F.when(url.isNotNull(), F.concat(F.lit("u"), F.sha2(url, 256))),
        F.when(F.length(text) > 0, F.concat(F.lit("t"), F.sha2(text, 256))),
        F.when(known, F.concat(F.lit("d"), F.sha2(F.concat(number, F.lit("\n"), by), 256))),
    )
    return articles.select(F.col(row).alias("row"), F.explode(F.array_compact(each)).alias("alias"))


def identity(articles: DataFrame, row: str = "arrival") -> DataFrame:
    """Adds group_id, group_size and is_kept. The kept one is full, of the highest layer, earliest.

    Each alias links its rows to its first row, so a hot alias costs its rows and no pairs; groups are the components of these
    links. Aliases of one row, nearly all, end in the count before the join, and a row that shares none is a group of its own.
    """
    named = cut(aliases(spread(articles.select(row, "url", "text", "docno", "issuer")), row).select("row", "alias"))
    shared = cut(named.groupBy("alias").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last").select("alias", "first"))
    # The rows of a hot alias meet its first row in several tasks.
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    first = shared if is_small(shared) else shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = named.join(F.broadcast(first), "alias") if first is shared else named.withColumn("salt", salt).join(first, ["alias", "salt"])
    links = linked.where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    groups = components(links)
    joined = articles.join(groups.withColumnRenamed("node", "_row"), F.col(row) == F.col("_row"), "left")
    grouped = joined.withColumn("group_id", F.coalesce("component", F.col(row))).drop("_row", "component")
    layer = F.when(F.col("evidence_layer") == "L1", 0).when(F.col("evidence_layer") == "L2", 1).otherwise(9)
    best = grouped.groupBy("group_id").agg(F.min(F.struct((F.col("fetch_status") != "full").cast("int").alias("open"), layer.alias("layer"), F.col(row).alias("best"))).alias("w"), F.count("*").alias("group_size"))
    return grouped.join(best.select("group_id", "w.best", "group_size"), "group_id").withColumn("is_kept", F.col(row) == F.col("best")).withColumnRenamed("best", "kept_row")


def kept(articles: DataFrame, row: str = "arrival") -> DataFrame:
    return identity(articles, row).where("is_kept")


def dropped(articles: DataFrame, row: str = "arrival") -> DataFrame:
    """row, the row and url of the article kept in its place, and the reason: what the two share, or that others link them."""
    all_rows = cut(identity(articles, row).select(row, "url", "text", "docno", "issuer", "group_id", "kept_row", "is_kept"))
    name = lambda r: [r, "url", "text", "docno", "issuer"]
    winners = all_rows.where("is_kept").select("group_id", F.col("url").alias("kept_url"))
    out = all_rows.where("not is_kept").join(winners, "group_id").select(row, "kept_row", "kept_url")
    held = cut(aliases(all_rows.join(all_rows.where("not is_kept").select("group_id").distinct(), "group_id", "left_semi").select(*name(row)), row))
    own, kept_ = held.select(F.col("row").alias(row), "alias"), held.select(F.col("row").alias("kept_row"), "alias")
    common = out.select(row, "kept_row").join(own, row).join(kept_, ["kept_row", "alias"]).groupBy(row).agg(F.min(F.when(F.col("alias").startswith("u"), 1).when(F.col("alias").startswith("t"), 2).otherwise(3)).alias("_r"))
    why = F.when(F.col("_r") == 1, "same url").when(F.col("_r") == 2, "same body").when(F.col("_r") == 3, "same number and issuer").otherwise("linked by others")
    return out.join(common, row, "left").select(row, "kept_row", "kept_url", why.alias("reason"))


def latest(articles: DataFrame, key: str = "article_id", by: str = "fetched_at", row: str = "arrival") -> DataFrame:
    """The last fetched version of each record, the later arrival in a tie."""
    order = Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last(), F.col(row).desc())
    return articles.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
