"""From listed items to a fetch queue: windows, keywords, keep-first, caps and the shared budget."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(date: Column, since: datetime.date | str | None, until: datetime.date | str | None) -> Column:
    """Inclusive at both ends; an unknown date passes."""
    inside = F.lit(True)
    if since is not None:
        inside = inside & (date >= F.lit(str(since)).cast("date"))
    if until is not None:
        inside = inside & (date <= F.lit(str(until)).cast("date"))
    return date.isNull() | inside


def keywords_pass(title: Column, summary: Column, wanted: list[str], unwanted: list[str]) -> Column:
    """Any wanted word, if there are any, and no unwanted one, in title and summary, whatever the case."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))
    holds = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(hay, w))
    passes = ~holds(unwanted) if unwanted else F.lit(True)
    return passes & holds(wanted) if wanted else passes


def keep_first(df: DataFrame, keys: list[str], order: str = "arrival") -> DataFrame:
    """The first row of each key in arrival order. A window group limit discards rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def cap(df: DataFrame, by: str, most: int | Column, order: str = "arrival", ceiling: int | None = None) -> DataFrame:
    """At most so many rows of each source, the first in arrival order.

    Where `most` is a column, name its largest value as `ceiling`: a literal lets tasks drop the surplus before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    rows = df.withColumn("_rank", rank).where(F.col("_rank") <= most)
    return (rows if ceiling is None else rows.where(F.col("_rank") <= ceiling)).drop("_rank")


def interleaved(df: DataFrame, by: str = "source_key", order: str = "arrival") -> DataFrame:
    """Adds turn: all first items of the sources come before all second ones."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def queue(df: DataFrame, budget: int, by: str = "source_key", order: str = "arrival", eligible: Column | None = None) -> DataFrame:
    """The first `budget` eligible items in turn; only eligible items use the budget up.

    No source can give more than its first `budget` eligible items, which a group limit finds before the shuffle; turns are counted
    only up to the last of them.
    """
    from evidentia.session import small

    if eligible is None:
        rows = interleaved(cap(df, by, budget, order), by, order)
        return rows.orderBy("turn", by, order).limit(budget)
    last = cap(df.where(eligible), by, budget, order).groupBy(F.col(by).alias("_by")).agg(F.max(order).alias("_last"))
    early = df.join(small(last), F.col(by) == F.col("_by")).where(F.col(order) <= F.col("_last")).drop("_by", "_last")
    return interleaved(early, by, order).where(eligible).orderBy("turn", by, order).limit(budget)
