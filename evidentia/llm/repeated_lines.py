"""Lines repeated across the documents of one source: found by heavy-hitter summaries, confirmed by exact counts.

First pass: each task keeps one Misra-Gries summary per source. A summary of k counters misses no line that
occurs in more than n / (k + 1) of the n lines it saw, and summaries merge by adding counters and errors.
Second pass: the lines that may reach the threshold are counted exactly, one count a document. Where a source has so many lines
that one pruned from every summary may still reach it, all lines of the source are counted exactly.

Defined results: a row with a NULL key, source or text counts nowhere and keeps its text; an empty text counts
as a document without lines; several rows with one key are one document, whose lines are those of all its rows;
an empty table gives no lines. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.frames import Columns, map_rows
from evidentia.session import cut, small, spread

_DIGITS = re.compile("[0-9]+")


def line_key(line: str) -> str:
    """The form in which lines are compared: no outer white space, each run of ASCII digits as one #."""
    return _DIGITS.sub("#", line.strip())


def _prune(counts: dict[str, int], k: int) -> int:
    """Takes the (k+1)th largest count from all counters, which leaves at most k; returns what it took."""
    least = sorted(counts.values(), reverse=True)[k]
    for line in [x for x, n in counts.items() if n <= least]:
        del counts[line]
    for line in counts:
        counts[line] -= least
    return least


def summaries(docs: DataFrame, k: int = 4096) -> DataFrame:
    """Per task and source: counters (kind 0), the error of the summary (kind 1), the keys of the documents seen (kind 2)."""

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        counts: dict[str, dict[str, int]] = {}
        errors: dict[str, int] = {}
        for b in batches:
            for key, source, text in zip(b["k"], b["s"], b["t"], strict=True):
                yield 2, source, None, 1, key
                own = counts.setdefault(source, {})
                for line in {line_key(x) for x in text.split("\n")}:
                    if line:
                        own[line] = own.get(line, 0) + 1
                if len(own) > 2 * k:
                    errors[source] = errors.get(source, 0) + _prune(own, k)
        for source, own in counts.items():
            yield 1, source, None, errors.get(source, 0), None
            for line, n in own.items():
                if n > 1 or len(own) <= k:
                    yield 0, source, line, n, None

    return map_rows(docs, run, f"kind int, s {dict(docs.dtypes)['s']}, line string, n long, k {dict(docs.dtypes)['k']}")


def _docs(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    picked = df.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(text).alias("t"))
    return spread(picked.where("k is not null and s is not null and t is not null"))


def repeated_lines(df: DataFrame, key: str = "article_id", source: str = "source_key", text: str = "text", share: float = 0.15, least: int = 5, k: int = 4096) -> DataFrame:
    """source, line, documents that hold it, documents of the source: lines in at least `share` and `least` of them."""
    docs = _docs(df, key, source, text)
    seen = cut(summaries(docs, k))
    totals = seen.where("kind = 2").groupBy("s").agg(F.countDistinct("k").alias("total"))
    totals = cut(totals.withColumn("need", F.greatest(F.lit(least), F.ceil(F.col("total") * share - 1e-9))))
    errors = seen.where("kind = 1").groupBy("s").agg(F.sum("n").alias("error"))
    # A count of one may have been left out by each task, hence the number of summaries that hold the source.
    tasks = seen.where("kind = 1").groupBy("s").agg(F.count("*").alias("tasks"))
    bound = cut(totals.join(errors, "s").join(tasks, "s").select("s", (F.col("need") - F.col("error") - F.col("tasks")).alias("from_n")))
    counted = seen.where("kind = 0").groupBy("s", "line").agg(F.sum("n").alias("n"))
    heavy = cut(counted.join(small(bound), "s").where("from_n > 0 and n >= from_n").select("s", "line"))
    hits = _hits(docs, heavy)
    # A line in no summary may occur as often as the errors and left-out ones add up to.
    open_ = {r.s for r in bound.where("from_n <= 0").select("s").collect()}
    if open_:
        hits = hits.unionByName(_all_lines(docs.where(F.col("s").isin(open_))))
    exact = hits.distinct().groupBy("s", "line").agg(F.count("*").alias("n"))
    kept = exact.join(small(totals), "s").where("n >= need")
    return kept.select(F.col("s").alias(source), "line", F.col("n").alias("n_docs"), F.col("total").alias("n_source"))


def _hits(docs: DataFrame, heavy: DataFrame) -> DataFrame:
    """s, line, k for each line of docs that is in heavy."""
    spark = docs.sparkSession
    rows = heavy.limit(SET_LINES + 1).collect()
    if len(rows) <= SET_LINES:
        sets: dict[str, set[str]] = {}
        for r in rows:
            sets.setdefault(r.s, set()).add(r.line)
        shared = spark.sparkContext.broadcast(sets)

        def run(batches: Iterator[Columns]) -> Iterator[tuple]:
            own = shared.value
            for b in batches:
                for key, source, text in zip(b["k"], b["s"], b["t"], strict=True):
                    for line in {line_key(x) for x in text.split("\n")} & own.get(source, set()):
                        yield source, line, key

        return map_rows(docs, run, f"s {dict(docs.dtypes)['s']}, line string, k {dict(docs.dtypes)['k']}")
    return _all_lines(docs).join(heavy, ["s", "line"], "left_semi")


def _all_lines(docs: DataFrame) -> DataFrame:
    """s, line, k for each line of docs."""

    def lines(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for key, source, text in zip(b["k"], b["s"], b["t"], strict=True):
                for line in {line_key(x) for x in text.split("\n")} - {""}:
                    yield source, line, key

    return map_rows(docs, lines, f"s {dict(docs.dtypes)['s']}, line string, k {dict(docs.dtypes)['k']}")


#: Lines up to which the candidate or confirmed lines go to the tasks as sets; beyond it they are joined. A choice of plan: the results are equal.
SET_LINES = 50_000


def without_lines(df: DataFrame, lines: DataFrame, source: str = "source_key", text: str = "text", row: str = "arrival") -> DataFrame:
    """`row` and the text without the lines that repeated_lines() gave; `row` must tell the rows of df apart."""
    picked = df.select(F.col(row).alias("r"), F.col(source).alias("s"), F.col(text).alias("t"))
    found = lines.select(F.col(source).alias("s"), "line").groupBy("s").agg(F.collect_set("line").alias("out"))
    found = cut(found)

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for key, text_, out in zip(b["r"], b["t"], b["out"], strict=True):
                if text_ is None or not out:
                    yield key, text_
                else:
                    gone = set(out)
                    yield key, "\n".join(x for x in text_.split("\n") if line_key(x) not in gone)

    joined = spread(picked.join(small(found, 10_000), "s", "left").select("r", "t", "out"))
    return map_rows(joined, run, f"`{row}` {dict(joined.dtypes)['r']}, `{text}` string")
