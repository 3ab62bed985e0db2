"""Requests played against recorded answers: routes, tries, sizes, back-off and pace, as a live reader would log them.

A tape holds what each try of a URL would meet: url, route, try_no (from 0), status, chars, error, elapsed_ms. The operator tells
which tries are made, in which order, and what comes of each request. Tries of one request are few; no group is larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses after which no other try can help, the largest body, the pause after a try, and that between two of a host.
FINAL, LIMIT, PAUSE_MS, GAP_MS = (200, 403, 404, 410), 8 << 20, 1200, 800


def _ends(status: Column, chars: Column, limit: int) -> Column:
    """A settled status, or a body beyond the limit, which is refused and not asked for again."""
    return F.coalesce(status.isin(*FINAL), F.lit(False)) | F.coalesce(chars > limit, F.lit(False))


def tries(requests: DataFrame, tape: DataFrame, routes: tuple[str, ...] = ("proxy", "direct"), retries: int = 2, limit: int = LIMIT) -> DataFrame:
    """The attempts of each request (request_id, url, tier), in order: route by route, each `retries` + 1 times, up to the first that
    settles it. Adds place, ok, error (300 characters), and wait_ms, the pause before the next try of the same route."""
    order = F.array_position(F.array(*[F.lit(r) for r in routes]), F.col("route"))
    met = tape.where(F.col("route").isin(*routes) & (F.col("try_no") <= retries)).withColumn("_order", order)
    by = Window.partitionBy("request_id").orderBy("_order", "try_no")
    rows = requests.join(met, "url").withColumn("_end", _ends(F.col("status"), F.col("chars"), limit))
    rows = rows.withColumn("place", F.row_number().over(by)).withColumn("_before", F.coalesce(F.max(F.col("_end").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = rows.where("_before = 0")
    over = F.coalesce(F.col("chars") > limit, F.lit(False))
    ok = F.coalesce((F.col("status") == 200) & (F.col("chars") > 0), F.lit(False)) & ~over
    said = F.when(over, "response exceeds the limit").when(ok, F.lit(None)).otherwise(F.coalesce(F.nullif("error", F.lit("")), F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(", "), F.coalesce("chars", F.lit(0)).cast("string"), F.lit(" bytes"))))
    wait = F.when(~F.col("_end") & (F.col("try_no") < retries), (F.col("try_no") + 1) * PAUSE_MS).otherwise(0)
    return kept.select("request_id", "url", F.concat_ws(":", "tier", "route").alias("tier"), "try_no", "place", "status", "chars", ok.alias("ok"), F.left(said, F.lit(300)).alias("error"), "elapsed_ms", wait.cast("int").alias("wait_ms"))


def outcomes(attempts: DataFrame) -> DataFrame:
    """request_id, the status that settled it (NULL where every try failed), its tier, the number of tries and the time they took."""
    last = F.max_by(F.struct("status", "tier", "ok", "error"), "place")
    got = attempts.groupBy("request_id").agg(last.alias("l"), F.count("*").alias("tries"), F.sum(F.col("elapsed_ms") + F.col("wait_ms")).alias("took_ms"))
    settled = F.coalesce(F.col("l.status").isin(*FINAL), F.lit(False)) & (F.coalesce("l.error", F.lit("")) != "response exceeds the limit")
    return got.select("request_id", F.when(settled, F.col("l.status")).alias("status"), "l.tier", "l.ok", "tries", "took_ms")


def paced(attempts: DataFrame, host: Column, order: str = "request_id", gap_ms: int = GAP_MS) -> DataFrame:
    """Adds starts_ms: when each attempt begins if a host is asked by one task, never twice within the gap.

    What a live reader does by giving each host to one task; a host's attempts are numbered in that task anyway.
    """
    by = Window.partitionBy("_host").orderBy(order, "place").rowsBetween(Window.unboundedPreceding, -1)
    took = F.greatest(F.col("elapsed_ms") + F.col("wait_ms"), F.lit(gap_ms))
    return attempts.withColumn("_host", host).withColumn("starts_ms", F.coalesce(F.sum(took).over(by), F.lit(0)).cast("long")).drop("_host")


def transport_notes(attempts: DataFrame, proxy: str = "proxy") -> DataFrame:
    """request_id, note: requests that the proxy failed and a direct route answered, or whose TLS failed at the proxy."""
    routes = attempts.groupBy("request_id").agg(F.max(F.when(F.col("ok") & ~F.col("tier").endswith(":" + proxy), 1)).alias("direct"), F.max(F.when(~F.col("ok") & F.col("tier").endswith(":" + proxy), 1)).alias("failed"), F.max(F.when(F.col("tier").endswith(":" + proxy) & F.contains("error", F.lit("SSL")), 1)).alias("tls"))
    notes = F.array_compact(F.array(F.when(F.col("tls") == 1, "TLS failed at the proxy"), F.when((F.col("direct") == 1) & (F.col("failed") == 1), "direct after the proxy failed")))
    return routes.select("request_id", F.explode(notes).alias("note"))
