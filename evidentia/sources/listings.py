"""Captured listing pages to items, by the kind of source: JSON, HTML, feed or sitemap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import dates, html, urls
from evidentia.functions.text import WS
from evidentia.sources import feeds, records
from evidentia.sources.templates import filled


def html_links(captured: DataFrame, payload: str = "payload", base: str = "url", selector: str | None = None, pattern: str | None = None, date_pattern: str | None = None) -> DataFrame:
    """Links with titles of 8 characters, each URL of a page once; the date may stand in the URL."""
    rows = captured.withColumn("_a", F.explode(html.links(F.col(payload), selector))).drop(payload)
    rows = rows.where(F.col("_a.href").rlike(pattern)) if pattern else rows
    rows = rows.where("length(_a.text) >= 8 and not endswith(_a.text, '>>')")
    rows = rows.withColumns({"link": urls.cleaned(urls.joined(F.col(base), F.col("_a.href"))), "title": F.left("_a.text", F.lit(300)), "pos": F.col("_a.pos")}).drop("_a").where("link <> ''")
    first = Window.partitionBy(base, "link").orderBy("pos")
    rows = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return rows.withColumn("date", dates.date_from_url(F.col("link"), date_pattern) if date_pattern else F.lit(None).cast("date"))


def json_items(captured: DataFrame, spec: dict[str, str], path: str, template: str | None = None, payload: str = "payload") -> DataFrame:
    """Records mapped by `spec`, with titles of 6 characters; the link is a field or a template over the fields."""
    rows = records.records(captured, payload, path, spec).withColumn("title", F.regexp_replace(F.regexp_replace("title", rf"^{WS}+|{WS}+$", ""), "\n", " "))
    rows = rows.where("length(title) >= 6").withColumn("title", F.left("title", F.lit(300)))
    link = filled(template, rows.columns) if template else F.col("link")
    rows = rows.withColumn("link", urls.cleaned(link)).where("link <> ''")
    return rows.withColumn("date", dates.listed_date(F.col("date"))) if "date" in rows.columns else rows


KINDS = {
    "json_get": json_items, "json_api": json_items, "post_json": json_items, "html_list": html_links,
    "rss": feeds.feed, "atom": feeds.feed, "feed": feeds.feed, "sitemap": feeds.sitemap,
}
