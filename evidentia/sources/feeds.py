"""Feeds and sitemaps: items of XML payloads whatever their namespace, as arrays of structs."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions import dates, urls

_ITEM = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "link", "date", "summary")] + [T.StructField("pos", T.IntegerType())]))
#: The elements that carry an item's parts.
SUMMARIES = ("description", "summary", "encoded")
DATES = ("pubdate", "published", "updated", "date", "lastmod")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _children(payload: str, names: tuple[str, ...]) -> list[list[tuple[str, str, dict]]]:
    """The children (name, text, attributes) of every element of these names; broken XML is read element by element."""
    try:
        root = ET.fromstring(payload.strip().encode("utf-8", "replace"))
        return [[(_local(c.tag), "".join(c.itertext()).strip(), c.attrib) for c in el] for el in root.iter() if _local(el.tag) in names]
    except ET.ParseError:
        out = []
        for _, body in re.findall(rf"<(?:\w+:)?({'|'.join(names)})\b[^>]*>(.*?)</(?:\w+:)?\1>", payload, re.S | re.I):
            parts = re.findall(r"<(?:\w+:)?(\w+)\b([^>]*?)(?:/>|>(.*?)</(?:\w+:)?\1>)", body, re.S)
            out.append([(n.lower(), unescape(re.sub(r"<!\[CDATA\[|\]\]>", "", t)).strip(), dict(re.findall(r"([\w:]+)=[\"']([^\"']*)", a))) for n, a, t in parts])
        return out


def feed_items(payload: str | None) -> list[dict]:
    out = []
    for children in _children(payload or "", ("item", "entry")):
        item = {"title": "", "link": "", "date": "", "summary": "", "pos": len(out)}
        for name, text, attrs in children:
            if name == "title":
                item["title"] = text
            elif name == "link":
                item["link"] = attrs.get("href") or text or item["link"]
            elif name in SUMMARIES:
                item["summary"] = re.sub(r"<[^>]+>", "", text).strip()
            elif name in DATES and not item["date"]:
                item["date"] = text
        out.append(item)
    return out


def sitemap_urls(payload: str | None) -> list[dict]:
    out = []
    for children in _children(payload or "", ("url",)):
        own = {name: text for name, text, _ in children if name in ("loc", "lastmod")}
        if own.get("loc"):
            out.append({"title": "", "link": own["loc"], "date": own.get("lastmod", ""), "summary": "", "pos": len(out)})
    return out


def _array(payload: Column, fn) -> Column:
    @F.pandas_udf(_ITEM)
    def run(values: pd.Series) -> pd.Series:
        return values.map(fn)

    return run(payload)


def feed(captured: DataFrame, payload: str = "payload", base: str = "url") -> DataFrame:
    """One row an item with a title of 8 characters and a link; keeps the columns of captured other than the payload."""
    rows = captured.withColumn("_item", F.explode(_array(F.col(payload), feed_items))).drop(payload)
    kept = rows.where("length(_item.title) >= 8 and _item.link <> ''")
    link = urls.cleaned(urls.joined(F.col(base), F.col("_item.link")))
    return kept.withColumns({"link": link, "title": F.left("_item.title", F.lit(300)), "date": dates.listed_date(F.col("_item.date")), "summary": F.left("_item.summary", F.lit(400)), "pos": F.col("_item.pos")}).drop("_item")


def sitemap(captured: DataFrame, payload: str = "payload", pattern: str | None = None, since: str | None = None) -> DataFrame:
    """One row a URL block; the last step of the path stands for the title. Unknown dates pass `since`. `rank` orders each sitemap:
    newest first, unknown dates last, as listed among equals."""
    rows = captured.withColumn("_item", F.explode(_array(F.col(payload), sitemap_urls))).drop(payload)
    rows = rows.withColumns({"link": F.col("_item.link"), "date": dates.listed_date(F.col("_item.date")), "pos": F.col("_item.pos")}).drop("_item")
    rows = rows.where(F.col("link").rlike(pattern)) if pattern else rows
    rows = rows.where(F.col("date").isNull() | (F.col("date") >= F.lit(since).cast("date"))) if since else rows
    newest = Window.partitionBy(*[c for c in rows.columns if c not in ("link", "date", "pos")]).orderBy(F.col("date").desc_nulls_last(), "pos")
    rows = rows.withColumn("rank", F.row_number().over(newest))
    slug = F.trim(F.replace(F.regexp_extract(F.try_parse_url("link", F.lit("PATH")), "([^/]*)/*$", 1), F.lit("-"), F.lit(" ")))
    return rows.withColumn("title", F.left(F.coalesce(F.nullif(slug, F.lit("")), "link"), F.lit(300)))
