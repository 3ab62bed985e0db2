"""Queries of sources, registries, templates and tiers through the library, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import dates, text
from evidentia.functions.bytes import decoded
from evidentia.operators import tiers
from evidentia.plans.queries import _q, query
from evidentia.session import spread, table
from evidentia.sources import listings, records, registry, templates

_DEFAULTS = "CASE WHEN coalesce(min_body_chars, 0) = 0 THEN 200 ELSE min_body_chars END AS min_body_chars, CASE WHEN coalesce(max_items, 0) = 0 THEN 20 ELSE max_items END AS max_items"


@query("src01_registry", f"SELECT source_key, name, region, layer, source_type, enabled, {_DEFAULTS} FROM source_registry")
def src01(spark, d):
    return registry.table(spark, registry.read_table(table(spark, d, "source_registry"))["sources"])


@query("flt15_selection", "SELECT source_key FROM source_registry WHERE enabled AND layer IN ('L1', 'L2')")
def flt15(spark, d):
    chosen = registry.select(registry.read_table(table(spark, d, "source_registry"))["sources"])
    return registry.table(spark, chosen).select("source_key")


@query("prj10_page_targets", "SELECT source_key, concat('https://', host, '/list/', page, '?s=', (page - 1) * 20) AS request FROM source_registry, range(1, 4) r(page)")
def prj10(spark, d):
    return registry.plan(spark, registry.read_table(table(spark, d, "source_registry"))["sources"]).select("source_key", F.explode("requests").alias("request"))


@query("agg12_planned", "SELECT layer, source_type AS type, count(*) AS sources, CAST(sum(3) AS BIGINT) AS requests, CAST(sum(CASE WHEN coalesce(max_items, 0) = 0 THEN 20 ELSE max_items END) AS BIGINT) AS most_items FROM source_registry WHERE enabled AND layer IN ('L1', 'L2') GROUP BY 1, 2")
def agg12(spark, d):
    chosen = registry.select(registry.read_table(table(spark, d, "source_registry"))["sources"])
    return registry.plan(spark, chosen).groupBy("layer", "type").agg(F.count("*").alias("sources"), F.sum(F.size("requests")).alias("requests"), F.sum("max_items").alias("most_items"))


#: A registry in which regions stand for layers, names for kinds, and the caps are below zero.
@query("val01_registry", "SELECT source_key, rule FROM (SELECT source_key, unnest([CASE WHEN region NOT IN ('L1', 'L2', 'L3', 'L4', 'L5') THEN 'layer is unknown' END, CASE WHEN probe NOT IN ('json_get', 'json_api', 'post_json', 'html_list', 'rss', 'atom', 'feed', 'sitemap', 'render') THEN 'type is unknown' END, 'pages, rows and items must be positive', 'listing.url must be http or https']) AS rule FROM source_registry) WHERE rule IS NOT NULL")
def val01(spark, d):
    rows = table(spark, d, "source_registry").select("source_key", "name", F.col("region").alias("layer"), F.col("probe").alias("source_type"), "enabled", "min_body_chars", F.lit(-1).alias("max_items"), "host", "region")
    raw = registry.read_table(rows)
    for source in raw["sources"]:
        source["listing"]["url"] = source["listing"]["url"].replace("https://", "//")
    return spark.createDataFrame(registry.violations(raw), "source_key string, rule string")


def _record(*columns: str):
    return F.to_json(F.struct(F.array(F.struct(*columns)).alias("rows")))


_FIRST = "coalesce(nullif(docno, ''), nullif(title, ''), nullif(url, ''))"


@query("prj02_first_given", f"SELECT {_FIRST} AS label, CAST(arrival AS VARCHAR) AS arrival FROM article")
def prj02(spark, d):
    payloads = table(spark, d, "article").select(_record("docno", "title", "url", "arrival").alias("payload"))
    return records.records(payloads, "payload", "rows", {"label": "docno|title|url", "arrival": "arrival"})


@query("src03_first_list", "SELECT CAST(arrival AS VARCHAR) AS arrival, nullif(url, '') AS url FROM article")
def src03_fallback(spark, d):
    """The path names nothing, so the first list of objects at the top holds the records."""
    rows = table(spark, d, "article")
    payload = F.to_json(F.struct(F.lit("x").alias("a"), F.array(F.lit(1)).alias("zz"), F.array(F.struct("arrival", "url")).alias("mm"), F.array(F.struct(F.lit("no").alias("url"))).alias("bb")))
    return records.records(rows.select(payload.alias("payload")), "payload", "data.rows", {"arrival": "arrival", "url": "url"})


_CLEAN = rf"replace(regexp_replace(title, '^{text.WS}+|{text.WS}+$', '', 'g'), chr(10), ' ')"


@query("flt04_title_length", f"SELECT arrival, left({_CLEAN}, 300) AS title, trim(CASE WHEN contains(url, 'utm_') OR contains(url, 'spm=') THEN replace(replace(regexp_replace(regexp_replace(url, '([?&])(?:utm_[^&#]*|spm=[^&#]*|from=[^&#]*|share_[^&#]*)', '\\1', 'g'), '[?&]+$', ''), '?&', '?'), '&&', '&') ELSE url END) AS link FROM (SELECT CAST(arrival AS VARCHAR) AS arrival, title, url FROM article) WHERE length({_CLEAN}) >= 6 AND url <> ''")
def flt04(spark, d):
    payloads = table(spark, d, "article").select(_record("arrival", "title", "url").alias("payload"))
    return listings.json_items(payloads, {"arrival": "arrival", "title": "title", "link": "url"}, "rows").select("arrival", "title", "link")


@query("flt05_link_pattern", r"SELECT url AS base, url AS link FROM (SELECT DISTINCT url FROM article) WHERE regexp_matches(url, '/(?:doc|policy)/[0-9]+') AND NOT contains(url, 'utm_') AND NOT contains(url, 'spm=')")
def flt05(spark, d):
    urls = table(spark, d, "article").where("url <> '' and not contains(url, 'utm_') and not contains(url, 'spm=')").select("url").distinct()
    page = F.concat(F.lit("<ul><li><a href='"), "url", F.lit("'>a title of some length</a><a href='/other/x'>another title of some length</a></li></ul>"))
    found = listings.html_links(urls.select("url", page.alias("payload")), pattern=r"/(?:doc|policy)/[0-9]+")
    return found.select(F.col("url").alias("base"), "link")


@query("src05_atom", "SELECT arrival, url AS link, pub_date AS date FROM article WHERE url <> '' AND NOT contains(url, 'utm_') AND NOT contains(url, 'spm=')")
def src05_atom(spark, d):
    """Entries in a namespace, links as attributes; every second part of the feeds is cut off and read without a parser."""
    from evidentia.sources.feeds import feed

    rows = table(spark, d, "article").where("url <> '' and not contains(url, 'utm_') and not contains(url, 'spm=')")
    link = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    end = F.when(F.col("pub_date").isNull(), "</entry></feed").otherwise("</entry></feed>")
    entry = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>a title of some length</title><link href='"), link, F.lit("'/><updated>"), F.coalesce(F.date_format("pub_date", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")), F.lit("</updated>"), end)
    return feed(rows.select("arrival", "url", entry.alias("payload"))).select("arrival", "link", "date")


@query("dat05_epochs", "SELECT docid, kind, CAST(try_strptime(left(publishdate, 10), '%Y-%m-%d') AS DATE) AS found FROM nfra_detail, (VALUES ('s'), ('ms')) k(kind) WHERE try_strptime(left(publishdate, 10), '%Y-%m-%d') >= DATE '2001-09-10'")
def dat05(spark, d):
    """Dates as epoch seconds and milliseconds."""
    day = F.unix_timestamp(F.left("publishdate", F.lit(10)), "yyyy-MM-dd")
    rows = table(spark, d, "nfra_detail").where(F.try_to_date(F.left("publishdate", F.lit(10)), "yyyy-MM-dd") >= F.lit("2001-09-10").cast("date")).withColumn("at", day)
    both = rows.select("docid", F.lit("s").alias("kind"), F.col("at").cast("string").alias("raw")).unionByName(rows.select("docid", F.lit("ms").alias("kind"), (F.col("at") * 1000).cast("string").alias("raw")))
    return both.select("docid", "kind", dates.listed_date(F.col("raw")).alias("found"))


@query("src12_decoded", "SELECT arrival, how, title FROM article, (VALUES ('declared'), ('wrongly')) h(how) WHERE title IS NOT NULL")
def src12(spark, d):
    """Bytes in a declared encoding, and UTF-8 that is declared as something it isn't."""
    rows = table(spark, d, "article").where("title is not null")
    declared = rows.select("arrival", F.lit("declared").alias("how"), F.encode("title", "UTF-16BE").alias("b"), F.lit("utf-16-be").alias("name"))
    wrongly = rows.select("arrival", F.lit("wrongly").alias("how"), F.encode("title", "UTF-8").alias("b"), F.lit("no-such-charset").alias("name"))
    return declared.unionByName(wrongly).select("arrival", "how", decoded(F.col("b"), F.col("name")).alias("title"))


@query("prj05_template_fields", "SELECT arrival, coalesce(params['docId'], '') AS doc_id, coalesce(params['docId'], '') AS lower_id, coalesce(params['lang'], '') AS lang, coalesce(CAST(year(pub_date) AS VARCHAR), '') AS year, coalesce(nullif(docno, ''), '') AS number, coalesce(nullif(regexp_extract(url, '[?&]from=([^&#]+)', 1), ''), '') AS origin FROM article")
def prj05(spark, d):
    fields = templates.field_map(F.col("params"), F.col("docno"), F.col("pub_date"), F.col("url"))
    rows = spread(table(spark, d, "article").select("arrival", fields.alias("f")))
    get = lambda k: F.coalesce(F.try_element_at("f", F.lit(k)), F.lit(""))
    return rows.select("arrival", get("docId").alias("doc_id"), get("docid").alias("lower_id"), get("lang").alias("lang"), get("year").alias("year"), get("documentNo").alias("number"), get("from").alias("origin"))


@query("prj04_strict_template", "SELECT arrival, CASE WHEN params['docId'] <> '' AND pub_date IS NOT NULL THEN concat('https://api.example/', year(pub_date), '/', params['docId'], '.json') END AS link FROM article")
def prj04(spark, d):
    fields = templates.field_map(F.col("params"), F.col("docno"), F.col("pub_date"), F.lit(""))
    return table(spark, d, "article").select("arrival", templates.filled_from("https://api.example/{year}/{docId}.json", fields, strict=True).alias("link"))


@query("map01_params", "SELECT arrival, params['docId'] AS doc_id, params['lang'] AS lang FROM article WHERE params IS NOT NULL")
def map01(spark, d):
    fields = templates.field_map(F.col("params"), F.lit(""), F.lit(None).cast("date"), F.lit(""))
    rows = table(spark, d, "article").where("params is not null").select("arrival", fields.alias("f"))
    return rows.select("arrival", F.try_element_at("f", F.lit("docId")).alias("doc_id"), F.try_element_at("f", F.lit("lang")).alias("lang"))


# Tiers over outcomes that the log of attempts stands for

_STATUS = "CASE WHEN NOT ok THEN 'blocked' WHEN chars >= 2000 THEN 'full' WHEN chars >= 800 THEN 'partial' ELSE 'listing_only' END"


def _tried(spark, d):
    rows = table(spark, d, "attempt").where("article_id is not null and ok is not null")
    none = lambda t: F.lit(None).cast(t)
    return rows.select("article_id", "tier", F.expr("repeat('x', coalesce(chars, 0))").alias("text"), F.lit("a found title").alias("title"), F.col("tier").alias("method"), F.expr(_STATUS).alias("status"), none("date").alias("pub_date"), none("string").alias("docno"), none("string").alias("issuer"), none("date").alias("effective_date"))


_BEST = f"""(SELECT article_id, tier, status FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY worth DESC, list_position(['api', 'text', 'html', 'pdf', 'render'], tier)) AS k FROM (
SELECT article_id, tier, {_STATUS} AS status, CASE {_STATUS} WHEN 'full' THEN 4 WHEN 'partial' THEN 3 WHEN 'listing_only' THEN 1 ELSE 0 END AS worth FROM attempt WHERE article_id IS NOT NULL AND ok IS NOT NULL)
WHERE NOT (status = 'listing_only' AND tier IN ('api', 'text', 'render'))) WHERE k = 1)"""


@query("win04_best_outcome", _BEST[1:-1])
def win04(spark, d):
    return tiers.best(_tried(spark, d)).select("article_id", "tier", "status")


_NOTE = f"CASE WHEN a.source_key = 'vpo_rules' THEN 'declared' WHEN b.status IS NULL THEN {_q(tiers.NONE_NOTE)} WHEN b.status <> 'full' THEN concat('best body is ', b.status, ' by ', b.tier) ELSE a.notes END"


@query("prj12_upgrade", f"SELECT a.arrival, CASE WHEN b.status IS NULL OR a.source_key = 'vpo_rules' THEN a.title ELSE 'a found title' END AS title, CASE WHEN a.source_key = 'vpo_rules' THEN 'blocked' ELSE coalesce(b.status, 'blocked') END AS fetch_status, {_NOTE} AS notes FROM article a LEFT JOIN {_BEST} b USING (article_id)")
def prj12(spark, d):
    after = tiers.upgraded(table(spark, d, "article"), _tried(spark, d), {"vpo_rules": "declared"})
    return after.select("arrival", "title", "fetch_status", "notes")


@query("cls10_open", f"SELECT DISTINCT a.arrival FROM article a WHERE NOT EXISTS (SELECT 1 FROM attempt t WHERE t.article_id = a.article_id AND t.ok AND {_STATUS.replace('NOT ok', 'false')} = 'full')")
def cls10_open(spark, d):
    return tiers.open_articles(table(spark, d, "article"), _tried(spark, d)).select("arrival")


_PRE = "concat('<html><body><pre>', coalesce(docno, ''), '</pre><p>x</p></body></html>')"


@query("str06_pre_bodies", f"SELECT arrival, trim(regexp_replace(regexp_replace(docno, '[\\x{{200b}}\\x{{feff}}]', '', 'g'), '{text.WS}+', ' ', 'g')) AS body FROM article WHERE docno <> '' AND {_PRE} IS NOT NULL AND NOT regexp_matches(docno, '[<&]') AND trim(regexp_replace(docno, '[\\x{{200b}}\\x{{feff}}]|{text.WS}+', '', 'g')) <> ''")
def str06(spark, d):
    from evidentia.functions import html

    edges = rf"[\x{{200b}}\x{{feff}}]|{text.WS}+"
    rows = table(spark, d, "article").where("docno <> ''").where(~F.col("docno").rlike("[<&]")).where(F.regexp_replace("docno", edges, "") != "")
    page = F.concat(F.lit("<html><body><pre>"), "docno", F.lit("</pre><p>x</p></body></html>"))
    return rows.select("arrival", html.plain(page).alias("body"))


# Requests against a tape that the log of attempts stands for: its tries by route and number

_TRIES = """(SELECT *, sum(CASE WHEN coalesce(status IN (200, 403, 404, 410), false) THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM (
SELECT concat(article_id, '/', request_id) AS request_id, attempt_id, status, chars, row_number() OVER (PARTITION BY article_id, request_id ORDER BY attempt_id) AS place FROM (SELECT DISTINCT attempt_id, article_id, request_id, status, chars FROM attempt WHERE article_id IS NOT NULL AND request_id IS NOT NULL)) WHERE place <= 6)"""


def _taped(spark, d):
    from pyspark.sql import Window

    from evidentia.operators import requests

    rows = table(spark, d, "attempt").where("article_id is not null and request_id is not null").select("attempt_id", "article_id", F.col("request_id").alias("r"), "status", "chars", "error", "elapsed_ms").distinct()
    own = F.concat_ws("/", F.col("article_id").cast("string"), F.col("r").cast("string"))
    place = F.row_number().over(Window.partitionBy("article_id", "r").orderBy("attempt_id")) - 1
    tape = rows.dropDuplicates(["attempt_id"]).withColumns({"url": own, "_p": place}).where("_p < 6").select("url", F.when(F.col("_p") < 3, "proxy").otherwise("direct").alias("route"), (F.col("_p") % 3).alias("try_no"), "status", "chars", "error", "elapsed_ms")
    asked = tape.select("url").distinct().select(F.col("url").alias("request_id"), "url", F.lit("html").alias("tier"))
    return requests.tries(asked, tape, limit=1 << 40)


@query("src09_tries", f"SELECT request_id, CAST(place AS BIGINT) AS place, status FROM {_TRIES} WHERE coalesce(done, 0) = 0")
def src09(spark, d):
    return _taped(spark, d).select("request_id", F.col("place").cast("long").alias("place"), "status")


@query("src09_outcomes", f"SELECT request_id, max(CASE WHEN status IN (200, 403, 404, 410) THEN status END) AS status, count(*) AS tries FROM {_TRIES} WHERE coalesce(done, 0) = 0 GROUP BY 1")
def src09_outcomes(spark, d):
    from evidentia.operators import requests

    return requests.outcomes(_taped(spark, d)).select("request_id", "status", "tries")


@query("src07_kinds", "SELECT url, CASE WHEN max(fetch_status) = 'scanned_pdf' THEN 'pdf' WHEN max(fetch_status) IN ('full', 'partial') THEN 'json' ELSE 'text' END AS kind FROM article WHERE url <> '' GROUP BY 1")
def src07(spark, d):
    """Captures that are sniffed: PDF bytes, JSON and plain text, several of one URL."""
    from evidentia.operators import attempts

    rows = table(spark, d, "article").where("url <> ''").groupBy("url").agg(F.max("fetch_status").alias("s"))
    body = F.when(F.col("s") == "scanned_pdf", F.lit("\n%PDF-1.4 x")).when(F.col("s").isin("full", "partial"), F.to_json(F.struct("url"))).otherwise(F.lit("plain words"))
    both = rows.select("url", F.lit("a").alias("path"), F.encode(body, "UTF-8").alias("content")).unionByName(rows.select("url", F.lit("b").alias("path"), F.encode(F.lit("later"), "UTF-8").alias("content")))
    return attempts.documents(both).select("url", "kind")


@query("flt16_listing_failures", "SELECT DISTINCT source_key, url, right(coalesce(error, ''), 500) AS error FROM attempt a WHERE NOT ok AND NOT EXISTS (SELECT 1 FROM attempt g WHERE g.ok AND g.request_id = a.request_id AND g.article_id = a.article_id) UNION SELECT source_key, url, 'not JSON' FROM article WHERE fetch_status = 'blocked'")
def flt16(spark, d):
    from evidentia.operators import attempts

    answers = table(spark, d, "article").select("source_key", "url", F.when(F.col("fetch_status") == "blocked", F.lit("<html>no</html>")).otherwise(F.to_json(F.struct("arrival"))).alias("payload"))
    return attempts.listing_failures(table(spark, d, "attempt"), answers)
