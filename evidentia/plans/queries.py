"""The queries of the core operators by name, and their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import dates, documents, text, urls
from evidentia.operators import attempts as tries
from evidentia.operators import audit, identity, ledger, listing
from evidentia.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SINCE, UNTIL = "2024-06-01", "2025-06-30"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# Scans, filters, projections


@query("src03_json_records", "SELECT docid, nullif(doctitle, '') AS title, nullif(documentno, '') AS docno, try_cast(left(publishdate, 10) AS DATE) AS pub_date FROM nfra_detail WHERE code = 200")
def src03(spark, d):
    from evidentia.sources.records import records

    details = table(spark, d, "nfra_detail")
    payload = F.to_json(F.struct("code", F.struct(F.struct(F.col("docid").alias("docId"), F.col("doctitle").alias("docTitle"), F.col("documentno").alias("documentNo"), F.col("publishdate").alias("publishDate")).alias("row")).alias("data")))
    spec = {"title": "docTitle|title", "docno": "documentNo|docno", "date": "publishDate", "id": "docId"}
    found = records(details.where("code = 200").select(payload.alias("payload")), "payload", "data.row", spec)
    return found.select(F.col("id").cast("long").alias("docid"), "title", "docno", F.try_to_date(F.left("date", F.lit(10))).alias("pub_date"))


@query("flt01_window", f"SELECT arrival, pub_date FROM article WHERE pub_date IS NULL OR pub_date BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}'")
def flt01(spark, d):
    return table(spark, d, "article").where(listing.in_window(F.col("pub_date"), SINCE, UNTIL)).select("arrival", "pub_date")


@query("flt03_keywords", "SELECT arrival FROM (SELECT arrival, lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''))) AS hay FROM article) WHERE (contains(hay, '保险') OR contains(hay, 'custody') OR contains(hay, 'prämien')) AND NOT contains(hay, '试行')")
def flt03(spark, d):
    return table(spark, d, "article").where(listing.keywords_pass(F.col("title"), F.col("summary"), ["保险", "custody", "Prämien"], ["试行"])).select("arrival")


_HAY = "left(coalesce(text, ''), 2000)"
_BLOCKED = "coalesce(" + ", ".join(f"nullif(regexp_extract({_HAY}, {_q(p)}, 0), '')" for p in documents.BLOCKED) + ")"


@query("flt08_blocked", f"SELECT arrival, {_BLOCKED} AS mark FROM article WHERE {_BLOCKED} IS NOT NULL")
def flt08(spark, d):
    mark = documents.blocked_by(F.lit(""), F.coalesce("text", F.lit("")))
    return spread(table(spark, d, "article")).select("arrival", mark.alias("mark")).where("mark is not null")


_TRIM = f"'^{text.WS}+|{text.WS}+$', '', 'g'"
_LINES = f"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), {_TRIM}), chr(10)), lambda x: regexp_replace(x, {_TRIM})), lambda x: x <> '')"
_MARKS = " + ".join(f"regexp_matches(left(regexp_replace(coalesce(text, ''), {_TRIM}), 4000), {_q(p)})::INT" for p in documents.TOOLBARS)
_NAV = f"((len({_LINES}) >= 12 AND len(list_filter({_LINES}, lambda x: length(x) <= 12)) >= 0.8 * len({_LINES})) OR ({_MARKS} >= 2 AND length(regexp_replace(coalesce(text, ''), {_TRIM})) < 500))"


@query("cls01_status", f"SELECT arrival, CASE WHEN {_BLOCKED} IS NOT NULL THEN 'blocked' WHEN length(coalesce(text, '')) < coalesce(min_body_chars, 200) THEN 'listing_only' WHEN {_NAV} THEN 'listing_only' ELSE 'full' END AS status FROM article JOIN source_registry USING (source_key)")
def cls01(spark, d):
    sources = table(spark, d, "source_registry").select("source_key", F.coalesce("min_body_chars", F.lit(200)).alias("least"))
    rows = spread(table(spark, d, "article")).join(sources, "source_key")
    body = F.coalesce("text", F.lit(""))
    verdict = F.when(documents.is_blocked(F.lit(""), body), "blocked").when(F.length(body) < F.col("least"), "listing_only")
    return rows.select("arrival", verdict.when(documents.is_navigation(body), "listing_only").otherwise("full").alias("status"))


@query("prj03_template", "SELECT arrival, concat('https://', coalesce(source_key, ''), '/', coalesce(params['docId'], ''), '.html') AS link FROM article")
def prj03(spark, d):
    from evidentia.sources.templates import filled

    rows = table(spark, d, "article").withColumn("docId", F.try_element_at("params", F.lit("docId")))
    return rows.select("arrival", filled("https://{source_key}/{docId}.html", rows.columns).alias("link"))


@query("prj06_ledger_row", "SELECT article_id, arrival, url, source, source_key, region, title, coalesce(nullif(docno, ''), '无/未标明') AS docno, coalesce(CAST(pub_date AS VARCHAR), '未标明') AS pub_date, coalesce(CAST(effective_date AS VARCHAR), '不适用') AS effective_date, coalesce(issuer, '') AS issuer, policy_status, fetch_status, fetch_method, length(coalesce(text, '')) AS text_chars, evidence_layer, coalesce(notes, '') AS notes FROM article")
def prj06(spark, d):
    return ledger.ledger_row(table(spark, d, "article"))


@query("prj08_head_tail", f"SELECT arrival, CASE WHEN length(t) <= 400 THEN t ELSE left(t, 200) END AS head, CASE WHEN length(t) <= 400 THEN t ELSE right(t, 200) END AS tail FROM (SELECT arrival, trim(regexp_replace(coalesce(text, ''), '{text.WS}+', ' ', 'g')) AS t FROM article)")
def prj08(spark, d):
    head, tail = text.head_tail(F.col("text"))
    return spread(table(spark, d, "article")).select("arrival", head.alias("head"), tail.alias("tail"))


# Text, dates, numbers, hashes


@query("str01_fold")
def str01(spark, d):
    return table(spark, d, "claim").select("claim_id", text.fold(F.col("text")).alias("folded"))


@query("str02_title_key")
def str02(spark, d):
    return spread(table(spark, d, "article")).select("arrival", text.title_key(F.col("title")).alias("title_key"))


_NORMAL = rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{{200b}}\x{{feff}}]', '', 'g'), '[A-Za-z0-9+/=_-]{{40,}}', ' ', 'g'), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(regexp_replace(x, '[ \t\x{{3000}}]+', ' ', 'g'), {_TRIM})), lambda x: x <> '')"


@query("str03_normalized", f"SELECT arrival, md5(array_to_string({_NORMAL}, chr(10))) AS digest FROM article")
def str03(spark, d):
    return spread(table(spark, d, "article")).select("arrival", F.md5(text.normalized(F.col("text"))).alias("digest"))


@query("str07_clean_url", "SELECT arrival, trim(CASE WHEN contains(url, 'utm_') OR contains(url, 'spm=') THEN replace(replace(regexp_replace(regexp_replace(url, '([?&])(?:utm_[^&#]*|spm=[^&#]*|from=[^&#]*|share_[^&#]*)', '\\1', 'g'), '[?&]+$', ''), '?&', '?'), '&&', '&') ELSE coalesce(url, '') END) AS url FROM article")
def str07(spark, d):
    return table(spark, d, "article").select("arrival", urls.cleaned(F.col("url")).alias("url"))


@query("str09_hosts", "SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS n FROM article WHERE url <> '' GROUP BY 1")
def str09(spark, d):
    return table(spark, d, "article").where("url <> ''").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def _sql_date(hay: str, pattern: str, order=(1, 2, 3), named=False) -> str:
    y, m, d = (f"regexp_extract({hay}, {_q(pattern)}, {i})" for i in order)
    if named:
        m = f"CASE WHEN {m} <> '' THEN CAST((strpos('janfebmaraprmayjunjulaugsepoctnovdec', left(lower({m}), 3)) + 2) // 3 AS VARCHAR) END"
    return f"try_cast(concat({y}, '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0')) AS DATE)"


_PLAIN = "translate(left(text, 2000), '０１２３４５６７８９', '0123456789')"
_ANY = "coalesce(" + ", ".join([*(_sql_date(_PLAIN, p) for p in (dates.LABELLED, dates.CHINESE, dates.DASHED, dates.SLASHED)), _sql_date("left(text, 2000)", dates.DAY_FIRST, (3, 2, 1), True), _sql_date("left(text, 2000)", dates.MONTH_FIRST, (3, 1, 2), True)]) + ")"


@query("dat02_any_date", f"SELECT arrival, {_ANY} AS found FROM article WHERE text IS NOT NULL")
def dat02(spark, d):
    return spread(table(spark, d, "article")).where("text is not null").select("arrival", dates.any_date(F.col("text")).alias("found"))


@query("dat04_effective", f"SELECT arrival, CASE WHEN regexp_matches(text, {_q(dates.EFFECTIVE)}) THEN {_sql_date('text', dates.EFFECTIVE)} ELSE {_sql_date('left(text, 4000)', dates.EFFECTIVE_EN, (3, 2, 1), True)} END AS found FROM article WHERE text IS NOT NULL")
def dat04(spark, d):
    return spread(table(spark, d, "article")).where("text is not null").select("arrival", dates.effective_date(F.col("text")).alias("found"))


@query("dat03_publication")
def dat03(spark, d):
    return spread(table(spark, d, "article")).where("text is not null").select("arrival", dates.publication_date(F.col("text")).alias("found"))


@query("dat05_listed", "SELECT docid, try_cast(left(publishdate, 10) AS DATE) AS found FROM nfra_detail WHERE regexp_matches(publishdate, '^20[0-9]{2}-[0-9]{2}-[0-9]{2}')")
def dat05(spark, d):
    return table(spark, d, "nfra_detail").where(F.col("publishdate").rlike("^20[0-9]{2}-[0-9]{2}-[0-9]{2}")).select("docid", dates.listed_date(F.col("publishdate")).alias("found"))


_DOCNO = "coalesce(" + ", ".join(f"nullif(regexp_extract(left(text, 6000), {_q(p)}, 0), '')" for p in documents.DOCNOS) + ")"


@query("tok01_docno", f"SELECT arrival, coalesce(trim(regexp_replace({_DOCNO}, '{text.WS}+', ' ', 'g')), '') AS docno FROM article WHERE text IS NOT NULL")
def tok01(spark, d):
    return spread(table(spark, d, "article")).where("text is not null").select("arrival", documents.docno(F.col("text")).alias("docno"))


_ISSUER = "coalesce(" + ", ".join(f"nullif(regexp_extract(left(text, 3000), {_q(p)}, 1), '')" for p in (documents.ISSUER_LABEL, documents.ISSUER_LINE)) + ")"


@query("tok03_issuer", f"SELECT arrival, coalesce(left(regexp_replace({_ISSUER}, '{text.WS}+', '', 'g'), 60), '') AS issuer FROM article WHERE text IS NOT NULL")
def tok03(spark, d):
    return spread(table(spark, d, "article")).where("text is not null").select("arrival", documents.issuer(F.col("text")).alias("issuer"))


@query("hsh01_content_hash")
def hsh01(spark, d):
    return ledger.index_entry(spread(table(spark, d, "article"))).select("arrival", "content_hash")


@query("hsh02_snapshot_id", "SELECT arrival, left(sha256(concat(coalesce(url, ''), chr(10), coalesce(text, ''))), 16) AS snapshot_id FROM article")
def hsh02(spark, d):
    return spread(table(spark, d, "article")).select("arrival", text.snapshot_id(F.col("url"), F.col("text")).alias("snapshot_id"))


# Joins


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, arrival DESC) AS k FROM article WHERE url <> '') WHERE k = 1)"
_CITED = "(SELECT DISTINCT claim_id, kind, importance, text AS claim_text, unnest(evidence) AS url FROM claim)"


@query("jn04_claim_evidence", f"SELECT c.claim_id, c.url, a.article_id, a.fetch_status FROM {_CITED} c LEFT JOIN {_LATEST} a USING (url)")
def jn04(spark, d):
    return audit.claim_evidence(table(spark, d, "claim"), table(spark, d, "article")).select("claim_id", "url", "article_id", "fetch_status")


@query("jn16_unmended", "SELECT a.* FROM attempt a WHERE NOT ok AND NOT EXISTS (SELECT 1 FROM attempt g WHERE g.ok AND g.request_id = a.request_id AND g.article_id = a.article_id)")
def jn16(spark, d):
    rows = table(spark, d, "attempt")
    return tries.unmended(rows).select(*rows.columns)


# Aggregates


@query("agg01_source_counters", "SELECT s.source_key, coalesce(kept, 0) AS kept, CAST(coalesce(f, 0) AS BIGINT) AS full, CAST(coalesce(p, 0) AS BIGINT) AS partial, CAST(coalesce(l, 0) AS BIGINT) AS listing_only, CAST(coalesce(c, 0) AS BIGINT) AS scanned_pdf, CAST(coalesce(b, 0) AS BIGINT) AS blocked FROM source_registry s LEFT JOIN (SELECT source_key, count(*) AS kept, count_if(fetch_status = 'full') AS f, count_if(fetch_status = 'partial') AS p, count_if(fetch_status = 'listing_only') AS l, count_if(fetch_status = 'scanned_pdf') AS c, count_if(fetch_status = 'blocked') AS b FROM article GROUP BY 1) USING (source_key)")
def agg01(spark, d):
    return ledger.source_counters(table(spark, d, "article"), table(spark, d, "source_registry"))


@query("agg02_full_text_rate", "SELECT source_key, round(coalesce(avg((fetch_status = 'full')::INT), 0), 4) AS rate, count(*) AS n FROM article GROUP BY 1")
def agg02(spark, d):
    return table(spark, d, "article").groupBy("source_key").agg(F.round(ledger.full_text_rate(F.col("fetch_status")), 4).alias("rate"), F.count("*").alias("n"))


@query("agg10_blocked_samples", "SELECT source_key, string_agg(url, '; ' ORDER BY arrival) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY arrival) AS k FROM article WHERE fetch_status IN ('blocked', 'scanned_pdf')) WHERE k <= 5 GROUP BY 1")
def agg10(spark, d):
    rows = listing.cap(table(spark, d, "article").where("fetch_status in ('blocked', 'scanned_pdf')"), "source_key", 5)
    return rows.groupBy("source_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("arrival", "url"))), lambda x: x.url), "; ").alias("urls"))


@query("agg12_attempt_totals", "SELECT source_key, tier, count(*) AS tries, CAST(count_if(ok) AS BIGINT) AS good, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms FROM (SELECT DISTINCT * FROM attempt) GROUP BY 1, 2")
def agg12(spark, d):
    return table(spark, d, "attempt").distinct().groupBy("source_key", "tier").agg(F.count("*").alias("tries"), F.count_if("ok").alias("good"), F.sum("elapsed_ms").alias("elapsed_ms"))


_STRONG = "coalesce(a.fetch_status = 'full' AND a.evidence_layer IN ('L1', 'L2') AND a.text <> '', false)"


@query("agg13_core_coverage", f"WITH core AS (SELECT DISTINCT claim_id FROM claim WHERE importance = 'core' AND kind IN ('fact', 'inference')), per AS (SELECT c.claim_id, bool_and({_STRONG}) AS strong FROM {_CITED} c LEFT JOIN {_LATEST} a USING (url) WHERE c.importance = 'core' AND c.kind IN ('fact', 'inference') GROUP BY 1) SELECT count(*) AS core_claims, CAST(count_if(coalesce(strong, false)) AS BIGINT) AS covered, count_if(coalesce(strong, false)) / nullif(count(*), 0) AS share FROM core LEFT JOIN per USING (claim_id)")
def agg13(spark, d):
    return audit.core_coverage(table(spark, d, "claim"), table(spark, d, "article"))


# Windows, order, limits


@query("win01_interleaved", "SELECT arrival, row_number() OVER (PARTITION BY source_key ORDER BY arrival) AS turn FROM article")
def win01(spark, d):
    return listing.interleaved(table(spark, d, "article")).select("arrival", F.col("turn").cast("long").alias("turn"))


@query("win02_keep_first", f"SELECT arrival, source_key, url FROM (SELECT *, row_number() OVER (PARTITION BY source_key, url ORDER BY arrival) AS k FROM article WHERE url <> '' AND (pub_date IS NULL OR pub_date >= DATE '{SINCE}')) WHERE k = 1")
def win02(spark, d):
    rows = table(spark, d, "article").where("url <> ''").where(listing.in_window(F.col("pub_date"), SINCE, None))
    return listing.keep_first(rows, ["source_key", "url"]).select("arrival", "source_key", "url")


@query("win04_best_attempt", "SELECT article_id, attempt_id, tier, chars FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY ok DESC NULLS LAST, chars DESC NULLS LAST, tried_at ASC NULLS LAST, attempt_id) AS k FROM attempt) WHERE k = 1")
def win04(spark, d):
    return tries.best(table(spark, d, "attempt")).select("article_id", "attempt_id", "tier", "chars")


@query("win05_versions", "SELECT url, arrival, fetched_at, row_number() OVER w AS version, lag(arrival) OVER w AS before FROM article WHERE url <> '' WINDOW w AS (PARTITION BY url ORDER BY fetched_at ASC NULLS FIRST, arrival)")
def win05(spark, d):
    return ledger.version_chain(table(spark, d, "article")).withColumn("version", F.col("version").cast("long"))


@query("lim01_source_cap", "SELECT arrival FROM (SELECT a.arrival, row_number() OVER (PARTITION BY source_key ORDER BY arrival) AS k, CASE WHEN coalesce(max_items, 0) = 0 THEN 20 ELSE max_items END AS most FROM article a JOIN source_registry USING (source_key)) WHERE k <= most")
def lim01(spark, d):
    most = table(spark, d, "source_registry").select("source_key", F.coalesce(F.nullif("max_items", F.lit(0)), F.lit(20)).alias("most"))
    ceiling = most.agg(F.max("most")).first()[0]
    return listing.cap(table(spark, d, "article").join(most, "source_key"), "source_key", F.col("most"), ceiling=ceiling).select("arrival")


@query("lim02_fetch_queue", "SELECT arrival, turn FROM (SELECT arrival, source_key, row_number() OVER (PARTITION BY source_key ORDER BY arrival) AS turn, fetch_status FROM article) WHERE fetch_status = 'listing_only' ORDER BY turn, source_key, arrival LIMIT 40")
def lim02(spark, d):
    return listing.queue(table(spark, d, "article"), 40, eligible=F.col("fetch_status") == "listing_only").select("arrival", F.col("turn").cast("long").alias("turn"))


@query("set01_union", "SELECT docid, doctitle FROM nfra_detail UNION ALL SELECT docid, doctitle FROM detail_1001")
def set01(spark, d):
    return table(spark, d, "nfra_detail").select("docid", "doctitle").unionByName(table(spark, d, "detail_1001").select("docid", "doctitle"))


@query("set04_identity")
def set04(spark, d):
    return identity.identity(table(spark, d, "article")).select("arrival", "group_id", "group_size", "kept_row", "is_kept")


@query("set04_dropped")
def set04_dropped(spark, d):
    return identity.dropped(table(spark, d, "article"))


@query("set05_unknown_citations", "SELECT DISTINCT c.claim_id, c.url FROM (SELECT claim_id, unnest(evidence) AS url FROM claim) c WHERE NOT EXISTS (SELECT 1 FROM article a WHERE a.url = c.url)")
def set05(spark, d):
    return audit.unknown_citations(table(spark, d, "claim"), table(spark, d, "article"))


# Audit


# Validation


# State across runs; windows over a stream are an extension of our own


@query("stm_event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM (SELECT DISTINCT * FROM events) GROUP BY 1, 2")
def stm_windows(spark, d):
    from evidentia.streaming.windows import hourly

    return hourly(table(spark, d, "events").distinct())


@query("set03_attempt_slices", "SELECT article_id, count(*) AS n FROM (SELECT DISTINCT * FROM attempt) GROUP BY 1")
def set03(spark, d):
    return tries.by_article(table(spark, d, "attempt")).select("article_id", F.size("attempts").cast("long").alias("n"))


# Connectors, by round trips through their formats


def _escaped(c: str):
    return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query("src05_feed", "SELECT arrival, left(regexp_replace(title, '^[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}\\x{85}]+|[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}\\x{85}]+$', '', 'g'), 300) AS title, url AS link, pub_date AS date FROM article WHERE length(regexp_replace(title, '^[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}\\x{85}]+|[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}\\x{85}]+$', '', 'g')) >= 8 AND url <> ''")
def src05(spark, d):
    from evidentia.sources.feeds import feed

    item = F.concat(F.lit("<rss><channel><item><title>"), _escaped("title"), F.lit("</title><link>"), _escaped("url"), F.lit("</link><pubDate>"), F.coalesce(F.date_format("pub_date", "yyyy-MM-dd"), F.lit("")), F.lit("</pubDate></item></channel></rss>"))
    return feed(spread(table(spark, d, "article")).where("title is not null and url <> ''").select("arrival", "url", item.alias("payload"))).select("arrival", "title", "link", "date")


@query("src06_sitemap", f"SELECT arrival, url AS link, pub_date AS date FROM article WHERE url <> '' AND regexp_matches(url, '/[a-z]+/') AND (pub_date IS NULL OR pub_date >= DATE '{SINCE}')")
def src06(spark, d):
    from evidentia.sources.feeds import sitemap

    block = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), _escaped("url"), F.lit("</loc><lastmod>"), F.coalesce(F.date_format("pub_date", "yyyy-MM-dd"), F.lit("")), F.lit("</lastmod></url></urlset>"))
    captured = spread(table(spark, d, "article")).where("url <> ''").select("arrival", block.alias("payload"))
    return sitemap(captured, pattern="/[a-z]+/", since=SINCE).select("arrival", "link", "date")


_LINK_TEXT = f"trim(regexp_replace(regexp_replace(docno, '[\\x{{200b}}\\x{{feff}}]', '', 'g'), '{text.WS}+', ' ', 'g'))"


@query("src04_html_listing", f"SELECT arrival, url AS link FROM article WHERE url <> '' AND length({_LINK_TEXT}) >= 8 AND NOT ends_with({_LINK_TEXT}, '>>')")
def src04(spark, d):
    from evidentia.sources.listings import html_links

    rows = spread(table(spark, d, "article")).where("url <> '' and docno <> ''")
    page = F.concat(F.lit("<html><body><nav><a href='/x'>short</a></nav><ul><li><a href='"), F.col("url"), F.lit("'>"), _escaped("docno"), F.lit("</a></li></ul></body></html>"))
    return html_links(rows.select("arrival", F.concat("url", F.lit("#"), F.col("arrival").cast("string")).alias("url"), page.alias("payload"))).select("arrival", "link")


@query("htm05_bodies")
def htm05(spark, d):
    from evidentia.functions.html import extracted

    rows = table(spark, d, "nfra_detail").where("docclob <> ''").repartition(spark.sparkContext.defaultParallelism)
    return rows.select("docid", extracted(F.col("docclob"), least=100).alias("x")).select("docid", "x.title", F.length("x.text").alias("chars"), "x.how")


@query("snk03_archive", "SELECT arrival, md5(concat('## ', coalesce(nullif(title, ''), '-'), chr(10), chr(10), '- ', coalesce(nullif(url, ''), '-'), chr(10), '- ', coalesce(nullif(source, ''), '-'), chr(10), '- ', coalesce(CAST(pub_date AS VARCHAR), '-'), chr(10), '- ', coalesce(nullif(fetch_status, ''), '-'), chr(10), chr(10), CASE WHEN coalesce(text, '') = '' THEN concat('(no text) ', coalesce(notes, '')) ELSE text END, chr(10))) AS digest FROM article")
def snk03(spark, d):
    from evidentia.operators.snapshots import archive_sections

    return archive_sections(spread(table(spark, d, "article"))).select("arrival", F.md5("section").alias("digest"))


@query("prj14_attempt_counts", "SELECT a.arrival, coalesce(n, 0) AS tries FROM article a LEFT JOIN (SELECT article_id, count(*) AS n FROM (SELECT DISTINCT * FROM attempt) GROUP BY 1) USING (article_id)")
def prj14(spark, d):
    per = table(spark, d, "attempt").distinct().groupBy("article_id").agg(F.count("*").alias("n"))
    return table(spark, d, "article").join(per, "article_id", "left").select("arrival", F.coalesce("n", F.lit(0)).alias("tries"))


@query("stm05_first_deliveries", "SELECT DISTINCT attempt_id, article_id FROM attempt")
def stm05(spark, d):
    return table(spark, d, "attempt").select("attempt_id", "article_id").dropDuplicates(["attempt_id"])


# Tiers and a whole run


def _outcomes(spark, d):
    """Judged candidates of the captured details: API records from nfra_detail, pages from article. All versions are candidates."""
    from evidentia.operators import tiers

    details = table(spark, d, "nfra_detail").where("code = 200").distinct()
    payload = F.to_json(F.struct(F.struct(F.col("doctitle").alias("docTitle"), F.col("documentno").alias("documentNo"), F.col("publishdate").alias("publishDate"), F.col("docclob").alias("docClob")).alias("data")))
    captured = details.select((F.col("docid") - 5000000).alias("article_id"), payload.alias("payload"))
    articles = spread(table(spark, d, "article").where("text <> ''").select("article_id", F.col("text").alias("payload"))).distinct()
    return tiers.judged(tiers.from_api(captured)).unionByName(tiers.judged(tiers.from_html(articles)))


@query("cls04_api_tier")
def cls04(spark, d):
    return _outcomes(spark, d).where("tier = 'api'").select("article_id", "status", "pub_date", "docno", F.length("text").alias("chars"))


@query("cls10_best_outcome")
def cls10(spark, d):
    from evidentia.operators import tiers

    return tiers.best(_outcomes(spark, d)).select("article_id", "tier", "status", "method")


@query("run_collect")
def run_collect(spark, d):
    from evidentia.operators.collect import Options, collect

    run = collect(table(spark, d, "article"), _outcomes(spark, d), table(spark, d, "source_registry"), Options(since=SINCE, budget=40))
    return run.counters


# Further columns and aggregates


@query("agg11_duplicates_by_kept")
def agg11(spark, d):
    return identity.dropped(table(spark, d, "article")).groupBy("kept_row", "kept_url").agg(F.count("*").alias("n"))


@query("str05_fragments")
def str05(spark, d):
    from evidentia.operators.tiers import fragment_text

    rows = spread(table(spark, d, "detail_1001").where("docclob <> ''").select("docid", "docclob"))
    return rows.select("docid", F.length(fragment_text(F.col("docclob"))).alias("chars"))


@query("flt11_pdf_links", "SELECT attempt_id, url FROM (SELECT DISTINCT * FROM attempt) WHERE ends_with(lower(url), '.pdf') OR contains(lower(url), '.pdf?') OR contains(lower(url), '/resource/file?') OR tier = 'pdf'")
def flt11(spark, d):
    return table(spark, d, "attempt").distinct().where(urls.is_pdf(F.col("url")) | (F.col("tier") == "pdf")).select("attempt_id", "url")


@query("agg16_latency", "SELECT source_key, min(elapsed_ms) AS least, max(elapsed_ms) AS most, CAST(sum(elapsed_ms) AS BIGINT) AS total FROM (SELECT DISTINCT * FROM attempt) GROUP BY 1")
def agg16(spark, d):
    return table(spark, d, "attempt").distinct().groupBy("source_key").agg(F.min("elapsed_ms").alias("least"), F.max("elapsed_ms").alias("most"), F.sum("elapsed_ms").alias("total"))


from evidentia.plans import audits, connectors, figures  # noqa: E402, F401  they register theirs
