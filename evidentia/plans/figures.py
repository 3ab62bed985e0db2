"""Queries of figures, projections and text columns through the library, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import documents, text
from evidentia.operators import audit, figures, ledger, report, snapshots
from evidentia.plans.queries import _BLOCKED, _CITED, _LATEST, _NAV, _TRIM, _q, query
from evidentia.session import spread, table


@query("flt13_conclusions", "SELECT arrival, fetch_status = 'full' AS core, fetch_status IN ('full', 'partial') AS some FROM article")
def flt13(spark, d):
    return table(spark, d, "article").select("arrival", figures.core_allowed(F.col("fetch_status")).alias("core"), figures.any_allowed(F.col("fetch_status")).alias("some"))


#: Pages of short lines, as menus are: each character of a title on a line of its own.
_PAGES = "(SELECT arrival, regexp_replace(left(title, 40), '(.)', '\\1' || chr(10), 'g') AS text FROM article WHERE title IS NOT NULL)"


@query("flt10_navigation", f"SELECT arrival FROM {_PAGES} WHERE {_NAV}")
def flt10(spark, d):
    pages = table(spark, d, "article").where("title is not null").select("arrival", F.regexp_replace(F.left("title", F.lit(40)), "(.)", "$1\n").alias("text"))
    return pages.where(documents.is_navigation(F.col("text"))).select("arrival")


#: Pages of an application shell: a short text and markers that a script leaves.
_SHELL = "concat('<div id=\"app\"></div>', coalesce(title, ''))"


@query("flt09_shells", f"SELECT arrival, length(coalesce(text, '')) < 200 AS shell FROM article WHERE {_SHELL} IS NOT NULL")
def flt09(spark, d):
    page = F.concat(F.lit('<div id="app"></div>'), F.coalesce("title", F.lit("")))
    return table(spark, d, "article").select("arrival", documents.is_shell(page, F.coalesce("text", F.lit(""))).alias("shell"))


@query("lim04_statuses", f"SELECT arrival, CASE WHEN {_BLOCKED} IS NOT NULL THEN 'blocked' WHEN length(coalesce(text, '')) < 200 THEN 'listing_only' WHEN {_NAV} THEN 'listing_only' WHEN length(text) >= 900 THEN 'partial' ELSE 'full' END AS status FROM article")
def lim04(spark, d):
    return spread(table(spark, d, "article").select("arrival", "text")).select("arrival", documents.status(F.lit(""), F.col("text"), 200, 900).alias("status"))


@query("jn01_article_source", "SELECT a.arrival, s.name AS source_name, s.layer AS source_layer FROM article a JOIN source_registry s USING (source_key)")
def jn01(spark, d):
    return figures.with_source(table(spark, d, "article"), table(spark, d, "source_registry")).select("arrival", "source_name", "source_layer")


@query("jn02_first_seen", "SELECT a.arrival, least(a.first_seen, l.seen) AS first_seen FROM article a LEFT JOIN (SELECT url, min(first_seen) AS seen FROM article WHERE url <> '' GROUP BY url) l USING (url)")
def jn02(spark, d):
    rows = table(spark, d, "article")
    return figures.first_seen(rows, rows).select("arrival", "first_seen")


@query("win06_first_seen", "SELECT url, min(CAST(fetched_at AS DATE)) AS first_fetched FROM article GROUP BY 1")
def win06(spark, d):
    return figures.first_fetched(table(spark, d, "article"))


@query("agg03_ledger_rate", "SELECT count(*) AS total, count(DISTINCT url) AS urls, round(avg((fetch_status = 'full')::INT), 4) AS rate FROM article")
def agg03(spark, d):
    return figures.ledger_rate(table(spark, d, "article"))


@query("agg04_evidence_counts", "SELECT coalesce(fetch_status, 'invalid') AS fetch_status, count(*) AS n FROM article GROUP BY 1")
def agg04(spark, d):
    return figures.evidence_counts(table(spark, d, "article"))


@query("agg05_coverage", "SELECT array_to_string(list_sort(list_distinct(list(region))), ',') AS regions, array_to_string(list_sort(list_distinct(list(layer))), ',') AS layers, array_to_string(list_sort(list(source_key)), ',') AS keys FROM source_registry WHERE enabled")
def agg05(spark, d):
    return figures.coverage(table(spark, d, "source_registry"))


@query("agg06_citations", "SELECT count(DISTINCT url) AS cited, count(DISTINCT CASE WHEN known THEN url END) AS known, count(DISTINCT CASE WHEN NOT known THEN url END) AS unknown FROM (SELECT c.url, EXISTS (SELECT 1 FROM article a WHERE a.url = c.url) AS known FROM (SELECT unnest(evidence) AS url FROM claim) c)")
def agg06(spark, d):
    return figures.citations(table(spark, d, "claim"), table(spark, d, "article"))


_ONE_CLAIM = "(SELECT claim_id, max(struct_pack(kind := kind, importance := importance, n := len(evidence))) AS c FROM claim GROUP BY 1)"
_CORE_CLAIM = "coalesce(c.importance = 'core' AND c.kind IN ('fact', 'inference'), false)"


@query("agg08_claims", f"WITH bad AS (SELECT DISTINCT c.claim_id FROM (SELECT claim_id, unnest(evidence) AS url FROM claim) c WHERE NOT EXISTS (SELECT 1 FROM article a WHERE a.url = c.url)) SELECT c.kind AS kind, c.importance AS importance, count(*) AS claims, CAST(count_if({_CORE_CLAIM}) AS BIGINT) AS core, CAST(count_if(coalesce(b.claim_id IS NULL AND (c.n > 0 OR c.kind IN ('company', 'assumption')), false)) AS BIGINT) AS verified FROM {_ONE_CLAIM} LEFT JOIN bad b USING (claim_id) GROUP BY 1, 2")
def agg08(spark, d):
    claims = table(spark, d, "claim")
    return figures.claim_counts(claims, audit.unknown_citations(claims, table(spark, d, "article")))


@query("agg09_any_full", "SELECT source_key, bool_or(fetch_status = 'full') AS any_full, bool_and(fetch_status <> 'blocked') AS none_blocked FROM article GROUP BY 1")
def agg09(spark, d):
    return figures.by_source(table(spark, d, "article"))


@query("lim05_newest_first", "SELECT arrival, pub_date FROM article ORDER BY pub_date DESC NULLS LAST, arrival LIMIT 50")
def lim05(spark, d):
    return figures.newest(table(spark, d, "article"), 50).select("arrival", "pub_date")


@query("lim09_short_errors", "SELECT attempt_id, left(error, 200) AS error FROM (SELECT DISTINCT * FROM attempt) WHERE error <> ''")
def lim09(spark, d):
    return figures.short_errors(table(spark, d, "attempt").distinct()).select("attempt_id", "error")


@query("str04_halved", "SELECT arrival, translate(docno, '０１２３４５６７８９（）〔〕［］', '0123456789()[][]') AS docno FROM article WHERE docno <> ''")
def str04(spark, d):
    return table(spark, d, "article").where("docno <> ''").select("arrival", documents.halved(F.col("docno")).alias("docno"))


@query("str13_paragraphs", r"SELECT doc_id, len(regexp_split_to_array(text, '\n\s*\n')) AS paragraphs FROM documents WHERE text IS NOT NULL")
def str13(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(report.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


@query("str15_source_dirs", "SELECT DISTINCT source_key, left(regexp_replace(coalesce(nullif(source_key, ''), source, ''), '[^\\p{L}\\p{M}\\p{N}_-]+', '_', 'g'), 40) AS dir FROM article")
def str15(spark, d):
    return table(spark, d, "article").select("source_key", snapshots.source_dir(F.col("source_key"), F.col("source")).alias("dir")).distinct()


@query("tok02_docno_tokens", f"SELECT DISTINCT claim_id, unnest(regexp_extract_all(text, {_q(audit.DOCNO)})) AS token FROM claim")
def tok02(spark, d):
    return table(spark, d, "claim").select("claim_id", F.explode(F.regexp_extract_all("text", F.lit(audit.DOCNO), 0)).alias("token")).distinct()


_META = ", ".join(f"{c} := {c}" for c in sorted(snapshots.META))


@query("hsh03_version_hash", f"SELECT arrival, left(sha256(CAST(to_json(struct_pack({_META})) AS VARCHAR)), 12) AS version FROM article")
def hsh03(spark, d):
    rows = table(spark, d, "article")
    return rows.select("arrival", snapshots.meta_hash(rows).alias("version"))


@query("num01_plain_numbers", r"SELECT arrival, md5(regexp_replace(regexp_replace(text, '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g')) AS digest FROM article WHERE text IS NOT NULL")
def num01(spark, d):
    return spread(table(spark, d, "article").select("arrival", "text")).where("text is not null").select("arrival", F.md5(audit.plain_numbers(F.col("text"))).alias("digest"))


_VERSIONS = f"""WITH v AS (SELECT url, arrival, fetch_status, first_seen, text, row_number() OVER (PARTITION BY url ORDER BY arrival) AS k, count(*) OVER (PARTITION BY url) AS n FROM article WHERE url <> '')
SELECT url, max_by(fetch_status, arrival) AS fetch_status, min(first_seen) AS first_seen, CAST(max(n) - 1 AS BIGINT) AS n_history, max_by(left(sha256(concat(url, chr(10), coalesce(text, ''))), 16), arrival) AS snapshot_id FROM v GROUP BY url"""


@query("snk04_upsert", _VERSIONS)
def snk04(spark, d):
    after = ledger.folded(snapshots.with_paths(table(spark, d, "article").where("url <> ''")))
    return after.select("url", "fetch_status", "first_seen", F.size("history").cast("long").alias("n_history"), "snapshot_id")


@query("snk01_paths", "SELECT arrival, concat('snapshots/', coalesce(strftime(coalesce(pub_date, first_seen), '%Y'), 'unknown-date'), '/', coalesce(strftime(coalesce(pub_date, first_seen), '%Y-%m'), 'unknown-date'), '/', left(regexp_replace(coalesce(nullif(source_key, ''), source, ''), '[^\\p{L}\\p{M}\\p{N}_-]+', '_', 'g'), 40), '/', left(sha256(concat(coalesce(url, ''), chr(10), coalesce(text, ''))), 16)) AS path FROM article")
def snk01(spark, d):
    rows = snapshots.with_paths(spread(table(spark, d, "article")))
    return rows.select("arrival", F.substring_index("snapshot_path", "_", -3).alias("_"), F.expr("left(snapshot_path, length(snapshot_path) - 46)").alias("path")).drop("_")


@query("src17_snapshot_texts", f"SELECT url, md5(coalesce(text, '')) AS digest FROM {_LATEST}")
def src17(spark, d):
    index, kept = report.index_of(spread(table(spark, d, "article")))
    return snapshots.snapshot_texts(index, kept).select("url", F.md5("text").alias("digest"))


#: A path that leads out of the archive wherever the status is not full.
_PATH = "CASE WHEN fetch_status = 'full' THEN 'snapshots/x' WHEN fetch_status = 'partial' THEN '../x' WHEN fetch_status = 'blocked' THEN 'C:\\x' WHEN fetch_status = 'scanned_pdf' THEN '/etc/x' END"


@query("pth01_contained", "SELECT arrival, coalesce(fetch_status = 'full', false) AS inside FROM article")
def pth01(spark, d):
    return table(spark, d, "article").select("arrival", snapshots.contained(F.expr(_PATH.replace("\\", "\\\\"))).alias("inside"))


@query("jn05_pointed", f"SELECT l.url, count(a.arrival) AS versions FROM {_LATEST} l JOIN article a USING (url) GROUP BY 1")
def jn05(spark, d):
    index, kept = report.index_of(spread(table(spark, d, "article")))
    pointed = index.select("url", "snapshot_path").join(kept.select("snapshot_path"), "snapshot_path")
    versions = kept.groupBy("url").agg(F.count("*").alias("versions"))
    return pointed.select("url").join(versions, "url")


@query("prj09_caps", f"SELECT arrival, left(regexp_replace(title, {_TRIM}), 300) AS title, left(trim(docno), 80) AS docno FROM article WHERE docno <> '' AND title IS NOT NULL AND trim(docno) <> ''")
def prj09(spark, d):
    edges = rf"^{text.WS}+|{text.WS}+$"
    rows = table(spark, d, "article").where("docno <> '' and title is not null and trim(docno) <> ''")
    return rows.select("arrival", F.left(F.regexp_replace("title", edges, ""), F.lit(300)).alias("title"), documents.docno(F.lit(""), F.col("docno")).alias("docno"))


@query("doc07_claim_changes", "WITH b AS (SELECT claim_id, max(struct_pack(t := text, k := kind, i := importance, e := list_sort(evidence))) AS v FROM claim WHERE importance = 'core' GROUP BY 1), a AS (SELECT claim_id, max(struct_pack(t := text, k := kind, i := importance, e := list_sort(evidence))) AS v FROM (SELECT * REPLACE (CASE WHEN kind = 'fact' THEN concat(text, '!') ELSE text END AS text) FROM claim WHERE kind <> 'company') GROUP BY 1) SELECT claim_id, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'withdrawn' ELSE 'revised' END AS change FROM b FULL JOIN a USING (claim_id) WHERE b.v IS NULL OR a.v IS NULL OR b.v <> a.v")
def doc07(spark, d):
    claims = table(spark, d, "claim")
    after = claims.where("kind <> 'company'").withColumn("text", F.when(F.col("kind") == "fact", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return audit.revisions(claims.where("importance = 'core'"), after)


@query("agg14_verifiability")
def agg14(spark, d):
    return audit.verifiability(table(spark, d, "article"), table(spark, d, "claim"))


@query("agg06_by_claim", f"SELECT claim_id, count(*) AS cited, CAST(count_if(a.article_id IS NULL) AS BIGINT) AS unknown FROM {_CITED} c LEFT JOIN {_LATEST} a USING (url) GROUP BY 1")
def agg06_by_claim(spark, d):
    return audit.claim_evidence(table(spark, d, "claim"), table(spark, d, "article")).groupBy("claim_id").agg(F.count("*").alias("cited"), F.count_if(F.col("article_id").isNull()).alias("unknown"))
