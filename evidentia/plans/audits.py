"""Queries of the audit of claims and of a report, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import audit, report
from evidentia.operators.snapshots import with_paths
from evidentia.plans.queries import _q, query
from evidentia.session import spread, table

#: A report as an analyst may hand it in: links known and made up, a reference label, quotations, numbers, a date of access.
REPORT = """# 监管动态

截至2024年3月1日，企业可以延期提交材料，补贴上限为500万元。[原文](https://www.lk-portal.example/policy/585.shtml)

所谓“逾期未交的，可缩短报告周期”，“本段引文从未出现在任何正文之中”。见[甲]。

> 抽查比例不低于

来源：https://www.lk-portal.example/ 与 https://made-up.example/nowhere 。访问日期：2026-09-15。依据东财办〔2031〕999号，门槛为 2026-09-15 起的77777万元。

[甲]: https://www.lk-portal.example/doc/767
"""
_CITED_URLS = ["https://www.lk-portal.example/policy/585.shtml", "https://made-up.example/nowhere", "https://www.lk-portal.example/doc/767"]


def _index(spark, d):
    """An index and snapshots that disagree where a URL has several versions: the index is of the first, the snapshot of the last."""
    rows = with_paths(spread(table(spark, d, "article")).where("url <> ''"))
    last = rows.groupBy("url").agg(F.max_by(F.struct("text", "snapshot_id", "fetch_status", "evidence_layer"), "arrival").alias("v"))
    first = rows.groupBy("url").agg(F.min_by(F.struct("snapshot_id", "content_hash", "fetch_status", F.col("evidence_layer").alias("layer")), "arrival").alias("v"), F.min_by("fetch_status", "arrival").alias("s"))
    path = F.when(F.col("s") == "blocked", F.lit("../outside")).otherwise(F.concat(F.lit("snapshots/"), F.sha2("url", 256)))
    index = first.select("url", path.alias("snapshot_path"), "v.*")
    return index, last.select(F.concat(F.lit("snapshots/"), F.sha2("url", 256)).alias("snapshot_path"), "url", "v.*")


_GATES = """
WITH f AS (SELECT url, min_by(struct_pack(text := coalesce(text, ''), s := fetch_status, l := evidence_layer), arrival) AS v FROM article WHERE url <> '' GROUP BY 1),
z AS (SELECT url, max_by(struct_pack(text := text, s := fetch_status, l := evidence_layer), arrival) AS v FROM article WHERE url <> '' GROUP BY 1),
c AS (SELECT DISTINCT claim_id, kind, importance, unnest(evidence) AS url FROM claim),
g AS (SELECT claim_id, c.url, coalesce(importance = 'core' AND kind IN ('fact', 'inference'), false) AS core,
CASE WHEN f.url IS NULL THEN 'missing' WHEN f.v.s = 'blocked' THEN 'no snapshot' WHEN z.v.text IS NULL THEN 'no text' WHEN f.v.text <> z.v.text THEN 'fingerprint'
WHEN NOT coalesce(regexp_matches(z.v.text, '[^\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}\\x{200b}\\x{feff}]') AND f.v.s = 'full' AND z.v.s = 'full' AND f.v.l IN ('L1', 'L2') AND z.v.l IN ('L1', 'L2'), false) THEN 'weak' END AS message
FROM c LEFT JOIN f USING (url) LEFT JOIN z USING (url))
"""


@query("aud_c4_gates", f"{_GATES} SELECT claim_id, url, CASE WHEN message = 'missing' THEN 'C1' ELSE 'C4' END AS \"check\", CASE WHEN message <> 'weak' OR core THEN 'error' ELSE 'warn' END AS level, message FROM g WHERE message IS NOT NULL")
def aud_c4(spark, d):
    return audit.evidence(table(spark, d, "claim"), *_index(spark, d)).where("check is not null").drop("text")


@query("aud_c4_strength", "SELECT claim_id, url, CASE WHEN message <> 'weak' THEN 'error' WHEN coalesce(importance = 'core' AND kind IN ('fact', 'inference'), false) THEN 'error' ELSE 'warn' END AS level, message FROM (SELECT c.*, CASE WHEN a.article_id IS NULL THEN 'missing' WHEN coalesce(a.text, '') = '' THEN 'unreadable' WHEN NOT coalesce(a.fetch_status = 'full' AND a.evidence_layer IN ('L1', 'L2'), false) THEN 'weak' END AS message FROM (SELECT DISTINCT claim_id, kind, importance, unnest(evidence) AS url FROM claim) c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, arrival DESC) AS k FROM article WHERE url <> '') WHERE k = 1) a USING (url)) WHERE message IS NOT NULL")
def aud_c4_plain(spark, d):
    return audit.strength(table(spark, d, "claim"), table(spark, d, "article"))


@query("aud_c4_no_evidence", "SELECT DISTINCT claim_id, CASE WHEN importance = 'core' THEN 'error' ELSE 'warn' END AS level FROM claim WHERE kind IN ('fact', 'inference') AND coalesce(len(evidence), 0) = 0")
def aud_c4_none(spark, d):
    return audit.without_evidence(table(spark, d, "claim"))


@query("aud_c2_quotes")
def aud_c2(spark, d):
    claims = table(spark, d, "claim")
    return audit.unsupported_quotes(claims, audit.bodies(claims, table(spark, d, "article")))


@query("aud_c3_tokens")
def aud_c3(spark, d):
    claims = table(spark, d, "claim")
    return audit.unsupported_tokens(claims, audit.bodies(claims, table(spark, d, "article")))


_SAID = r"""regexp_extract_all(text, '「[^」]+」|“[^”]+”|"[^"\n]+"')"""


@query("str12_quotes", f"SELECT DISTINCT claim_id, substr(q, 2, length(q) - 2) AS quote FROM (SELECT claim_id, unnest({_SAID}) AS q FROM claim WHERE kind = 'fact')")
def str12(spark, d):
    return audit.claim_quotes(table(spark, d, "claim")).select("claim_id", "quote")




@query("str12_block_quotes", "SELECT DISTINCT article_id AS claim_id, title AS quote FROM article WHERE article_id IS NOT NULL AND regexp_full_match(title, '[\\x{4e00}-\\x{9fff}A-Za-z0-9 ]*[\\x{4e00}-\\x{9fff}A-Za-z0-9]')")
def str12_blocks(spark, d):
    """Titles as quoted blocks: two lines each, then a paragraph that is none."""
    rows = table(spark, d, "article").where("article_id is not null").where(F.col("title").rlike(r"^[\x{4e00}-\x{9fff}A-Za-z0-9 ]*[\x{4e00}-\x{9fff}A-Za-z0-9]$"))
    claims = rows.select(F.col("article_id").alias("claim_id"), F.concat(F.lit("> "), "title", F.lit("\n\nx")).alias("text"), F.lit("fact").alias("kind"))
    return audit.claim_quotes(claims).select("claim_id", "quote")


@query("agg07_quotes", f"SELECT count(*) AS quotes FROM (SELECT DISTINCT claim_id, unnest({_SAID}) AS q FROM claim WHERE kind = 'fact')")
def agg07(spark, d):
    return audit.claim_quotes(table(spark, d, "claim")).agg(F.count("*").alias("quotes"))


@query("val02_claims", "SELECT DISTINCT claim_id, 'importance' AS rule FROM claim WHERE importance IS NULL OR importance NOT IN ('core', 'supporting') UNION ALL SELECT DISTINCT claim_id, 'kind' FROM claim WHERE kind IS NULL OR kind NOT IN ('fact', 'inference', 'assumption', 'company') UNION ALL SELECT DISTINCT claim_id, 'evidence' FROM (SELECT claim_id, unnest(evidence) AS u FROM claim) WHERE u IS NULL OR NOT regexp_matches(u, '^https?://[^\\s/?#]+\\S*$') UNION ALL SELECT DISTINCT claim_id, 'repeated evidence' FROM claim WHERE len(list_distinct(evidence)) < len(evidence) UNION ALL SELECT DISTINCT claim_id, 'text' FROM claim WHERE coalesce(trim(text), '') = '' UNION ALL SELECT claim_id, 'repeated' FROM claim GROUP BY 1 HAVING count(*) > 1")
def val02(spark, d):
    return audit.claim_problems(table(spark, d, "claim"))


# The report

_URLS = ", ".join(f"({_q(u)})" for u in _CITED_URLS)


@query("jn03_unknown_links", f"SELECT u AS url FROM (VALUES {_URLS}) v(u) WHERE u <> 'https://www.lk-portal.example/doc/767' AND NOT EXISTS (SELECT 1 FROM article a WHERE a.url = u) UNION SELECT u FROM (VALUES ('https://www.lk-portal.example/doc/767')) w(u) WHERE NOT EXISTS (SELECT 1 FROM article a WHERE a.url = u)")
def jn03(spark, d):
    return report.unknown_links(spark, REPORT, table(spark, d, "article"))


@query("str14_citations", f"SELECT * FROM (VALUES {_URLS}, ('https://www.lk-portal.example/')) v(url)")
def str14(spark, d):
    return report.citations(spark, REPORT).select("url").distinct()


_BARE = "regexp_replace(text, '[\\s\\p{Z}\\x{200b}\\x{feff}]+', '', 'g')"
_NEEDLES = "('逾期未交的，可缩短报告周期', '逾期未交的,可缩短报告周期'), ('本段引文从未出现在任何正文之中', '本段引文从未出现在任何正文之中'), ('抽查比例不低于', '抽查比例不低于')"


@query("aud_c2l_quotes", f"SELECT q AS quote FROM (VALUES {_NEEDLES}) v(q, n) WHERE length(n) >= 8 AND NOT EXISTS (SELECT 1 FROM article WHERE contains(replace({_BARE}, '，', ','), n))")
def aud_c2l(spark, d):
    return report.unfound_quotes(spark, REPORT, spread(table(spark, d, "article")))


@query("aud_c3l_tokens", "SELECT * FROM (VALUES ('docno', '依据东财办〔2031〕999号'), ('amount', '77777万元')) v(label, token)")
def aud_c3l(spark, d):
    """What no text can hold; the date of access is let pass, and the amount that texts do hold is supported."""
    return report.unfound_tokens(spark, REPORT, spread(table(spark, d, "article"))).where("token <> '补贴上限为500万元' and token not in ('500万元', '上限为500万元')")


@query("aud_c4l_strength", "WITH w AS (SELECT concat_ws(':', coalesce(source, 'None'), url) AS n, url FROM article WHERE fetch_status IN ('blocked', 'scanned_pdf') ORDER BY url, n LIMIT 5) SELECT 'C4' AS \"check\", 'warn' AS level, CAST(NULL AS BIGINT) AS claim_id, concat((SELECT count(*) FROM article WHERE fetch_status IN ('blocked', 'scanned_pdf')), ' without a body: ', (SELECT string_agg(n, '; ' ORDER BY n) FROM w)) AS detail")
def aud_c4l(spark, d):
    return report.evidence_strength(table(spark, d, "article"))




@query("aud_c5a_uncovered", "SELECT DISTINCT claim_id FROM claim")
def aud_c5a(spark, d):
    return report.uncovered_claims(spark, REPORT, table(spark, d, "claim").where("trim(text) <> ''"))


@query("aud_c5b_uncited", f"SELECT DISTINCT claim_id FROM claim WHERE kind IN ('fact', 'inference') AND len(list_filter(evidence, lambda u: NOT list_contains([{', '.join(_q(u) for u in [*_CITED_URLS, 'https://www.lk-portal.example/'])}], u))) > 0")
def aud_c5b(spark, d):
    return report.uncited_evidence(spark, REPORT, table(spark, d, "claim"))


@query("aud_c5c_foreign", "SELECT DISTINCT claim_id, u AS url FROM claim, (VALUES ('https://www.lk-portal.example/policy/585.shtml')) v(u) WHERE kind IN ('fact', 'inference') AND len(evidence) > 0 AND NOT list_contains(evidence, u)")
def aud_c5c(spark, d):
    """Claims that say what the report's second paragraph says, with evidence of their own."""
    claims = table(spark, d, "claim").withColumn("text", F.lit("企业可以延期提交材料"))
    return report.foreign_citations(spark, REPORT, claims)


@query("aud_findings")
def aud_findings(spark, d):
    """All findings of the strict audit of the report."""
    return report.findings(spark, REPORT, table(spark, d, "claim"), *report.index_of(spread(table(spark, d, "article"))))


@query("aud_verdict", "SELECT false AS ok, 'strict' AS audit_mode, false AS strict_passed, true AS manual_review_required")
def aud_verdict(spark, d):
    return report.verdict(aud_findings(spark, d)).select("ok", "audit_mode", "strict_passed", "manual_review_required")
