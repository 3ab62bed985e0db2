"""The core operators on small fixtures and against brute force."""

import datetime as dt
import random
import zlib

import pytest
from pyspark.sql import functions as F

from evidentia.functions import dates, documents, html, text, urls
from evidentia.functions import bytes as raw
from evidentia.operators import attempts, audit, components, identity, ledger, listing, report, snapshots
from evidentia.sources import feeds, listings, records, registry, templates


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("发布时间：2024-03-05 与 2023年1月2日", dt.date(2024, 3, 5)), ("自２０２４年３月１２日起", dt.date(2024, 3, 12)), ("on 2024/2/30 or 5 March 2023", dt.date(2023, 3, 5)), ("Sept. 9, 2021", dt.date(2021, 9, 9)), ("2024-13-01", None), ("", None), (None, None),
    ],
)
def test_any_date(spark, body, want):
    assert one(spark, body, dates.any_date(F.col("x")))[0] == want


def test_other_dates(spark):
    got = one(spark, "本文件自2026年10月1日起施行\n2026年9月15日", dates.effective_date(F.col("x")), dates.publication_date(F.col("x")))
    assert tuple(got) == (dt.date(2026, 10, 1), dt.date(2026, 9, 15))
    assert one(spark, "1700000000000", dates.listed_date(F.col("x")))[0] == dt.date(2023, 11, 14)
    assert one(spark, "/art/20240131/x.html", dates.date_from_url(F.col("x"), r"/(\d{8})/"))[0] == dt.date(2024, 1, 31)


def test_numbers_and_issuers(spark):
    got = one(spark, "来源：东岭市 财务局\n东财办〔2024〕 12 号", documents.docno(F.col("x")), documents.issuer(F.col("x")), documents.docno(F.col("x"), F.lit(" A-1 ")))
    assert tuple(got) == ("东财办〔2024〕 12 号", "东岭市财务局", "A-1")


@pytest.mark.parametrize(
    ("page", "body", "want"),
    [("", "长" * 300, "full"), ("", "短", "listing_only"), ("<title>Just a moment...</title>", "长" * 300, "blocked"), ('<div id="app"></div>', "", "blocked"), ("", "\n".join(["首页导航"] * 60), "listing_only"), ("", None, "listing_only")],
)
def test_status(spark, page, body, want):
    assert one(spark, body, documents.status(F.lit(page), F.col("x")))[0] == want


def test_text_and_urls(spark):
    assert one(spark, "Ａ　b​c\n", text.fold(F.col("x")))[0] == "Abc"
    assert one(spark, " a  b \n\n" + "A" * 50 + "\nc", text.normalized(F.col("x")))[0] == "a b\nc"
    assert one(spark, "http://a.example/p?utm_x=1&id=2&spm=3", urls.cleaned(F.col("x")))[0] == "http://a.example/p?id=2"
    assert one(spark, "../x.html", urls.joined(F.lit("http://a.example/b/c/"), F.col("x")))[0] == "http://a.example/b/x.html"


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(999, k) for k in range(600, 700)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


ARTICLE = "article_id long, arrival long, url string, source_key string, docno string, issuer string, text string, fetch_status string, evidence_layer string, fetched_at timestamp"


def test_identity(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [
        (1, 1, "u1", "s", None, None, "甲", "partial", "L1", at), (2, 2, "u1", "s", None, None, "乙", "full", "L2", at), (3, 3, "u2", "s", "文1", "局", "乙 ", "full", "L1", at), (4, 4, "u3", "s", "文１", "局", "丙", "partial", "L1", at),
        (5, 5, "", "s", "无", "局", "", "full", "L1", at), (6, 6, "", "s", "无", "局", None, "full", "L1", at),
    ]
    got = {r.arrival: (r.group_id, r.kept_row) for r in identity.identity(spark.createDataFrame(rows, ARTICLE)).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (1, 3), 5: (5, 5), 6: (6, 6)}
    assert {(r.arrival, r.kept_url) for r in identity.dropped(spark.createDataFrame(rows, ARTICLE)).collect()} == {(1, "u2"), (2, "u2"), (4, "u2")}


def test_listing_operators(spark):
    rows = [(i, "abc"[i % 3], "full" if i % 2 else "listing_only") for i in range(12)]
    df = spark.createDataFrame(rows, "arrival long, source_key string, fetch_status string")
    assert [r.arrival for r in listing.queue(df, 4, eligible=F.col("fetch_status") == "listing_only").collect()] == [0, 2, 4, 6]
    assert listing.cap(df, "source_key", 2).count() == 6
    assert listing.keep_first(df, ["source_key"]).count() == 3


def test_ledger_upsert_keeps_history(spark):
    schema = "url string, snapshot_id string, snapshot_path string, fetch_status string, content_hash string, first_seen date, fetched_at timestamp, history " + ledger.HISTORY
    day, at = dt.date(2024, 1, 1), dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", "1", "p1", "partial", "h", day, at, []), ("b", "1", "p2", "full", "h", day, at, []), ("d", "5", "p3", "partial", "h", day, at, [])], schema)
    new = spark.createDataFrame([("a", "2", "p4", "full", "h2", dt.date(2024, 2, 1), at, []), ("c", "9", "p5", "full", "h", day, at, []), ("d", "5", "p6", "full", "h", day, at, [])], schema)
    after = ledger.upserted(old, new)
    got = {r.url: (r.snapshot_id, r.fetch_status, r.first_seen, [tuple(h) for h in r.history]) for r in after.collect()}
    # The same body with another status (d) is another acquisition: the old one is kept, with all its five fields.
    assert got == {"a": ("2", "full", day, [("1", "p1", "partial", "h", at)]), "b": ("1", "full", day, []), "c": ("9", "full", day, []), "d": ("5", "full", day, [("5", "p3", "partial", "h", at)])}
    again = {r.url: len(r.history) for r in ledger.upserted(after, new).collect()}
    assert again == {"a": 1, "b": 0, "c": 0, "d": 1}


def test_attempts(spark):
    schema = "attempt_id long, article_id long, tier string, status int, ok boolean, chars int, error string, elapsed_ms int, request_id int, url string, tried_at timestamp"
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 1, "html", 500, False, None, "e", 5, 1, "u", at), (2, 1, "pdf", 200, True, 90, None, 5, 1, "u", at), (3, 1, "api", 200, True, 300, None, 5, 2, "u", at), (4, 2, "html", 404, False, 0, "e", 5, 1, "v", at)]
    df = spark.createDataFrame(rows, schema)
    assert [r.attempt_id for r in attempts.unmended(df).collect()] == [4]
    assert {r.article_id: r.attempt_id for r in attempts.best(df).collect()} == {1: 3, 2: 4}
    assert {r.article_id: len(r.attempts) for r in attempts.by_article(df.union(df)).collect()} == {1: 3, 2: 1}


def evidence(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 1, "http://a.example/1", "s", None, None, "限额为1,500万元。自2026年1月2日起，依据东财办〔2024〕12号，“应当逐级复核”。", "full", "L1", at), (2, 2, "http://a.example/2", "s", None, None, "另一篇", "partial", "L3", at)]
    claims = [
        (1, "限额为1500万元，2026/1/2起，根据东财办〔2024〕12号，“应当逐级复核”。", "fact", "core", ["http://a.example/1"]), (2, "限额为500万元。", "fact", "core", ["http://a.example/1"]),
        (3, "“从未说过的话”", "fact", "supporting", ["http://a.example/2"]), (4, "不在", "fact", "core", ["http://x.example/9"]), (5, "数字77", "inference", "core", []),
    ]
    return spark.createDataFrame(claims, "claim_id long, text string, kind string, importance string, evidence array<string>"), spark.createDataFrame(rows, ARTICLE)


def test_audit(spark):
    claims, articles = evidence(spark)
    assert {(r.claim_id, r.label, r.token) for r in audit.unsupported_tokens(claims, audit.bodies(claims, articles)).collect()} == {(2, "amount", "500万元"), (2, "number", "500")}
    assert [(r.claim_id, r.quote) for r in audit.unsupported_quotes(claims, audit.bodies(claims, articles)).collect()] == [(3, "从未说过的话")]
    assert {(r.claim_id, r.level, r.message) for r in audit.strength(claims, articles).collect()} == {(3, "warn", "weak"), (4, "error", "missing")}
    assert tuple(audit.core_coverage(claims, articles).first()) == (4, 2, 0.5)


def test_report(spark):
    claims, articles = evidence(spark)
    body = "限额为1500万元，2026/1/2起，根据东财办〔2024〕12号，“应当逐级复核”。[来源][A] http://a.example/1\n\n另见 http://a.example/ 与 http://made.example/up 。\n\n> 限额为1,500万元。自2026年\n\n「这是一句编造的引文」\n\n[A]: http://a.example/2"
    assert [r.url for r in report.unknown_links(spark, body, articles).collect()] == ["http://made.example/up"]
    # A date is compared as a whole, so a quotation that breaks off inside one is not found.
    assert {r.quote for r in report.unfound_quotes(spark, body, articles).collect()} == {"这是一句编造的引文", "这是一句编造的引文」", "限额为1,500万元。自2026年"}
    assert [(r.claim_id, r.url) for r in report.foreign_citations(spark, body, claims).collect()] == [(1, "http://a.example/2")]
    assert {r.claim_id for r in report.uncovered_claims(spark, body, claims).collect()} == {2, 3, 4, 5}
    found = report.findings(spark, body, claims, *report.index_of(articles))
    verdict = report.verdict(found).first()
    assert verdict.ok is False and not verdict.strict_passed and {r.check for r in found.collect()} == {"audit", "C1", "C2", "C3", "C4", "C5"}
    stats = report.statistics(spark, body, claims, *report.index_of(articles), found).first()
    assert (stats.cited_urls, stats.known_urls, stats.claims_total, stats.core_claims) == (4, 2, 5, 4) and stats.evidence_counts == {"full": 1, "partial": 1} and stats.full_text_rate == 0.5
    legacy = report.legacy_findings(spark, body, articles, "warn")
    assert {(r.check, r.level) for r in legacy.collect()} == {("audit", "warn"), ("C1", "warn"), ("C2", "error"), ("C3", "error")}  # the number with the word before it


URL_A, URL_B = "https://example.gov/a", "https://example.gov/b"


def audited(spark, text, bodies, evidence=(URL_A,), report_text=None, kind="fact", importance="core", change=None):
    """The checks that find something in one claim; bodies by URL; change alters index or snapshots."""
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, i, u, "s", None, None, t, "full", "L1", at) for i, (u, t) in enumerate(bodies.items())], ARTICLE)
    claims = spark.createDataFrame([(1, text, kind, importance, list(evidence))], "claim_id long, text string, kind string, importance string, evidence array<string>")
    index, snapshots_ = report.index_of(rows)
    if change:
        index, snapshots_ = change(index, snapshots_)
    found = report.findings(spark, text if report_text is None else report_text, claims, index, snapshots_)
    return {(r.check, r.level) for r in found.where("check <> 'audit'").collect()}


def test_report_quotes_are_audited_against_the_claim(spark):
    bodies = {URL_A: "企业应当提交年度报告。", URL_B: "企业可以延期提交材料。"}
    text = "企业可以延期提交材料。"
    for marked in ("> " + text, "“" + text + "”", '"' + text + '"'):
        assert ("C2", "error") in audited(spark, text, bodies, report_text=marked)
        assert audited(spark, text, bodies, (URL_B,), report_text=marked) == set()
    two = "第一行内容如下\n第二行内容如下"
    assert audited(spark, "如下：\n> " + two.replace("\n", "\n> "), {URL_A: two}) == set()


def test_quotes_compare_dates_in_one_spelling(spark):
    assert audited(spark, "规定“自2026年1月2日起施行”。", {URL_A: "本办法自2026-01-02起施行。"}) == set()


def test_fingerprints_must_match_the_body(spark):
    bodies = {URL_A: "企业应当提交年度报告。", URL_B: "另一篇。"}
    text = "企业应当提交年度报告。"
    set_ = lambda c, v: lambda df: df.withColumn(c, F.lit(v).cast(df.schema[c].dataType))
    assert audited(spark, text, bodies) == set()
    for alter in (lambda i, s: (set_("content_hash", "x")(i), s), lambda i, s: (set_("snapshot_id", "x")(i), s), lambda i, s: (i, set_("snapshot_id", "x")(s)), lambda i, s: (i, set_("text", "改过的")(s))):
        assert ("C4", "error") in audited(spark, text, bodies, change=alter)
    for alter in (lambda i, s: (i, set_("fetch_status", "partial")(s)), lambda i, s: (i, set_("evidence_layer", "L3")(s)), lambda i, s: (set_("fetch_status", "partial")(i), s), lambda i, s: (set_("layer", "L3")(i), s)):
        assert audited(spark, text, bodies, change=alter) == {("C4", "error")}
        assert audited(spark, text, bodies, change=alter, importance="supporting") == {("C4", "warn")}
    # Paths that lead out, no snapshot, and a snapshot of another URL.
    assert ("C4", "error") in audited(spark, text, bodies, change=lambda i, s: (set_("snapshot_path", "../outside")(i), s))
    assert ("C4", "error") in audited(spark, text, bodies, change=lambda i, s: (i, s.limit(0)))
    assert ("C1", "error") in audited(spark, text, bodies, change=lambda i, s: (set_("snapshot_path", "snapshots/z")(i), set_("snapshot_path", "snapshots/z")(s.where(F.col("url") == URL_B))))
    # An index that says full doesn't make an empty body readable; nor is a missing hash a match.
    assert ("C4", "error") in audited(spark, text, {URL_A: "\n\u200b "})


def test_evidence_must_be_cited(spark):
    bodies = {URL_A: "补贴500万元。", URL_B: "另一篇。"}
    text = "补贴500万元。"
    assert audited(spark, text, bodies, report_text=f"{text}[原文]({URL_A})") == set()
    assert audited(spark, text, bodies, report_text=f"{text}\n\n来源库：{URL_B}") == {("C5", "error")}
    assert ("C5", "error") in audited(spark, text, bodies, report_text=f"{text}[原文][wrong]\n\n[wrong]: {URL_B}\n\n来源库：{URL_A}")


def test_legacy_checks(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, 1, URL_A, "s", None, None, "补贴上限为500万元，自2026年11月1日起施行。", "full", "L1", at), (2, 2, URL_B, "s", None, None, "", "blocked", "L1", at)], ARTICLE)
    body = f"补贴500万元，2026-11-01 起，依据东财办〔2031〕9号，访问日期：2027-01-01，见 2027-01-01 与 2028-02-02，共计9999元。{URL_A}"
    assert {tuple(r) for r in report.unfound_tokens(spark, body, rows).collect()} == {("docno", "依据东财办〔2031〕9号"), ("amount", "9999元"), ("amount", "补贴500万元"), ("date", "2028-02-02")}
    assert [(r.level, r.detail) for r in report.evidence_strength(rows).collect()] == [("warn", f"1 without a body: None:{URL_B}")]
    assert [r.level for r in report.evidence_strength(rows.limit(0)).collect()] == ["error"]
    assert {r.level for r in report.evidence_strength(rows.where("fetch_status = 'blocked'")).collect()} == {"warn", "error"}


def test_claims_added_revised_withdrawn(spark):
    schema = "claim_id long, text string, kind string, importance string, evidence array<string>"
    old = spark.createDataFrame([(1, "甲", "fact", "core", ["u"]), (2, "乙", "fact", "core", ["u"]), (3, "丙", "fact", "core", ["v", "u"])], schema)
    new = spark.createDataFrame([(2, "乙改", "fact", "core", ["u"]), (3, "丙 ", "fact", "core", ["u", "v"]), (4, "丁", "fact", "core", [])], schema)
    assert {tuple(r) for r in audit.revisions(old, new).collect()} == {(1, "withdrawn"), (2, "revised"), (4, "added")}


def test_sources(spark):
    rss = "<rss xmlns:d='x'><channel><item><title>一个足够长的标题在此</title><link>/a?utm_s=1&amp;id=3</link><d:date>2026-09-15</d:date><description><![CDATA[<b>sum</b>]]></description></item><item><title>短</title><link>/b</link></item></channel></rss>"
    rows = spark.createDataFrame([("http://h.example/l", rss), ("http://h.example/l", rss.replace("</channel></rss>", "<broken")), ("http://h.example/l", None)], "url string, payload string")
    got = feeds.feed(rows).collect()
    assert [(r.link, r.date, r.summary) for r in got] == [("http://h.example/a?id=3", dt.date(2026, 9, 15), "sum")] * 2
    page = "<nav><a href='/n'>导航链接很长很长很长</a></nav><ul class='list'><li><a href='2024/0131/t1.html'>关于某事项的通知全文</a></li><li><a href='2024/0131/t1.html'>关于某事项的通知重复</a></li><li><a href='x'>短</a></li></ul>"
    links = listings.html_links(spark.createDataFrame([("http://h.example/c/", page)], "url string, payload string"), selector="ul.list > li", date_pattern=r"(\d{4})/(\d{2})(\d{2})/").collect()
    assert [(r.link, r.title, r.date) for r in links] == [("http://h.example/c/2024/0131/t1.html", "关于某事项的通知全文", dt.date(2024, 1, 31))]
    payload = '{"data": {"rows": [{"docId": 7, "docTitle": "关于某事项的通知", "alt": ""}, {"docId": 8, "alt": ["第二个足够长的标题"]}]}}'
    rows = spark.createDataFrame([(payload,), ("not json",)], "payload string")
    got = records.records(rows, "payload", "data.rows", {"id": "docId", "title": "docTitle|alt"}).collect()
    assert [tuple(r) for r in got] == [("7", "关于某事项的通知"), ("8", "第二个足够长的标题")]
    assert one(spark, "v", templates.filled("a/{x}/{gone}", ["x"]), templates.filled("a/{gone}", ["x"], strict=True)) == ("a/v/", None)


def test_registry():
    good = {"key": "a", "listing": {"url": "https://a.example/{page}?s={start}", "pages": 2, "rows_per_page": 10}}
    bad = {"key": "a", "enabled": "yes", "layer": "L9", "listing": {"url": "ftp://x"}, "detail": {"tiers": ["magic"]}}
    assert registry.violations({"sources": [good]}) == []
    assert {r for _, r in registry.violations({"sources": [good, bad]})} == {"key is repeated", "enabled must be true or false", "layer is unknown", "listing.url must be http or https", "tier is unknown"}
    assert [u for u, _ in registry.page_targets(good)] == ["https://a.example/1?s=0", "https://a.example/2?s=10"]
    with pytest.raises(ValueError, match="unknown"):
        registry.select([good], ["b"])


def test_html_and_pdf():
    page = "<html><head><title>页名 - 站名</title></head><body><div class='share'>" + "分享" * 200 + "</div><div class='detail_content'><p>" + "正文。" * 100 + "</p><script>x</script></div></body></html>"
    root = html.tree(page)
    assert html.title_of(root) == "页名" and html.body_of(root) == ("正文。" * 100, "selector:div.detail_content")
    with pytest.raises(ValueError, match="selector"):
        html.select(root, "div:hover")
    assert raw.decode("政策".encode("gb18030")) == "政策" and raw.decode("é".encode("latin-1"), "latin-1") == "é"


def test_titles_and_junk():
    assert html.title_of(html.tree("<title>Rule_12 notice | Site</title>")) == "Rule_12 notice"
    assert html.title_of(html.tree("<p class='title big'>no</p><p class='title'>yes</p><title>page</title>")) == "yes"
    body = "正文。" * 100
    page = html.tree(f"<div class='share-box'>{body}x</div><div class='pages_content'>{body}</div>")
    assert html.body_of(page, ("div.share-box",)) == (body, "selector:div.pages_content")
    assert html.plain_body("<html><body><p>x</p><pre>a  b\nc</pre></body></html>") == "a b\nc" and html.plain_body("a <b>c") == "a  c"


def make_pdf(pages):
    """A file of text pages and image pages (None), with a font map for texts beyond Latin."""
    objects, last = {}, 2

    def add(body):
        nonlocal last
        last += 1
        objects[last] = body
        return last

    def stream(body, head=b""):
        packed = zlib.compress(body)
        return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n" % (len(packed), head) + packed + b"\nendstream"

    kids = []
    for text in pages:
        if text is None:
            image = add(b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /Length 3 >>\nstream\n\0\0\0\nendstream")
            own, content = b"<< /XObject << /Im1 %d 0 R >> >>" % image, b"q 400 0 0 600 72 72 cm /Im1 Do Q"
        elif text.isascii():
            font = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
            own, content = b"<< /Font << /F1 %d 0 R >> >>" % font, b"BT /F1 12 Tf 72 720 Td (" + text.encode().replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj ET"
        else:
            codes = {c: i + 1 for i, c in enumerate(dict.fromkeys(text))}
            cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange %d beginbfchar " % len(codes) + b" ".join(b"<%04X> <%s>" % (i, c.encode("utf-16-be").hex().encode()) for c, i in codes.items()) + b" endbfchar"
            font = add(b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode %d 0 R >>" % add(stream(cmap)))
            own, content = b"<< /Font << /F1 %d 0 R >> >>" % font, b"BT /F1 12 Tf [<" + b"".join(b"%04X" % codes[c] for c in text) + b">] TJ ET"
        kids.append(add(b"<< /Type /Page /Parent 2 0 R /Resources " + own + b" /Contents %d 0 R >>" % add(stream(content))))
    objects[1], objects[2] = b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % k for k in kids) + b"] >>"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % n + x + b"\nendobj\n" for n, x in objects.items()) + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


def test_pdf():
    from evidentia.functions.pdf import pdf_text

    text = "Policy (approved) requires records and quarterly reporting. " * 4
    assert pdf_text(make_pdf([text])) == (text.strip(), "full") and pdf_text(make_pdf(["政策文件" * 30])) == ("政策文件" * 30, "full")
    assert pdf_text(make_pdf([None, None])) == ("", "scanned") and pdf_text(make_pdf([""])) == ("", "failed")
    assert [pdf_text(make_pdf(x))[1] for x in ([text, None], [None, text])] == ["partial", "partial"]
    assert [pdf_text(make_pdf(["x" * n]))[1] for n in (1, 99, 100, 101)] == ["partial", "partial", "full", "full"]
    fake = b"%PDF-1.4\n1 0 obj\n<< /Subtype /Image >>\nstream\nBT (" + b"False policy text. " * 20 + b") Tj ET\nendstream\nendobj\n%%EOF\n"
    assert all(pdf_text(x) == ("", "failed") for x in (fake, make_pdf([text])[:200], b"%PDF-1.4 /Subtype /Image", b"<html>", None))


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "s", "a/b c", "t", "正文", dt.date(2024, 3, 1), None, "full")], "arrival long, url string, source string, source_key string, title string, text string, pub_date date, first_seen date, fetch_status string")
    for _ in range(2):
        snapshots.append(rows, str(tmp_path))
    kept = spark.read.parquet(str(tmp_path / "snapshots"))
    # The same acquisition gets the same path, whichever task writes it; another arrival another one.
    assert kept.count() == 2 and kept.select("snapshot_path").distinct().count() == 1 and kept.first().source_dir == "a_b_c"
    assert snapshots.with_paths(rows.withColumn("arrival", F.lit(2))).first().snapshot_path != kept.first().snapshot_path
    assert ledger.index_entry(rows.withColumn("text", F.lit("\u200b ")).withColumn("article_id", F.lit(1))).first().content_hash == ""
    index = rows.select("url", "title")
    assert snapshots.load_index(spark, str(tmp_path), index.schema).count() == 0
    snapshots.swap_index(index, str(tmp_path))
    assert snapshots.load_index(spark, str(tmp_path), index.schema).count() == 1
    with pytest.raises(ValueError, match="more than one"):
        snapshots.swap_index(index.union(index), str(tmp_path))
    assert snapshots.load_index(spark, str(tmp_path), index.schema).count() == 1
    (tmp_path / "index.json").write_text("{broken")
    with pytest.raises(ValueError, match="broken"):
        snapshots.swap_index(index, str(tmp_path))
    assert snapshots.is_contained("snapshots/x", str(tmp_path)) and not any(snapshots.is_contained(p, str(tmp_path)) for p in ("/etc", "..\\x", "a/../../x", "C:\\x", ""))


def test_replay_source(spark, tmp_path):
    from evidentia.sources.replay import Replay

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.json").write_bytes(b"{}")
    (tmp_path / "src" / "b.json").write_bytes(b"x" * 100)
    spark.dataSource.register(Replay)
    got = {r.chars: (r.source_key, r.ok, r.error) for r in spark.read.format("replay").option("path", str(tmp_path)).option("limit", "50").load().collect()}
    assert got == {2: ("src", True, None), 100: ("src", False, "too large")}


def test_streams(spark, tmp_path):
    from evidentia.streaming.windows import first_arrivals, hourly

    rows = [(i, dt.datetime(2024, 1, 1, i % 3, 5), "view", 1.0) for i in (1, 2, 3, 4, 1)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    for name, df, mode in (("hours", hourly(stream, "1 hour"), "complete"), ("firsts", first_arrivals(stream, "event_id", "ts", "1 day"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == 5 and spark.table("firsts").count() == 4


def test_entry_points(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and entry.entry(spark).count() > 0


def test_tiers(spark):
    from evidentia.operators import tiers

    body = "<p>" + "第一条　应当报送材料。" * 30 + "</p>"
    api = spark.createDataFrame([(1, '{"data": {"docTitle": "关于某事的通知", "documentNo": "东财办〔2024〕1号", "publishDate": "2024-05-06 10:00:00", "docClob": "%s"}}' % body), (2, '{"data": [{"docTitle": "短", "docClob": "短"}]}'), (3, "broken")], "article_id long, payload string")
    page = spark.createDataFrame([(1, f"<div class='article'>{body}</div>"), (2, f"<div>{body}</div>"), (4, "<title>Just a moment</title>")], "article_id long, payload string")
    outcomes = tiers.judged(tiers.from_api(api)).unionByName(tiers.judged(tiers.from_html(page)))
    got = {r.article_id: (r.tier, r.status) for r in tiers.best(outcomes).collect()}
    assert got == {1: ("api", "full"), 2: ("html", "partial"), 4: ("html", "blocked")}
    first = outcomes.where("article_id = 1 and tier = 'api'").first()
    assert first.text.startswith("关于某事的通知\n东财办〔2024〕1号\n") and first.pub_date == dt.date(2024, 5, 6)


def test_grading(spark):
    from evidentia.operators.grading import complaints

    expected = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "case_id int, n_items int")
    reviews = spark.createDataFrame([(1, 1, True, "x"), (1, 2, True, "x"), (2, 1, False, ""), (9, 1, True, "x")], "case_id int, item int, passed boolean, rationale string")
    got = {(r.case_id, r.complaint) for r in complaints(expected, reviews, "Ann", "ann ").collect()}
    assert got == {(2, "failed or ungraded"), (2, "no rationale"), (3, "case not executed"), (3, "rubric incomplete"), (9, "unknown case"), (None, "producer and reviewer must be two persons")}


def test_claims_file(tmp_path):
    from evidentia.__main__ import claims_of

    path = tmp_path / "claims.json"
    path.write_text('﻿{"schema_version": 1, "claims": [{"id": "a", "text": "t", "kind": "fact", "importance": "core", "evidence": ["http://a.example"]}]}', encoding="utf-8")
    assert claims_of(str(path)) == [(1, "a", "t", "fact", "core", ["http://a.example"])]
    for bad in ('{"schema_version": true, "claims": []}', '{"schema_version": 1, "schema_version": 1, "claims": []}', '{"schema_version": 1, "claims": [{"id": "a"}]}', '{"schema_version": NaN, "claims": []}'):
        path.write_text(bad, encoding="utf-8")
        with pytest.raises(ValueError):  # noqa: PT011
            claims_of(str(path))


def test_ledger_stream(spark, tmp_path):
    from evidentia.streaming import ledger as kept

    schema = "article_id long, arrival long, url string, source string, source_key string, pub_date date, text string, fetch_status string, first_seen date, fetched_at timestamp"
    for day, body in ((1, "甲"), (2, "乙"), (3, "乙")):
        spark.createDataFrame([(1, day, "u", "s", "s", None, body, "full", dt.date(2024, 1, day), dt.datetime(2024, 1, day))], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = kept.keep(stream, str(tmp_path), str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
    row = kept.read(spark, str(tmp_path)).first()
    assert row.first_seen == dt.date(2024, 1, 1) and len(row.history) == 2 and row.fetched_at == dt.datetime(2024, 1, 3)
    assert len(list((tmp_path / "ledger").glob("part=*/version=*"))) == 1  # only the partition that was touched, only its last version


def _articles(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "article.parquet"))
    return str(tmp_path)


def test_plain_numbers_and_listings_take_every_row(spark, tmp_path):
    import hashlib
    import re

    from evidentia.plans.queries import QUERIES

    texts = ["1,234 and 5", "items 1,2,3, and 4,5,6", "no number", ",1,", None]
    docnos = ["东财办〔2024〕12号", "东财办 〔２０２４〕１２号", "Réf: A & B <9>/2024", "short", None]
    d = _articles(spark, tmp_path, [(i, f"http://h.example/{i}", t, n) for i, (t, n) in enumerate(zip(texts, docnos, strict=True))], "arrival long, url string, text string, docno string")
    got = {r.arrival: r.digest for r in QUERIES["num01_plain_numbers"](spark, d).collect()}
    assert got == {i: hashlib.md5(re.sub("(?<=[0-9]),(?=[0-9])", "", t).encode()).hexdigest() for i, t in enumerate(texts) if t is not None}
    assert {r.arrival for r in QUERIES["src04_html_listing"](spark, d).collect()} == {0, 1, 2}


def test_upsert_folds_every_version(spark, tmp_path):
    from evidentia.operators import ledger
    from evidentia.plans.queries import QUERIES

    day = lambda n: dt.date(2025, 1, n)
    rows = [(i, "http://h.example/a", "s", "s", None, x, s, day(9 - i), dt.datetime(2025, 1, i + 1)) for i, (x, s) in enumerate([("x", "partial"), ("x", "full"), ("y", "blocked"), ("x", "full"), ("z", "partial")])]
    rows.append((9, "http://h.example/b", "s", "s", None, "q", "full", day(3), dt.datetime(2025, 1, 1)))
    schema = "arrival long, url string, source string, source_key string, pub_date date, text string, fetch_status string, first_seen date, fetched_at timestamp"
    d = _articles(spark, tmp_path, rows, schema)
    got = {(r.url[-1], r.fetch_status, r.first_seen, r.n_history) for r in QUERIES["snk04_upsert"](spark, d).collect()}
    assert got == {("a", "partial", day(5), 4), ("b", "full", day(3), 0)}
    one = snapshots.with_paths(spark.createDataFrame(rows, schema)).select("arrival", "url", "snapshot_id", "snapshot_path", "fetch_status", "content_hash", "first_seen", "fetched_at")
    batches = one.withColumn("history", F.array().cast(ledger.HISTORY))
    want = batches.where("arrival = 9").drop("arrival")
    for i in range(5):
        want = ledger.upserted(want, batches.where(F.col("arrival") == i).drop("arrival"))
    assert sorted(map(tuple, ledger.folded(one).collect())) == sorted(map(tuple, want.collect()))


def test_a_run_over_captures(spark, tmp_path, capsys):
    """Registry, listing, details, identity, ledger, archive and summary in one call, twice."""
    import hashlib
    import json

    from evidentia.__main__ import main

    url = lambda i: f"https://h.example/doc/{i}.html"
    name = lambda i: hashlib.sha256(url(i).encode()).hexdigest()[:16]
    body = "<p>" + "第一条　应当报送材料。" * 30 + "</p>"
    files = {
        "a/listing/1.html": "".join(f"<a href='{url(i)}'>关于事项{i}的通知全文</a>" for i in (1, 2, 3)),
        "b/listing/1.json": json.dumps({"rows": [{"t": "另一个来源的通知", "u": "https://b.example/doc/9"}]}),
        f"a/detail/html/{name(1)}": f"<div class='article'>{body}</div>",
        f"a/detail/api/{name(2)}": json.dumps({"data": {"docTitle": "关于事项2的通知全文", "docClob": body.replace("报送", "提交")}}),
    }
    for path, text in files.items():
        (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / path).write_text(text, encoding="utf-8")
    config = {"sources": [{"key": "a", "listing": {"url": "https://h.example/"}}, {"key": "b", "type": "json_get", "listing": {"url": "https://b.example/"}, "extract": {"records_path": "rows", "title_field": "t", "link_field": "u"}, "detail": {"mode": "blocked", "blocked_reason": "closed"}}]}
    (tmp_path / "c.json").write_text(json.dumps(config), encoding="utf-8")
    told = []
    for _ in range(2):
        assert main(["collect", "--config", str(tmp_path / "c.json"), "--captured", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--json"]) == 0
        told.append(json.loads(capsys.readouterr().out.strip().splitlines()[-1]))
    assert (told[0]["listed"], told[0]["kept"], told[0]["full"], told[0]["total"]) == (4, 4, 2, 4) and told[1]["total"] == 4
    from evidentia.streaming.ledger import SCHEMA

    rows = {r.url: r for r in snapshots.load_index(spark, str(tmp_path / "out"), SCHEMA).collect()}
    assert rows[url(1)].fetch_status == rows[url(2)].fetch_status == "full" and rows["https://b.example/doc/9"].fetch_status == rows[url(3)].fetch_status == "blocked"
    assert all(len(r.history) == 1 for r in rows.values()) and spark.read.parquet(str(tmp_path / "out" / "snapshots")).count() == 8
    assert main(["plan", "--config", str(tmp_path / "c.json"), "--contact", "you@example.com"]) == 2 and main(["doctor", "--config", str(tmp_path / "c.json")]) == 0


def test_requests_against_a_tape(spark):
    from evidentia.operators import requests

    tape = [("u1", "proxy", 0, 500, 10, ""), ("u1", "proxy", 1, None, None, "SSL handshake"), ("u1", "proxy", 2, 502, 0, ""), ("u1", "direct", 0, 200, 5, ""), ("u1", "direct", 1, 200, 5, ""), ("u2", "proxy", 0, 404, 3, ""), ("u2", "direct", 0, 200, 9, ""), ("u3", "proxy", 0, 200, 99, ""), ("u3", "direct", 0, 200, 9, ""), ("u4", "proxy", 0, None, None, "x" * 400), ("u4", "proxy", 3, 200, 9, "")]
    tape = spark.createDataFrame([(*x, 100) for x in tape], "url string, route string, try_no int, status int, chars int, error string, elapsed_ms int")
    asked = spark.createDataFrame([(i, f"u{i}", "html") for i in (1, 2, 3, 4)], "request_id int, url string, tier string")
    log = requests.tries(asked, tape, limit=50)
    rows = [(r.request_id, r.place, r.tier, r.ok, r.wait_ms) for r in log.orderBy("request_id", "place").collect()]
    assert rows == [(1, 1, "html:proxy", False, 1200), (1, 2, "html:proxy", False, 2400), (1, 3, "html:proxy", False, 0), (1, 4, "html:direct", True, 0), (2, 1, "html:proxy", False, 0), (3, 1, "html:proxy", False, 0), (4, 1, "html:proxy", False, 1200)]
    assert {r.request_id: (r.status, r.tries) for r in requests.outcomes(log).collect()} == {1: (200, 4), 2: (404, 1), 3: (None, 1), 4: (None, 1)}
    assert {(r.request_id, r.note) for r in requests.transport_notes(log).collect()} == {(1, "TLS failed at the proxy"), (1, "direct after the proxy failed")}
    starts = [r.starts_ms for r in requests.paced(log, F.lit("h")).orderBy("request_id", "place").collect()]
    assert starts[:3] == [0, 1300, 3800] and all(b - a >= 800 for a, b in zip(starts, starts[1:], strict=False))
    assert max(len(r.error or "") for r in log.collect()) == 300


def test_renderer(spark):
    from evidentia.operators import tiers

    urls = spark.createDataFrame([(1, "https://h.example/1"), (2, "--flag")], "article_id long, url string")
    rows = tiers.from_render(urls, ["echo", "<div class='article'>" + "正文。" * 100 + "</div>"]).collect()
    assert [(r.article_id, r.tier) for r in rows] == [(1, "render")] and rows[0].text.startswith("正文。")
    assert tiers.from_render(urls, ["/no/such/command"]).count() == 0


def test_grading_of_a_submission(spark, tmp_path):
    import json

    from evidentia.operators import grading

    (tmp_path / "spec.json").write_text(json.dumps({"evals": [{"id": 1, "kind": "analysis", "expectations": ["a", "b"]}, {"id": 2, "kind": "retrieval"}]}))
    cases = grading.read_cases(spark, str(tmp_path / "spec.json"))
    blank = grading.template(cases)
    assert [(c["id"], len(c["reviews"])) for c in blank["cases"]] == [(1, 2)]
    text = "补贴500万元。"
    (tmp_path / "r.md").write_text(text, encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": 1, "claims": [{"id": "a", "text": text, "kind": "fact", "importance": "core", "evidence": [URL_A]}]}), encoding="utf-8")
    spark.createDataFrame([(1, 1, URL_A, "s", None, None, text, "full", "L1", dt.datetime(2024, 1, 1))], ARTICLE).write.parquet(str(tmp_path / "e.parquet"))
    done = blank | {"producer": "Ann", "reviewer": "Bo"}
    done["cases"][0] |= {"report": "r.md", "claims": "c.json", "evidence": "e.parquet", "reviews": [{"expectation": i, "pass": True, "rationale": "x"} for i in (1, 2)]}
    (tmp_path / "s.json").write_text(json.dumps(done))
    assert grading.grade(spark, cases, str(tmp_path / "s.json")) == {"ok": True, "completed": [1], "complaints": []}
    done["cases"][0]["claims"] = "../c.json"
    (tmp_path / "s.json").write_text(json.dumps(done))
    assert grading.grade(spark, cases, str(tmp_path / "s.json"))["complaints"] == [(1, "claims lies outside")]
