"""A Markdown report as tables, and its checks against claims and evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import urls
from evidentia.functions.text import fold, folded
from evidentia.session import cut

URL = r"https?://[^\s)\]\"'<>，。；）】]+"
INLINE = r"[「“\"]([^」”\"]{8,300})[」”\"]"
#: A reference label with its link, a quoted line, and openings by which a quotation speaks about the report itself.
LABEL = r"^\s*\[([^\]]+)\]:\s*<?(https?://[^\s>]+)"
QUOTED_LINE = r"^\s*(?:>\s?|「|“)(.{8,})$"
OWN_WORDS = ("本文件", "模型", "说明", "口径", "流程", "全部来自", "本报告")
#: Fixed values of the checks without a ledger of claims: document numbers, amounts, dates, and dates of access, which no source holds.
DOCNO = r"(?i)[一-龥]{1,12}(?:发|办|函|公告|令|规|字|号)?\s*[〔\[（(【]\s*20\d{2}\s*[〕\]）)】]\s*\d{1,4}\s*号|\b\d{2,3}\s+FR\s+\d{3,6}\b|\b(?:Regulation|Directive)\s*\((?:EU|EC)\)\s*\d{4}/\d{1,5}\b|\bSI\s+\d{4}/\d{1,4}\b"
AMOUNT = r"(?i)\d[\d,\.]*\s*(?:%|％|亿元|万元|千万元|百万元|元|美元|欧元|million|billion|bn|mn|USD|EUR|RMB|CNY)|(?:不超过|不高于|不低于|达到|上限为|下限为|金额为|补贴|罚款|罚款金额|注册资本|保费|资金支持|预算|限额)[^。；\n]{0,12}?\d[\d,\.]*\s*(?:亿元|万元|元|%|％)"
DAY = r"20\d{2}-\d{2}-\d{2}"
ACCESSED = r"(?i)(?:访问日期|检索日期|抓取日期|检查日期|获取日期|accessed|retrieved)[：:\s]*(20\d{2})[-/年.](\d{1,2})[-/月.](\d{1,2})"
ANY_DAY = r"(20\d{2})\s*[-年/.]\s*(\d{1,2})\s*[-月/.]\s*(\d{1,2})\s*日?"


def _same_dates(text: str) -> str:
    def spelled(m: re.Match[str]) -> str:
        month, day = int(m[2]), int(m[3])
        return f"{m[1]}-{month:02d}-{day:02d}" if 1 <= month <= 12 and 1 <= day <= 31 else m[0]

    return re.sub(ANY_DAY, spelled, text)


def _same_numbers(text: str) -> str:
    return re.sub(r"(?<=\d),(?=\d)", "", text)


def quotations(report: str) -> list[str]:
    """What a report quotes, in quotation marks or as blocks of lines that begin with >; a report is one text in the driver."""
    out = [next(x for x in m.groups() if x is not None) for m in re.finditer(r"「([^」]+)」|“([^”]+)”|\"([^\"\n]+)\"", report)]
    block: list[str] = []
    for line in [*report.splitlines(), ""]:
        m = re.match(r"^\s*>\s?(.*)$", line)
        if m and m[1].strip():
            block.append(m[1])
        elif block:
            out.append("\n".join(block))
            block = []
    return out


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: what empty lines part."""
    return F.split(text, r"\n\s*\n")


def blocks(spark: SparkSession, report: str) -> DataFrame:
    """pos, block: the paragraphs."""
    one = spark.createDataFrame([(report,)], "report string")
    return one.select(F.posexplode(paragraphs(F.col("report"))).alias("pos", "block"))


def citations(spark: SparkSession, report: str) -> DataFrame:
    """pos, url of every link in a paragraph, given inline or by a reference label."""
    paragraphs = blocks(spark, report)
    inline = paragraphs.select("pos", F.explode(F.regexp_extract_all("block", F.lit(URL), 0)).alias("url"))
    lines = spark.createDataFrame([(x,) for x in report.splitlines()] or [("",)], "line string")
    refs = lines.select(F.lower(F.regexp_extract("line", LABEL, 1)).alias("label"), F.regexp_extract("line", LABEL, 2).alias("url")).where("url <> ''")
    labels = paragraphs.select("pos", F.explode(F.transform(F.regexp_extract_all("block", F.lit(r"\[([^\]]+)\]"), 1), lambda x: F.lower(x))).alias("label"))
    trimmed = F.regexp_replace("url", r"[.,;]+$", "")
    return inline.unionByName(labels.join(refs, "label").select("pos", "url")).select("pos", trimmed.alias("url")).distinct()


def unknown_links(spark: SparkSession, report: str, articles: DataFrame) -> DataFrame:
    """url of links that no article has; a bare site of a known host may be named."""
    cited = citations(spark, report).select("url").distinct()
    left = cited.join(articles.select("url").distinct(), "url", "left_anti")
    hosts = articles.where("url like 'http%'").select(urls.host(F.col("url")).alias("host")).distinct()
    bare = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")).isin("", "/")
    exempt = left.where(bare).withColumn("host", urls.host(F.col("url"))).join(hosts, "host", "left_semi").select("url")
    return left.join(exempt, "url", "left_anti")


def _held(needles: list[str], bodies: DataFrame) -> set[str]:
    """Those of a report's few needles that some body (one column) holds: one pass over the bodies, no join."""
    if not needles:
        return set()
    wanted = F.array(*[F.lit(x) for x in needles])
    hits = bodies.select(F.col(bodies.columns[0]).alias("b")).select(F.explode(F.filter(wanted, lambda n: F.contains("b", n))).alias("n")).distinct()
    return {r.n for r in hits.collect()}  # no more rows than needles


def _strings(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def unfound_quotes(spark: SparkSession, report: str, articles: DataFrame) -> DataFrame:
    """quote that no article's body holds, compared folded with dates in one spelling; short ones and words about the report itself
    are left out."""
    from evidentia.operators.audit import dated

    said = [m[1].strip() for x in report.splitlines() if (m := re.match(QUOTED_LINE, x))] + [x.strip() for x in re.findall(INLINE, report)]
    needles = {q: n for q in dict.fromkeys(said) if not q.startswith(OWN_WORDS) and len(n := folded(_same_dates(q))) >= 8}
    held = _held(sorted(set(needles.values())), articles.where("text <> ''").select(dated(fold(F.col("text"))).alias("body")))
    return _strings(spark, [(q,) for q, n in needles.items() if n not in held], "quote string")


def unfound_tokens(spark: SparkSession, report: str, articles: DataFrame) -> DataFrame:
    """label, token: document numbers, amounts and whole dates of a report that no article's body holds. Dates of access are let pass."""
    from evidentia.operators.audit import comparable

    accessed = {f"{y}-{int(m):02d}-{int(d):02d}" for y, m, d in re.findall(ACCESSED, report)}
    found = [(label, m.group().strip()) for label, pattern in (("docno", DOCNO), ("amount", AMOUNT), ("date", DAY)) for m in re.finditer(pattern, report)]
    needles = {(label, t): folded(_same_numbers(_same_dates(t))) for label, t in dict.fromkeys(found) if not (label == "date" and t in accessed)}
    held = _held(sorted(set(needles.values())), articles.where("text <> ''").select(comparable(F.col("text")).alias("body")))
    return _strings(spark, [key for key, n in needles.items() if n not in held], "label string, token string")


def evidence_strength(entries: DataFrame) -> DataFrame:
    """check, level, claim_id, detail of the whole index: empty, entries without a body, no full text at all."""
    weak = F.col("fetch_status").isin("blocked", "scanned_pdf")
    first = entries.where(weak).select("url", F.concat_ws(":", F.coalesce(*[c for c in ("source",) if c in entries.columns], F.lit("None")), "url").alias("named")).orderBy("url", "named").limit(5)
    few = first.agg(F.array_join(F.array_sort(F.collect_list("named")), "; ").alias("few")).withColumn("_", F.lit(1))
    counts = entries.agg(F.count("*").alias("n"), F.count_if(F.col("fetch_status") == "full").alias("full"), F.count_if(weak).alias("weak"))
    one = counts.withColumn("_", F.lit(1)).join(few, "_")
    says = lambda level, detail: F.struct(F.lit(level).alias("level"), detail.alias("detail"))
    said = F.array(
        F.when(F.col("n") == 0, says("error", F.lit("the index is empty"))),
        F.when(F.col("weak") > 0, says("warn", F.concat(F.col("weak").cast("string"), F.lit(" without a body: "), F.col("few")))),
        F.when((F.col("n") > 0) & (F.col("full") == 0), says("error", F.lit("no full text"))),
    )
    return one.select(F.explode(F.array_compact(said)).alias("x")).select(F.lit("C4").alias("check"), "x.level", F.lit(None).cast("long").alias("claim_id"), "x.detail")


def uncovered_claims(spark: SparkSession, report: str, claims: DataFrame) -> DataFrame:
    """claim_id of claims whose folded text the report lacks."""
    return claims.select("claim_id", fold(F.col("text")).alias("needle")).where(~F.contains(F.lit(folded(report)), F.col("needle"))).select("claim_id").distinct()


def uncited_evidence(spark: SparkSession, report: str, claims: DataFrame) -> DataFrame:
    """claim_id of facts and inferences some of whose evidence the report doesn't cite, if it cites anything."""
    cited = sorted({x.rstrip(".,;") for x in re.findall(URL, report)})
    named = claims.where("kind in ('fact', 'inference') and size(evidence) > 0")
    lacking = F.size(F.array_except("evidence", F.array(*[F.lit(u) for u in cited]).cast("array<string>"))) > 0
    return named.where(lacking if cited else F.lit(False)).select("claim_id").distinct()


def foreign_citations(spark: SparkSession, report: str, claims: DataFrame) -> DataFrame:
    """claim_id, url that a paragraph with the claim cites though the claim doesn't name it as evidence. The report's paragraphs go
    along as a literal, so claims move nowhere."""
    labels = {m[1].casefold(): m[2] for x in report.splitlines() if (m := re.match(LABEL, x))}
    paragraphs = []
    for block in re.split(r"\n\s*\n", report):
        urls = {x.rstrip(".,;") for x in re.findall(URL, block)} | {labels[x.casefold()] for x in re.findall(r"\[([^\]]+)\]", block) if x.casefold() in labels}
        if urls:
            paragraphs.append(F.struct(F.lit(folded(block)).alias("body"), F.array(*[F.lit(u) for u in sorted(urls)]).alias("urls")))
    facts = claims.where("kind in ('fact', 'inference') and size(evidence) > 0").select("claim_id", fold(F.col("text")).alias("needle"), "evidence")
    if not paragraphs:
        return facts.select("claim_id", F.lit("").alias("url")).limit(0)
    near = F.filter(F.array(*paragraphs), lambda p: F.contains(p.body, F.col("needle")))
    at = facts.select("claim_id", F.explode(F.array_except(F.flatten(F.transform(near, lambda p: p.urls)), "evidence")).alias("url"))
    return at.distinct()


def _row(df: DataFrame, check: str | Column, level: str | Column, claim: Column | None, detail: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(lit(check).alias("check"), lit(level).alias("level"), (F.lit(None) if claim is None else claim).cast("long").alias("claim_id"), detail.alias("detail"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def index_of(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An index and the snapshots it points to, where articles come as they are: each row is its own snapshot, the latest of a URL is
    in the index."""
    from evidentia.operators.identity import latest
    from evidentia.operators.snapshots import with_paths

    rows = with_paths(articles.where("url <> ''"))
    return latest(rows, "url").withColumn("layer", F.col("evidence_layer")), rows


def findings(spark: SparkSession, report: str, claims: DataFrame, index: DataFrame, snapshots: DataFrame) -> DataFrame:
    """check, level, claim_id, detail: all findings of the strict audit of a report against claims, index and snapshots."""
    from evidentia.operators import audit

    gates = cut(audit.evidence(claims, index, snapshots))
    texts = gates.where("text is not null").select("claim_id", "text")
    error, claim = "error", F.col("claim_id")
    return _all(
        [
            spark.createDataFrame([("audit", "warn", None, "only what the ledger of claims states was checked; a person must review the report")], "check string, level string, claim_id long, detail string"),
            _row(unknown_links(spark, report, index), "C1", error, None, F.col("url")),
            _row(gates.where("check is not null"), F.col("check"), F.col("level"), claim, F.concat_ws(": ", "message", "url")),
            _row(audit.without_evidence(claims), "C4", F.col("level"), claim, F.lit("no evidence")),
            _row(audit.unsupported_quotes(claims, texts, quotations(report)), "C2", error, claim, F.col("quote")),
            _row(audit.unsupported_tokens(claims, texts), "C3", error, claim, F.concat_ws(": ", "label", "token")),
            _row(uncovered_claims(spark, report, claims), "C5", error, claim, F.lit("not in the report")),
            _row(uncited_evidence(spark, report, claims), "C5", error, claim, F.lit("evidence is not cited")),
            _row(foreign_citations(spark, report, claims), "C5", error, claim, F.col("url")),
        ]
    )


def legacy_findings(spark: SparkSession, report: str, articles: DataFrame, unknown_level: str = "error") -> DataFrame:
    """check, level, claim_id, detail of the checks without claims: links, quotations, tokens and the strength of the whole index."""
    return _all(
        [
            spark.createDataFrame([("audit", "warn", None, "no claims were audited; this is no strict audit")], "check string, level string, claim_id long, detail string"),
            _row(unknown_links(spark, report, articles), "C1", unknown_level, None, F.col("url")),
            _row(unfound_quotes(spark, report, articles), "C2", "error", None, F.col("quote")),
            _row(unfound_tokens(spark, report, articles), "C3", "error", None, F.concat_ws(": ", "label", "token")),
            evidence_strength(articles),
        ]
    )


def verdict(found: DataFrame, strict: bool = True) -> DataFrame:
    """One row: ok, errors, warnings, the mode, and whether the strict audit passed; a person must review in any case."""
    counts = found.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"))
    ok = F.col("errors") == 0
    return counts.select(ok.alias("ok"), "errors", "warnings", F.lit("strict" if strict else "legacy").alias("audit_mode"), (ok & F.lit(strict)).alias("strict_passed"), F.lit(True).alias("manual_review_required"))


def statistics(spark: SparkSession, report: str, claims: DataFrame, index: DataFrame, snapshots: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counts: links, claims, quotations, and evidence by status."""
    from evidentia.operators import audit

    cited = sorted({x.rstrip(".,;") for x in re.findall(URL, report)})
    known = index.where(F.col("url").isin(cited)).select("url").distinct().agg(F.count("*").alias("known_urls"))
    gates = audit.evidence(claims, index, snapshots).where("text is not null").select("claim_id", "text")
    said = audit.claim_quotes(claims, quotations(report)).agg(F.count("*").alias("quotes_total"))
    lost = audit.unsupported_quotes(claims, gates, quotations(report)).agg(F.count("*").alias("quotes_lost"))
    errors = found.where("level = 'error' and claim_id is not null").select("claim_id").distinct().withColumn("_bad", F.lit(True))
    sound = F.col("_bad").isNull() & ((F.size("evidence") > 0) | F.col("kind").isin("company", "assumption"))
    per = claims.join(errors, "claim_id", "left").groupBy("claim_id").agg(F.bool_and(F.coalesce(sound, F.lit(False))).alias("ok"), F.bool_or((F.col("importance") == "core") & F.col("kind").isin("fact", "inference")).alias("core"))
    told = per.agg(F.count("*").alias("claims_total"), F.count_if("core").alias("core_claims"), F.count_if("ok").alias("claims_verified"))
    by_status = index.groupBy(F.coalesce("fetch_status", F.lit("invalid")).alias("s")).agg(F.count("*").alias("n"))
    counts = by_status.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("evidence_counts"), F.coalesce(F.round(F.try_divide(F.sum(F.when(F.col("s") == "full", F.col("n")).otherwise(0)), F.sum("n")), 4), F.lit(0.0)).alias("full_text_rate"))
    out = known.withColumn("_", F.lit(1))
    for more in (said, lost, told, counts):
        out = out.join(more.withColumn("_", F.lit(1)), "_")
    return out.select(F.lit(len(cited)).cast("long").alias("cited_urls"), "known_urls", "claims_total", "core_claims", "claims_verified", "quotes_total", (F.col("quotes_total") - F.col("quotes_lost")).alias("quotes_verified"), "evidence_counts", "full_text_rate")
