"""Bodies from several tiers of capture, judged alike, and the best of each article.

Every tier turns captured payloads into candidate rows; nothing is fetched here. Where a tier costs much, run the tiers one
after the other over `open_articles`, which leaves out what is full already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import dates, documents, html, text
from evidentia.functions.bytes import pdf_extracted
from evidentia.sources.records import first_given

#: The order of the tiers, the worth of a status, and where details name their parts.
TIERS = ("api", "text", "html", "pdf", "render")
WORTH = {"full": 4, "partial": 3, "scanned_pdf": 2, "listing_only": 1, "blocked": 0}
TITLES, DATES, DOCNOS, BODIES = "docTitle|title", "publishDate|date", "documentNo|docno", "docClob|content|body|text"

CANDIDATE = ["article_id", "tier", "page", "text", "title", "date", "docno", "method"]


def fragment_text(fragment: Column) -> Column:
    """Plain text of a body that may be an HTML fragment."""
    bare = html.extracted(F.concat(F.lit("<body>"), fragment, F.lit("</body>")), least=1 << 30)["text"]
    return F.when(fragment.rlike(r"(?i)<(?:p|div|br|span|table|ul|ol|li|h[1-6]|a|strong)\b"), bare).otherwise(text.normalized(fragment))


def from_api(captured: DataFrame, body: str = BODIES, payload: str = "payload") -> DataFrame:
    """JSON details: the data part, of a list its first item; title and number go before the text if it lacks them."""
    parsed = captured.select("article_id", F.try_parse_json(payload).alias("v")).where("v is not null")
    inner = F.coalesce(F.try_variant_get("v", "$.data[0]", "variant"), F.try_variant_get("v", "$.data", "variant"), F.try_variant_get("v", "$[0]", "variant"), F.col("v"))
    each = parsed.select("article_id", inner.alias("r"))
    rows = each.select("article_id", first_given(F.col("r"), TITLES).alias("title"), F.left(first_given(F.col("r"), DATES), F.lit(10)).alias("date"), first_given(F.col("r"), DOCNOS).alias("docno"), F.coalesce(first_given(F.col("r"), body), F.lit("")).alias("body"))
    rows = rows.withColumn("text", fragment_text(F.col("body")))
    missing = lambda c: F.when(~F.contains("text", F.col(c)), F.col(c))
    whole = F.concat_ws("\n", missing("title"), missing("docno"), F.col("text"))
    return rows.select("article_id", F.lit("api").alias("tier"), F.lit("").alias("page"), whole.alias("text"), "title", "date", "docno", F.lit("api").alias("method"))


def from_html(captured: DataFrame, selectors: tuple[str, ...] = (), payload: str = "payload") -> DataFrame:
    """HTML details; a PDF served as a page has no text here."""
    rows = captured.withColumn("x", html.extracted(F.col(payload), selectors))
    pdf = F.startswith(F.col(payload), F.lit("%PDF-"))
    none = F.lit(None).cast("string")
    return rows.select("article_id", F.lit("html").alias("tier"), F.when(pdf, "").otherwise(F.col(payload)).alias("page"), F.when(pdf, "").otherwise(F.col("x.text")).alias("text"), F.col("x.title").alias("title"), none.alias("date"), none.alias("docno"), F.concat(F.lit("html:"), "x.how").alias("method"))


def from_text(captured: DataFrame, payload: str = "payload") -> DataFrame:
    none = F.lit(None).cast("string")
    return captured.select("article_id", F.lit("text").alias("tier"), F.lit("").alias("page"), text.normalized(html.plain(F.col(payload))).alias("text"), none.alias("title"), none.alias("date"), none.alias("docno"), F.lit("text").alias("method"))


def from_pdf(captured: DataFrame, content: str = "content") -> DataFrame:
    none = F.lit(None).cast("string")
    rows = captured.withColumn("x", pdf_extracted(F.col(content)))
    return rows.select("article_id", F.lit("pdf").alias("tier"), F.lit("").alias("page"), documents.halved(F.col("x.text")).alias("text"), none.alias("title"), none.alias("date"), none.alias("docno"), F.concat(F.lit("pdf:"), "x.method").alias("method"))


def from_render(urls: DataFrame, command: list[str], timeout: int = 90) -> DataFrame:
    """Pages (article_id, url) that an external renderer writes for a URL; off unless a command is given.

    The command gets the URL as its last argument and answers on its standard output; one that fails or takes too long gives no row.
    """
    import subprocess
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pages = [], []
            for i, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not str(url).startswith(("http://", "https://")):
                    continue
                try:
                    done = subprocess.run([*command, url], capture_output=True, timeout=timeout, check=True)
                except (OSError, subprocess.SubprocessError):
                    continue
                ids.append(i)
                pages.append(done.stdout.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(pages, pa.string())], names=["article_id", "payload"])

    kind = urls.schema["article_id"].dataType.simpleString()
    rows = from_html(urls.select("article_id", "url").mapInArrow(run, f"article_id {kind}, payload string"))
    return rows.withColumns({"tier": F.lit("render"), "method": F.lit("render")})


def judged(candidates: DataFrame, least: int = 200, most: int = 0) -> DataFrame:
    """Adds status and the parts found in the text. Heuristic bodies are at best partial; scanned and failed PDF files say so."""
    candidates = candidates.withColumn("_status", documents.status(F.col("page"), F.col("text"), least, most))
    status, method = F.col("_status"), F.col("method")
    verdict = F.when(method == "pdf:scanned", "scanned_pdf").when(method == "pdf:failed", "blocked").when((status == "full") & (method.rlike("heuristic$|fallback$") | (method == "pdf:partial")), "partial").otherwise(status)
    return candidates.select(
        "article_id", "tier", "text", "title", "method", verdict.alias("status"), F.coalesce(dates.any_date(F.col("date")), dates.publication_date(F.col("text"))).alias("pub_date"),
        F.coalesce(text.or_none(F.col("docno")), text.or_none(documents.docno(F.col("text")))).alias("docno"), text.or_none(documents.issuer(F.col("text"))).alias("issuer"), dates.effective_date(F.col("text")).alias("effective_date"),
    )


def best(outcomes: DataFrame) -> DataFrame:
    """The best outcome of each article; of equals the earlier tier. Short API and text bodies don't count."""
    counted = outcomes.where(~((F.col("status") == "listing_only") & F.col("tier").isin("api", "text", "render")))
    worth = F.create_map(*[F.lit(x) for pair in WORTH.items() for x in pair])[F.col("status")]
    order = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    row = F.struct(*[c for c in outcomes.columns if c != "article_id"])
    picked = counted.groupBy("article_id").agg(F.max_by(row, F.struct((worth * 10 - order).alias("w"), F.length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("b"))
    return picked.select("article_id", "b.*")


#: Notes on articles without a full body.
BLOCKED_NOTE, NONE_NOTE = "the source is declared as not retrievable", "no tier got a body"


def upgraded(articles: DataFrame, outcomes: DataFrame, blocked: dict[str, str] | None = None) -> DataFrame:
    """Articles with what the best outcome found: its value where there is one, else the old; without any, blocked.

    blocked: source keys that are declared as not retrievable, with the reason; their outcomes don't count. The note tells why a
    body is not full; the note of a full one stays as it was.
    """
    found = best(outcomes).select("article_id", *[F.col(c).alias(f"_{c}") for c in ("text", "status", "method", "title", "pub_date", "docno", "issuer", "effective_date")])
    joined = articles.join(found, "article_id", "left")
    names = list(blocked or {})
    shut = F.coalesce(F.col("source_key").isin(names), F.lit(False)) if names else F.lit(False)
    held = lambda c: F.when(~shut, F.col(f"_{c}"))
    new = {c: F.coalesce(held(c) if c in ("pub_date", "effective_date") else text.or_none(held(c)), F.col(c)) for c in ("title", "pub_date", "docno", "issuer", "effective_date")}
    reason = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in (blocked or {}).items() for x in (k, v or BLOCKED_NOTE)]), F.col("source_key")), F.lit(BLOCKED_NOTE)) if names else F.lit(BLOCKED_NOTE)
    note = F.when(shut, reason).when(F.col("_status").isNull(), F.lit(NONE_NOTE)).when(F.col("_status") != "full", F.concat(F.lit("best body is "), "_status", F.lit(" by "), "_method")).otherwise(F.col("notes"))
    new |= {"text": F.coalesce(held("text"), "text"), "fetch_status": F.when(shut, "blocked").otherwise(F.coalesce("_status", F.lit("blocked"))), "fetch_method": F.when(shut, "blocked").otherwise(F.coalesce("_method", F.lit("none")))}
    if "notes" in articles.columns:
        new["notes"] = note
    return joined.withColumns(new).select(*articles.columns)


def open_articles(articles: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Articles that no tier has fully got yet."""
    return articles.join(outcomes.where("status = 'full'").select("article_id"), "article_id", "left_anti")


#: How captured details of each tier become candidates; a mapping that others may add to.
READERS = {"api": from_api, "text": from_text, "html": from_html}
