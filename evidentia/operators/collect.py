"""A whole run over captured data: listing, filters, queue, details, identity, ledger and counters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import identity, ledger, listing, tiers
from evidentia.session import cut


@dataclass
class Options:
    """How a run is bounded. Dates are inclusive; sources name their own caps."""

    since: str | None = None
    until: str | None = None
    budget: int = 40
    keywords: list[str] = field(default_factory=list)
    unwanted: list[str] = field(default_factory=list)
    least_chars: int = 200


@dataclass
class Run:
    listed: DataFrame
    kept: DataFrame
    dropped: DataFrame
    counters: DataFrame
    #: Rows that the window dropped after their details brought a date.
    late: int = 0


def collect(items: DataFrame, outcomes: DataFrame, sources: DataFrame, options: Options, blocked: dict[str, str] | None = None) -> Run:
    """items: listed articles with arrival. outcomes: judged candidates. The window is applied again after the details, as a
    body may bring the date; only items of the queue are upgraded."""
    caps = sources.select("source_key", F.coalesce(F.nullif("max_items", F.lit(0)), F.lit(20)).alias("_most"))
    inside = listing.in_window(F.col("pub_date"), options.since, options.until)
    passing = items.where(inside).where(listing.keywords_pass(F.col("title"), F.col("summary"), options.keywords, options.unwanted))
    first = listing.keep_first(passing, ["source_key", "url"])
    ceiling = caps.agg(F.max("_most")).first()[0]
    listed = cut(listing.cap(first.join(caps, "source_key"), "source_key", F.col("_most"), ceiling=ceiling).drop("_most"))
    queued = listing.queue(listed, options.budget, eligible=F.col("fetch_status") == "listing_only").select("article_id")
    chosen = cut(listed.join(queued.distinct(), "article_id", "left_semi"))
    rest = listed.join(chosen.select("arrival"), "arrival", "left_anti")
    after = cut(tiers.upgraded(chosen, outcomes, blocked).unionByName(rest))
    grouped = cut(identity.identity(after.where(inside)))
    kept = grouped.where("is_kept")
    return Run(listed, kept, grouped.where("not is_kept"), ledger.source_counters(kept, sources, listed), after.where(~inside).count())


ARTICLE = "article_id long, arrival long, url string, source string, source_key string, region string, title string, pub_date date, effective_date date, issuer string, docno string, policy_status string, text string, summary string, fetch_status string, fetch_method string, first_seen date, fetched_at timestamp, evidence_layer string, notes string, params map<string,string>"


def listed_items(spark: SparkSession, captured: DataFrame, sources: list[dict]) -> DataFrame:
    """Articles listed in captured pages (source_key, url, payload), by each source's own kind and mapping."""
    from evidentia.sources.listings import KINDS

    parts = []
    for s in sources:
        at, extract = s.get("listing") or {}, s.get("extract") or {}
        kind = s.get("type", "html_list")
        pages = captured.where(F.col("source_key") == s["key"]).select("url", "payload")
        if kind not in KINDS:
            continue
        if KINDS[kind] is KINDS["json_get"]:
            spec = {k: extract[f"{k}_field"] for k in ("title", "date", "docno", "summary", "link") if extract.get(f"{k}_field")}
            rows = KINDS[kind](pages, spec, extract.get("records_path") or "", extract.get("link_template"))
        elif kind == "html_list":
            rows = KINDS[kind](pages, selector=extract.get("link_selector"), pattern=extract.get("link_pattern"), date_pattern=extract.get("date_from_url"))
        elif kind == "sitemap":
            rows = KINDS[kind](pages, pattern=extract.get("link_pattern"))
        else:
            rows = KINDS[kind](pages)
        have = lambda c, to: F.col(c).cast(to) if c in rows.columns else F.lit(None).cast(to)  # noqa: B023, E731
        order = F.col("rank") if "rank" in rows.columns else F.col("pos") if "pos" in rows.columns else F.lit(0)
        parts.append(rows.select(F.lit(s["key"]).alias("source_key"), F.lit(s.get("name", s["key"])).alias("source"), F.lit(s.get("region", "")).alias("region"), F.lit(s.get("layer", "L1")).alias("evidence_layer"), F.lit(len(parts)).alias("_source"), order.alias("_pos"), F.col("link").alias("url"), have("title", "string").alias("title"), have("date", "date").alias("pub_date"), have("docno", "string").alias("docno"), have("summary", "string").alias("summary"), F.lit(at.get("notes", "")).alias("notes")))
    out = parts[0] if parts else spark.createDataFrame([], "source_key string, source string, region string, evidence_layer string, _source int, _pos int, url string, title string, pub_date date, docno string, summary string, notes string")
    for more in parts[1:]:
        out = out.unionByName(more)
    # Positions are within a page; the arrival is the source's place, then the item's, in the bits of one number.
    arrival = F.shiftleft(F.col("_source").cast("long"), 48) + F.shiftleft(F.col("_pos").cast("long"), 20) + F.pmod(F.xxhash64("url"), F.lit(1 << 20))
    none = {c: t for c, t in (x.split(" ") for x in ARTICLE.split(", ") if not x.startswith("params"))}
    rows = out.withColumns({"arrival": arrival, "article_id": F.xxhash64("source_key", "url"), "fetch_status": F.lit("listing_only"), "fetch_method": F.lit("listing")})
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(None).cast("map<string,string>").alias("params"))


def judged_details(captured: DataFrame) -> DataFrame:
    """Judged candidates of captured details (article_id, tier, content as bytes, payload as text)."""
    parts = [tiers.judged(read(captured.where(F.col("tier") == tier).select("article_id", "payload"))) for tier, read in tiers.READERS.items()]
    parts.append(tiers.judged(tiers.from_pdf(captured.where((F.col("tier") == "pdf") | F.startswith(F.col("payload"), F.lit("%PDF-"))).select("article_id", "content"))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def run_captured(spark: SparkSession, registry: dict, folder: str, root: str, options: Options, keys: list[str] | None = None) -> tuple[Run, DataFrame]:
    """A run from the registry to ledger and archive over a folder of captures, and its summary.

    The folder holds SOURCE/listing/FILE for listing pages and SOURCE/detail/TIER/NAME for details, NAME the first 16 hex digits
    of the URL's SHA-256. Below root lie the snapshots, the index and the readable archive.
    """
    from evidentia.functions.bytes import decoded
    from evidentia.operators import snapshots
    from evidentia.sources import registry as known
    from evidentia.sources.replay import Replay
    from evidentia.streaming.ledger import SCHEMA, entries

    chosen = known.select(registry["sources"], keys)
    spark.dataSource.register(Replay)
    raw = cut(spark.read.format("replay").option("path", folder).load().where("ok"))
    steps = F.split(F.col("path"), "/")
    payload = decoded(F.col("content"), F.lit(None).cast("string"))
    place = raw.withColumns({"_kind": F.element_at(steps, F.when(F.element_at(steps, -2) == "listing", -2).otherwise(-3)), "_tier": F.element_at(steps, -2), "_name": F.regexp_extract(F.element_at(steps, -1), r"^([^.]*)", 1), "payload": payload})
    urls = spark.createDataFrame([(s["key"], (s.get("listing") or {}).get("url", "")) for s in chosen], "source_key string, url string")
    items = cut(listed_items(spark, place.where("_kind = 'listing'").join(urls, "source_key"), chosen))
    details = place.where("_kind = 'detail'").select("source_key", F.col("_tier").alias("tier"), "_name", "content", "payload")
    named = items.select("article_id", "source_key", F.left(F.sha2("url", 256), F.lit(16)).alias("_name"))
    outcomes = cut(judged_details(cut(details.join(named, ["source_key", "_name"]))))
    sources = spark.createDataFrame([(s["key"], int(s.get("max_items") or 20)) for s in chosen], "source_key string, max_items int")
    shut = {s["key"]: (s["detail"].get("blocked_reason") or "") for s in chosen if (s.get("detail") or {}).get("mode") == "blocked"}
    run = collect(items, outcomes, sources, options, shut)
    now = F.current_timestamp()
    kept = cut(run.kept.drop("group_id", "group_size", "kept_row", "is_kept").withColumns({"fetched_at": F.coalesce("fetched_at", now), "first_seen": F.coalesce("first_seen", F.to_date(now))}))
    before = snapshots.load_index(spark, root, SCHEMA)
    snapshots.append(kept, root)
    after = cut(ledger.upserted(before, entries(kept)))
    snapshots.swap_index(after, root)
    snapshots.archive_sections(kept).select("section").write.mode("overwrite").text(f"{root}/archive")
    return run, ledger.summary(kept, run.listed, after)
