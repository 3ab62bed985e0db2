"""The audit of claims against exactly the evidence that each cites, as tables of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import content_hash, fold, folded, snapshot_id
from evidentia.operators.identity import latest

#: Forms of amounts, numbers and document numbers in folded text.
DATE = r"20[0-9]{2}[-年/.][0-9]{1,2}[-月/.][0-9]{1,2}日?"
NUMBER = r"(?<![0-9.])[0-9]+(?:\.[0-9]+)?(?![0-9.])"
AMOUNT = r"(?i)(?<![0-9.])[0-9]+(?:\.[0-9]+)?(?:%|千万元|百万元|亿元|万元|美元|欧元|元|million|billion|bn|mn|USD|EUR|RMB|CNY)|(?:USD|EUR|RMB|CNY|[$€£¥])[0-9]+(?:\.[0-9]+)?(?![0-9.])"
DOCNO = r"(?i)[\x{4e00}-\x{9fa5}]{1,12}(?:发|办|函|公告|令|规|字|号)?[〔\[（(【]20[0-9]{2}[〕\]）)】][0-9]{1,4}号|[0-9]{2,3}FR[0-9]{3,6}|(?:Regulation|Directive)\((?:EU|EC)\)[0-9]{4}/[0-9]{1,5}|SI[0-9]{4}/[0-9]{1,4}"
INTRODUCED = "根据|依据|按照|参照|文号为|文号是|文号"
QUOTE = r"「([^」]+)」|“([^”]+)”|\"([^\"\n]+)\""


def dated(folded: Column) -> Column:
    """Dates of a folded text in one spelling."""
    day = r"(20[0-9]{2})[-年/.](1[0-2]|0?[1-9])[-月/.](3[01]|[12][0-9]|0[1-9]|[1-9](?![0-9]))日?"
    padded = F.regexp_replace(folded, day, "$1-0$2-0$3")
    return F.regexp_replace(padded, r"(20[0-9]{2})-0?([0-9]{2})-0?([0-9]{2})", "$1-$2-$3")


def plain_numbers(text: Column) -> Column:
    """Without separators between digits."""
    return F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9])", "")


def comparable(text: Column) -> Column:
    """Folded, without separators in numbers, dates in one spelling."""
    return dated(plain_numbers(fold(text)))


def claim_evidence(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """One row for each claim and cited URL, with the latest version of the article there, if any."""
    cited = claims.select("claim_id", "kind", "importance", F.col("text").alias("claim_text"), F.explode(F.array_distinct("evidence")).alias("url")).distinct()
    return cited.join(latest(articles.where("url <> ''"), "url"), "url", "left")


def unknown_citations(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Cited URLs that no article has."""
    cited = claims.select("claim_id", F.explode("evidence").alias("url")).distinct()
    return cited.join(articles.select("url").distinct(), "url", "left_anti")


def strength(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """claim_id, url, level, message: evidence that can't carry its claim. The first failing gate speaks."""
    rows = claim_evidence(claims, articles)
    core = (F.col("importance") == "core") & F.col("kind").isin("fact", "inference")
    strong = F.coalesce((F.col("fetch_status") == "full") & F.col("evidence_layer").isin("L1", "L2"), F.lit(False))
    verdict = F.when(F.col("article_id").isNull(), "missing").when(F.coalesce("text", F.lit("")) == "", "unreadable").when(~strong, "weak")
    found = rows.withColumn("message", verdict).where("message is not null")
    return found.select("claim_id", "url", F.when(F.col("message") != "weak", "error").when(F.coalesce(core, F.lit(False)), "error").otherwise("warn").alias("level"), "message")


def tokens(claims: DataFrame) -> DataFrame:
    """claim_id, label, token: the numbers that a fact states and its evidence must hold."""
    plain = fold(F.regexp_replace("text", r"https?://[^\s)\]\"'<>，。；）】]+", ""))
    text = comparable(F.col("text"))
    bare = F.regexp_replace(text, DATE, "")
    each = [("docno", F.transform(F.regexp_extract_all(plain, F.lit(DOCNO), 0), lambda x: F.element_at(F.split(x, INTRODUCED), -1))), ("date", F.regexp_extract_all(text, F.lit(DATE), 0)), ("amount", F.regexp_extract_all(text, F.lit(AMOUNT), 0)), ("number", F.regexp_extract_all(bare, F.lit(NUMBER), 0))]

    def labelled(label: str, found: Column) -> Column:
        return F.transform(F.array_distinct(found), lambda x: F.struct(F.lit(label).alias("label"), x.alias("token")))

    pairs = F.concat(*[labelled(*x) for x in each])
    return claims.where("kind = 'fact'").select("claim_id", F.explode(pairs).alias("x")).select("claim_id", "x.label", "x.token").distinct()


def evidence(claims: DataFrame, index: DataFrame, snapshots: DataFrame) -> DataFrame:
    """claim_id, url, check, level, message and text for every claim and URL that it cites: the gates of the strict audit.

    index: url, snapshot_path, snapshot_id, content_hash, fetch_status, layer. snapshots: snapshot_path, url, text, snapshot_id,
    fetch_status, evidence_layer. The first gate that fails speaks: the URL is not in the index; no snapshot lies where the index
    points; the snapshot is of another URL; its text is missing; a fingerprint in index or snapshot differs from the one worked
    out from the text; index and snapshot don't both say full and layer 1 or 2, or nothing can be read. check is NULL where
    all hold. text is that of a readable snapshot whose fingerprints hold, whatever its strength; else NULL.
    """
    from evidentia.operators.snapshots import contained

    cited = claims.select("claim_id", "kind", "importance", F.explode(F.array_distinct("evidence")).alias("url")).distinct()
    rows = index.select("url", F.lit(True).alias("_known"), F.when(contained(F.col("snapshot_path")), F.col("snapshot_path")).alias("_path"), F.col("snapshot_id").alias("_id"), F.col("content_hash").alias("_hash"), F.col("fetch_status").alias("_status"), F.col("layer").alias("_layer"))
    kept = snapshots.select(F.col("snapshot_path").alias("_path"), F.lit(True).alias("_there"), F.col("url").alias("_url"), F.col("text").alias("_text"), F.col("snapshot_id").alias("_sid"), F.col("fetch_status").alias("_sstatus"), F.col("evidence_layer").alias("_slayer"), snapshot_id(F.col("url"), F.col("text")).alias("_aid"), content_hash(F.col("text")).alias("_ahash"))
    joined = cited.join(rows, "url", "left").join(kept, "_path", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    fails = lambda check, message: F.struct(F.lit(check).alias("check"), F.lit(message).alias("message"))
    broken = F.when(F.col("_known").isNull(), fails("C1", "missing")).when(F.col("_there").isNull(), fails("C4", "no snapshot"))
    broken = broken.when(~same("_url", "url"), fails("C1", "another url")).when(F.col("_text").isNull(), fails("C4", "no text"))
    broken = broken.when(~(same("_hash", "_ahash") & same("_id", "_aid") & same("_sid", "_aid")), fails("C4", "fingerprint"))
    readable = F.coalesce(F.col("_ahash") != "", F.lit(False))
    strong = readable & F.coalesce((F.col("_status") == "full") & (F.col("_sstatus") == "full") & F.col("_layer").isin("L1", "L2") & F.col("_slayer").isin("L1", "L2"), F.lit(False))
    core = F.coalesce((F.col("importance") == "core") & F.col("kind").isin("fact", "inference"), F.lit(False))
    judged = joined.withColumn("_broken", broken)
    weak = F.col("_broken").isNull() & ~strong
    return judged.select(
        "claim_id", "url", F.coalesce("_broken.check", F.when(weak, "C4")).alias("check"), F.when(F.col("_broken").isNotNull() | weak & core, "error").when(weak, "warn").alias("level"), F.coalesce("_broken.message", F.when(weak, "weak")).alias("message"),
        F.when(F.col("_broken").isNull() & readable, F.col("_text")).alias("text"),
    )


def without_evidence(claims: DataFrame) -> DataFrame:
    """claim_id, level of facts and inferences that name no evidence."""
    bare = claims.where("kind in ('fact', 'inference') and coalesce(size(evidence), 0) <= 0")
    return bare.select("claim_id", F.when(F.col("importance") == "core", "error").otherwise("warn").alias("level")).distinct()


def bodies(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """claim_id, text of the bodies that each claim cites, where articles are taken as they are."""
    return claim_evidence(claims, articles).where("text <> ''").select("claim_id", "text")


def unsupported_tokens(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """claim_id, label, token that no cited body (texts: claim_id, text) holds with digit boundaries. Bodies stay apart; a hash join by claim."""
    own = texts.where("text is not null").select("claim_id", comparable(F.col("text")).alias("body"))
    wanted = tokens(claims)
    quoted = F.concat(F.lit(r"(?i)(?<![0-9.])\Q"), F.col("token"), F.lit(r"\E(?![0-9.])"))
    hit = F.expr("body rlike pattern")
    joined = wanted.withColumn("pattern", quoted).join(own, "claim_id", "left")
    return joined.groupBy("claim_id", "label", "token").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("held")).where("not held").drop("held")


#: Paragraph lines that begin with > and hold something, as one block.
BLOCK = r"(?m)(?:^[ \t]*>[ \t]?[^\n]*[^\s>][^\n]*(?:\n|$))+"


def quotes(text: Column) -> Column:
    """The quotations of a text: in quotation marks, and blocks of lines that begin with >."""
    marked = F.transform(F.regexp_extract_all(text, F.lit(QUOTE), 0), lambda x: F.substring(x, 2, F.length(x) - 2))
    blocks = F.transform(F.regexp_extract_all(text, F.lit(BLOCK), 0), lambda x: F.rtrim(F.regexp_replace(F.regexp_replace(x, r"(?m)^[ \t]*>[ \t]?", ""), r"\n$", "")))
    return F.array_distinct(F.concat(marked, blocks))


def claim_quotes(claims: DataFrame, report_quotes: list[str] = []) -> DataFrame:  # noqa: B006
    """claim_id, quote, needle of the facts: their own quotations, and those of the report that stand in their text."""
    own = quotes(F.col("text"))
    if report_quotes:
        said = F.array(*[F.struct(F.lit(q).alias("quote"), F.lit(folded(q)).alias("needle")) for q in dict.fromkeys(report_quotes)])
        own = F.array_distinct(F.concat(own, F.transform(F.filter(said, lambda q: (q.needle != "") & F.contains(F.col("_folded"), q.needle)), lambda q: q.quote)))
    facts = claims.where("kind = 'fact'").select("claim_id", "text", fold(F.col("text")).alias("_folded"))
    return facts.select("claim_id", F.explode(own).alias("quote")).distinct().withColumn("needle", dated(fold(F.col("quote"))))


def unsupported_quotes(claims: DataFrame, texts: DataFrame, report_quotes: list[str] = []) -> DataFrame:  # noqa: B006
    """claim_id, quote that stands verbatim (folded, dates in one spelling) in none of the cited bodies (texts: claim_id, text)."""
    own = texts.where("text is not null").select("claim_id", dated(fold(F.col("text"))).alias("body"))
    joined = claim_quotes(claims, report_quotes).join(own, "claim_id", "left")
    return joined.groupBy("claim_id", "quote").agg(F.bool_or(F.coalesce(F.contains("body", "needle"), F.lit(False))).alias("held")).where("not held").drop("held")


def core_coverage(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Core facts and inferences, and those whose evidence is all full text of layer 1 or 2; the share is NULL without any."""
    rows = claim_evidence(claims.where("importance = 'core' and kind in ('fact', 'inference')"), articles)
    strong = F.coalesce((F.col("fetch_status") == "full") & F.col("evidence_layer").isin("L1", "L2") & (F.col("text") != ""), F.lit(False))
    per = rows.groupBy("claim_id").agg(F.bool_and(strong).alias("strong"))
    core = claims.where("importance = 'core' and kind in ('fact', 'inference')").select("claim_id").distinct()
    joined = core.join(per, "claim_id", "left")
    covered = F.count_if(F.coalesce("strong", F.lit(False)))
    return joined.agg(F.count("*").alias("core_claims"), covered.alias("covered"), F.try_divide(covered.cast("double"), F.count("*")).alias("share"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """claim_id, change between two ledgers of claims: added, revised (other text, kind, importance or evidence) or withdrawn."""
    told = F.sha2(F.to_json(F.struct(fold(F.col("text")).alias("t"), "kind", "importance", F.array_sort("evidence").alias("e"))), 256)
    one = lambda df, name: df.groupBy("claim_id").agg(F.max(told).alias(name))
    both = one(before, "a").join(one(after, "b"), "claim_id", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "withdrawn").when(F.col("a") != F.col("b"), "revised")
    return both.select("claim_id", change.alias("change")).where("change is not null")


def verifiability(articles: DataFrame, claims: DataFrame) -> DataFrame:
    """The share of articles that have url, access time, snapshot and a quotation taken from their text; NULL without articles."""
    said = claims.where("kind = 'fact'").select(F.explode(quotes(F.col("text"))).alias("quote"), "claim_id", "evidence").where("quote <> ''")
    quoted = said.select("claim_id", dated(fold(F.col("quote"))).alias("needle"), F.explode("evidence").alias("url")).distinct()
    held = articles.where("url <> ''").select("url", dated(fold(F.col("text"))).alias("body")).join(quoted, "url").where("contains(body, needle)").select("url").distinct().withColumn("_quoted", F.lit(True))
    rows = articles.join(held, "url", "left")
    sound = (F.col("url") != "") & F.col("fetched_at").isNotNull() & (F.col("text") != "") & F.coalesce("_quoted", F.lit(False))
    return rows.agg(F.avg(F.coalesce(sound, F.lit(False)).cast("double")).alias("share"))


def claim_problems(claims: DataFrame) -> DataFrame:
    """claim_id, rule: what a ledger of claims must not have. The rules are those of a ledger file, over any number of claims."""
    rules = {
        "text": fold(F.col("text")) == "",
        "kind": ~F.coalesce(F.col("kind").isin("fact", "inference", "assumption", "company"), F.lit(False)),
        "importance": ~F.coalesce(F.col("importance").isin("core", "supporting"), F.lit(False)),
        "evidence": F.exists(F.coalesce("evidence", F.array().cast("array<string>")), lambda u: ~F.coalesce(u.rlike(r"^https?://[^\s/?#]+\S*$"), F.lit(False))),
        "repeated evidence": F.size(F.array_distinct("evidence")) < F.size("evidence"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(rule)) for rule, bad in rules.items()]))
    each = claims.select("claim_id", F.explode(broken).alias("rule")).distinct()
    repeated = claims.groupBy("claim_id").count().where("count > 1").select("claim_id", F.lit("repeated").alias("rule"))
    return each.unionByName(repeated)
