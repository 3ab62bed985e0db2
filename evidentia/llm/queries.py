"""The queries of the operators in this folder, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.encodings import garbled_values

    return garbled_values(table(spark, sf_dir, "article"))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled values with what could be put back."""
    from evidentia.llm.encodings import repaired

    return repaired(table(spark, sf_dir, "article"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.residue import residue

    return residue(table(spark, sf_dir, "article")).select("article_id")


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows left for analysis."""
    from evidentia.llm.residue import without_residue

    return without_residue(table(spark, sf_dir, "article")).select("article_id", "arrival", "fetch_status")


def _records(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from evidentia.session import small

    hosts = table(spark, sf_dir, "source_registry").select("source_key", "host")
    return table(spark, sf_dir, name).join(small(hosts), "source_key", "left")


def _both(spark: SparkSession, sf_dir: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    from pyspark.sql import functions as F

    one, two = (fn(_records(spark, sf_dir, name)).withColumn("table_name", F.lit(name)) for name in ("nfra_detail", "detail_1001"))
    return one.unionByName(two)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.markup import markups

    return _both(spark, sf_dir, lambda d: markups(d, "docid", "docclob", "host")).select("table_name", "docid", "markup")


def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean texts."""
    from evidentia.llm.markup import cleaned

    return _both(spark, sf_dir, lambda d: cleaned(d, "docid", "docclob", "host")).select("table_name", "docid", "clean_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.repeated_lines import repeated_lines

    return repeated_lines(table(spark, sf_dir, "article")).select("source_key", "line")


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts without the lines of p4_found."""
    from evidentia.llm.repeated_lines import repeated_lines, without_lines

    articles = table(spark, sf_dir, "article")
    return without_lines(articles, repeated_lines(articles))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.pages import furniture_lines
    from evidentia.llm.repeated_lines import repeated_lines

    articles = table(spark, sf_dir, "article")
    return furniture_lines(articles, source="source_key", notices=repeated_lines(articles))


def p5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, of whole pages only the policy."""
    from evidentia.llm.pages import main_bodies
    from evidentia.llm.repeated_lines import repeated_lines

    articles = table(spark, sf_dir, "article")
    return main_bodies(articles, source="source_key", notices=repeated_lines(articles))


def p5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main bodies of the HTML records by their DOM leaf blocks."""
    from evidentia.llm.pages import html_bodies

    return html_bodies(table(spark, sf_dir, "nfra_detail").where("docclob like '%<%'"), "docid", "docclob")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from evidentia.llm.encodings import garbled_values
    from evidentia.llm.lookalikes import disguised

    articles = table(spark, sf_dir, "article")
    found = disguised(articles, "article_id", ("text", "docno"))
    found = found.join(garbled_values(articles), ["article_id", "field_name"], "left_anti")
    claims = disguised(table(spark, sf_dir, "claim"), "claim_id", ("text",))
    one = found.select(F.lit("article").alias("table_name"), F.col("article_id").alias("record_id"), "field_name")
    return one.unionByName(claims.select(F.lit("claim").alias("table_name"), F.col("claim_id").alias("record_id"), "field_name"))


def p6_docnos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document numbers in one consistent form."""
    from evidentia.llm.lookalikes import consistent

    return consistent(table(spark, sf_dir, "article"), "arrival", "docno")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.near_duplicates import near_duplicate_pairs

    return near_duplicate_pairs(table(spark, sf_dir, "article"))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of the same policy."""
    from evidentia.llm.near_duplicates import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "article"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.leakage import leaks

    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return found.where("leak = 'verbatim'").select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each test item leaked: documents, the longest run and the highest shares."""
    from pyspark.sql import functions as F

    from evidentia.llm.leakage import leaks

    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("run").alias("longest_run"), F.max("item_share").alias("item_share"), F.sum((F.col("leak") == "paraphrase").cast("long")).alias("n_paraphrases"))


#: The tokenizer that problem 9 counts with; a path, never part of this repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def p9_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.mixing import draws

    return draws(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), TOKENIZER)


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources by their own token shares, made even enough for an entropy of 2.45 nats (13 equal sources have 2.56)."""
    from evidentia.llm.mixing import draws

    return draws(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), TOKENIZER, share=None, least_entropy=2.45)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actual share of each source."""
    from evidentia.llm.mixing import draws, shares

    targets = table(spark, sf_dir, "mix_target")
    return shares(draws(table(spark, sf_dir, "documents"), targets, TOKENIZER), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.pii import occurrences

    return occurrences(table(spark, sf_dir, "documents")).select("doc_id", "start_pos", "pii_type")


def p10_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links documents: each pseudonym with the documents and places it stands in, if more than one holds it."""
    from pyspark.sql import functions as F

    from evidentia.llm.pii import occurrences

    found = occurrences(table(spark, sf_dir, "documents"), secret="test key")
    return found.groupBy("pii_type", "pseudonym").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n")).where("n_docs > 1")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with placeholders; the key is a parameter of the operator, here a fixed one for the test."""
    from evidentia.llm.pii import redacted

    return redacted(table(spark, sf_dir, "documents"), "test key")


def queries() -> dict[str, Query]:
    return {name: fn for name, fn in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p4_cleaned": P4_CLEANED_SQL, "p7_found": P7_SQL, "p7_groups": P7_GROUPS_SQL, "p8_found": P8_SQL}


P4_SQL = r"""
WITH d AS (SELECT DISTINCT article_id, source_key, unnest(string_split(text, chr(10))) AS raw FROM article WHERE text IS NOT NULL AND source_key IS NOT NULL AND article_id IS NOT NULL),
l AS (SELECT DISTINCT article_id, source_key, regexp_replace(regexp_replace(raw, '^[\s\p{Z}\x0b\x1c-\x1f\x{85}]+|[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$', '', 'g'), '[0-9]+', '#', 'g') AS line FROM d),
n AS (SELECT source_key, count(DISTINCT article_id) AS total FROM article WHERE text IS NOT NULL GROUP BY 1)
SELECT source_key, line FROM l JOIN n USING (source_key) WHERE line <> '' GROUP BY source_key, line, total
HAVING count(*) >= 5 AND count(*) >= 0.15 * total
"""

_TRIMMED = r"regexp_replace(regexp_replace(x, '^[\s\p{Z}\x0b\x1c-\x1f\x{85}]+|[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$', '', 'g'), '[0-9]+', '#', 'g')"
P4_CLEANED_SQL = rf"""
WITH lines AS ({P4_SQL}), gone AS (SELECT source_key, list(line) AS out FROM lines GROUP BY 1)
SELECT arrival, CASE WHEN text IS NULL OR out IS NULL THEN text ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(out, {_TRIMMED})), chr(10)), '') END AS text
FROM article LEFT JOIN gone USING (source_key)
"""

#: The records long enough, their folded texts (t) and the pairs of different texts (x < y) that are near; shingles of all texts, exactly.
_NEAR = r"""
d AS (SELECT DISTINCT article_id AS k, lower(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', '', 'g')) AS t FROM article WHERE article_id IS NOT NULL AND length(text) >= 400),
c AS (SELECT t, row_number() OVER (ORDER BY t) AS c FROM (SELECT DISTINCT t FROM d)),
m AS (SELECT k, c FROM d JOIN c USING (t)),
s AS (SELECT DISTINCT c, substr(t, p, 8) AS g FROM c, unnest(range(1, length(t) - 6)) AS r(p)),
n AS (SELECT c, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.c AS x, b.c AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.c < b.c GROUP BY 1, 2),
near AS (SELECT x, y FROM o JOIN n a ON a.c = x JOIN n b ON b.c = y WHERE shared >= 0.7 * (a.n + b.n - shared))
"""
P7_SQL = rf"""
WITH {_NEAR}, pairs AS (SELECT a.k AS p, b.k AS q FROM near JOIN m a ON a.c = x JOIN m b ON b.c = y UNION ALL SELECT a.k, b.k FROM m a JOIN m b ON a.c = b.c)
SELECT DISTINCT least(p, q) AS article_id_a, greatest(p, q) AS article_id_b FROM pairs WHERE p <> q
"""
P7_GROUPS_SQL = rf"""
WITH RECURSIVE {_NEAR}, e AS (SELECT x AS u, y AS v FROM near UNION SELECT y, x FROM near UNION SELECT c, c FROM c),
reach(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v),
root AS (SELECT u AS c, min(v) AS g FROM reach GROUP BY 1), l AS (SELECT u AS c, count(*) AS links FROM e WHERE u <> v GROUP BY 1),
per AS (SELECT k, g, CAST(sum(coalesce(links, 0)) AS BIGINT) AS links FROM m JOIN root USING (c) LEFT JOIN l USING (c) GROUP BY 1, 2),
z AS (SELECT g, min(k) AS first, count(*) AS n FROM per GROUP BY 1 HAVING count(*) > 1)
SELECT k AS article_id, first AS group_id, n AS group_size, links FROM per JOIN z USING (g)
"""

P8_SQL = r"""
WITH i AS (SELECT item_id, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS t FROM eval_item),
d AS (SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, substr(t, p, 50) AS run FROM i, unnest(range(1, length(t) - 48)) AS r(p)),
w AS (SELECT doc_id, substr(t, p, 50) AS run FROM d, unnest(range(1, length(t) - 48)) AS r(p))
SELECT DISTINCT doc_id, item_id FROM w JOIN g USING (run)
"""
