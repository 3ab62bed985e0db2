"""Every dealt operator over nulls, empty and very long texts, ties, repeats, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

LONG = "关于统一管理再担保业务试点若干措施的通知\n" + "第一条　抽查比例不低于12%，抽查发现问题的，一律公开通报。" * 20_000
CLASH = "a int, b int, c int, k int, s int, t int, n int, r int, f int, g int, h int, kind int, line int, block int, probe int, sig int, token int, low int, word int"
N_CLASH = CLASH.count("int")


def articles(spark, rows):
    """(id, arrival, source, text) with columns whose names the operators use inside."""
    schema = f"article_id long, arrival long, source_key string, title string, text string, docno string, {CLASH}"
    data = [(i, a, s, t and t[:30], t, "东财办〔2024〕1号", *[1] * N_CLASH) for i, a, s, t in rows]
    return spark.createDataFrame(data, schema)


TIES = [(1, 1, "s", "同一行\n另一行"), (1, 2, "s", "同一行\n另一行"), (None, 3, "s", "同一行"), (2, 4, None, "同一行"), (3, 5, "s", None), (4, 6, "s", ""), (5, 7, "s", LONG), (6, 8, "s", LONG)]


def operators():
    from evidentia.llm import encodings, lookalikes, near_duplicates, pages, pii, repeated_lines, residue

    return {
        "encodings": lambda d: encodings.repaired(d),
        "residue": lambda d: residue.residue(d),
        "lines": lambda d: repeated_lines.repeated_lines(d),
        "pages": lambda d: pages.furniture_lines(d),
        "lookalikes": lambda d: lookalikes.disguised(d, "article_id", ("text", "docno")),
        "near": lambda d: near_duplicates.near_duplicate_pairs(d),
        "groups": lambda d: near_duplicates.near_duplicate_groups(d),
        "pii": lambda d: pii.occurrences(d, "article_id"),
        "redacted": lambda d: pii.redacted(d, "secret", "article_id"),
    }


@pytest.mark.parametrize("name", ["encodings", "residue", "lines", "pages", "lookalikes", "near", "groups", "pii", "redacted"])
def test_awkward_rows(spark, name):
    op = operators()[name]
    assert op(articles(spark, [])).count() == 0
    rows = op(articles(spark, TIES)).collect()
    if name == "near":
        assert [tuple(r) for r in rows] == [(5, 6)]
    elif name == "groups":
        assert {(r.article_id, r.group_id, r.group_size) for r in rows} == {(5, 5, 2), (6, 5, 2)}
    elif name == "redacted":
        assert len(rows) == len(TIES) and {r.text for r in rows if r.article_id == 3} == {None}
    elif name != "lines":
        assert rows == []


def test_markup_and_mixing_and_leaks(spark):
    from evidentia.llm import leakage, markup, mixing
    from evidentia.llm.queries import TOKENIZER

    docs = "doc_id long, source string, text string, " + CLASH
    row = lambda i, s, t: (i, s, t, *[1] * N_CLASH)
    for data in ([], [row(None, None, None), row(1, "x", None), row(2, "x", ""), row(3, "x", LONG), row(3, "x", LONG)]):
        d = spark.createDataFrame(data, docs)
        cleaned = markup.cleaned(d, "doc_id", "text", "source").collect()
        assert len(cleaned) == len(data) and markup.markups(d, "doc_id", "text", "source").count() == 0
        items = spark.createDataFrame([(1, None), (2, ""), (3, "短")], "item_id long, text string")
        assert leakage.leaks(d, items).count() == 0 and leakage.leaks(d, items.limit(0)).count() == 0
        targets = spark.createDataFrame([("x", 0.5, 2), ("gone", 0.5, 1), (None, 0.1, 1)], "source string, target_share double, max_repeat int")
        drawn = mixing.draws(d, targets, TOKENIZER)
        assert drawn.where(F.col("uses") > 2).count() == 0
        shares = {r.source: r.actual_share for r in mixing.shares(drawn, targets).collect()}
        assert set(shares) == {"x", "gone"} and shares["gone"] == 0 and (not data or shares["x"] == 1)
