"""The physical plans that matter at scale: what reaches the scan, where windows cut early, what is broadcast."""

import pytest

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "holds", "lacks"),
    [
        ("flt01_window", ["PushedFilters: [Or(IsNull(pub_date)", "ReadSchema: struct<arrival:bigint,pub_date:date>"], ["Exchange"]),
        ("agg01_source_counters", ["ReadSchema: struct<source_key:string,fetch_status:string>", "partial_count"], ["text"]),
        ("lim01_source_cap", ["WindowGroupLimit"], ["text"]),
        ("win02_keep_first", ["WindowGroupLimit"], ["text"]),
        ("lim02_fetch_queue", ["TakeOrderedAndProject"], ["text"]),
        ("jn16_unmended", ["LeftAnti"], []),
        ("hsh02_snapshot_id", ["ReadSchema: struct<arrival:bigint,url:string,text:string>"], []),
    ],
)
def test_plan(spark, name, holds, lacks):
    from evidentia.plans.queries import QUERIES

    text = plan(QUERIES[name](spark, SF))
    assert all(x in text for x in holds), text
    assert not any(x in text for x in lacks), text


def test_no_cartesian_products(spark):
    from evidentia.plans.queries import QUERIES

    lazy = ["jn01_article_source", "jn02_first_seen", "jn04_claim_evidence", "aud_c2_quotes", "aud_c3_tokens", "aud_c4_strength", "agg13_core_coverage", "set05_unknown_citations", "snk04_upsert", "win05_versions", "aud_c4_gates", "aud_c5a_uncovered", "aud_c5b_uncited", "aud_c5c_foreign", "jn03_unknown_links", "lim02_fetch_queue", "src09_tries", "prj12_upgrade", "win04_best_outcome", "agg08_claims", "doc07_claim_changes", "src17_snapshot_texts", "agg06_citations", "src03_first_list", "prj05_template_fields", "cls10_open"]
    for name in lazy:
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_small_checks_before_it_broadcasts(spark):
    from evidentia.session import small

    rows = spark.range(100)
    hinted = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(small(rows, 100)) and not hinted(small(rows, 99))


def test_registered_functions(spark):
    from evidentia.functions.register import register

    register(spark)
    assert spark.sql("SELECT nfkc('Ａ１'), url_join('http://a.example/b/', '../c'), decode_any(X'D5FEB2DF', NULL)").first()[:] == ("A1", "http://a.example/c", "政策")
    assert spark.sql("SELECT * FROM html_links('<a href=\"/x\">一</a><a href=\"/y\">二</a>')").count() == 2
