"""Whether a review is complete: every case, every rubric item once, all passed, each with a reason, by another person."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def complaints(expected: DataFrame, reviews: DataFrame, producer: str, reviewer: str) -> DataFrame:
    """case_id, complaint. expected: case_id, n_items. reviews: case_id, item, passed, rationale."""
    spark = expected.sparkSession
    known = reviews.join(expected, "case_id")
    rule = lambda df, words: df.select("case_id", F.lit(words).alias("complaint")).distinct()
    sound = known.where("item between 1 and n_items")
    done = sound.groupBy("case_id").agg(F.collect_set("item").alias("items"), F.count("*").alias("n"))
    full = expected.join(done, "case_id", "left")
    lacks = F.size(F.array_except(F.sequence(F.lit(1), F.col("n_items")), F.coalesce("items", F.array().cast("array<int>")))) > 0
    parts = [
        rule(reviews.join(expected, "case_id", "left_anti"), "unknown case"),
        rule(expected.join(reviews, "case_id", "left_anti"), "case not executed"),
        rule(known.where("not coalesce(item between 1 and n_items, false)"), "invalid item"),
        rule(full.where(F.size("items") < F.col("n")), "repeated item"),
        rule(full.where(lacks), "rubric incomplete"),
        rule(known.where("not coalesce(passed, false)"), "failed or ungraded"),
        rule(known.where("trim(coalesce(rationale, '')) = ''"), "no rationale"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if not producer.strip() or not reviewer.strip() or producer.strip().casefold() == reviewer.strip().casefold():
        out = out.unionByName(spark.createDataFrame([(None, "producer and reviewer must be two persons")], out.schema))
    return out


def read_cases(spark: SparkSession, path: str, kind: str = "analysis") -> DataFrame:
    """case_id, n_items of the cases of a kind in a specification file; a file of another shape raises."""
    with open(path, encoding="utf-8-sig") as f:
        spec = json.load(f)
    cases = spec.get("evals") if isinstance(spec, dict) else None
    if not isinstance(cases, list) or any(not isinstance(c, dict) or not isinstance(c.get("id"), int) for c in cases):
        raise ValueError("the specification must list cases with numbers")
    return spark.createDataFrame([(c["id"], len(c.get("expectations") or [])) for c in cases if c.get("kind") == kind], "case_id int, n_items int")


def template(cases: DataFrame) -> dict:
    """An ungraded submission for the cases."""
    rows = cases.orderBy("case_id").collect()  # a rubric has few cases
    return {"schema_version": 1, "producer": "", "reviewer": "", "cases": [{"id": r.case_id, "report": "", "claims": "", "evidence": "", "reviews": [{"expectation": i, "pass": False, "rationale": ""} for i in range(1, r.n_items + 1)]} for r in rows]}


def read_submission(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str, str]:
    """Reviews (case_id, item, passed, rationale), artifacts (case_id, report, claims, evidence), producer and reviewer of a file."""
    with open(path, encoding="utf-8-sig") as f:
        raw = json.load(f)
    if not isinstance(raw, dict) or raw.get("schema_version") != 1 or not isinstance(raw.get("cases"), list):
        raise ValueError("schema_version must be 1 and cases a list")
    cases = [c for c in raw["cases"] if isinstance(c, dict) and type(c.get("id")) is int]
    number = lambda x: x if type(x) is int else None
    reviews = [(c["id"], number(r.get("expectation")), r.get("pass") is True, r.get("rationale") if isinstance(r.get("rationale"), str) else None) for c in cases for r in c.get("reviews") or [] if isinstance(r, dict)]
    given = lambda c, k: c[k] if isinstance(c.get(k), str) and c[k].strip() else None
    artifacts = [(c["id"], given(c, "report"), given(c, "claims"), given(c, "evidence")) for c in cases]
    return (
        spark.createDataFrame(reviews, "case_id int, item int, passed boolean, rationale string"),
        spark.createDataFrame(artifacts, "case_id int, report string, claims string, evidence string"),
        str(raw.get("producer") or ""), str(raw.get("reviewer") or ""),
    )


def audited(spark: SparkSession, artifacts: DataFrame, base: str) -> DataFrame:
    """case_id, complaint of the artifacts: one is missing or can't be read, or the strict audit of the report finds errors.

    The evidence of a case is a parquet table of articles; paths are relative to base and must not lead out of it.
    """
    from evidentia.__main__ import claims_of
    from evidentia.operators import report
    from evidentia.operators.snapshots import is_contained

    out: list[tuple[int, str]] = []
    for row in artifacts.orderBy("case_id").collect():  # a submission has few cases
        lacking = [k for k in ("report", "claims", "evidence") if not row[k]]
        led_out = [k for k in ("report", "claims", "evidence") if row[k] and not is_contained(row[k], base)]
        if lacking or led_out:
            out += [(row.case_id, f"missing {k}") for k in lacking] + [(row.case_id, f"{k} lies outside") for k in led_out]
            continue
        try:
            with open(os.path.join(base, row.report), encoding="utf-8") as f:
                text = f.read()
            claims = spark.createDataFrame(claims_of(os.path.join(base, row.claims)), "claim_id long, id string, text string, kind string, importance string, evidence array<string>")
            found = report.findings(spark, text, claims, *report.index_of(spark.read.parquet(os.path.join(base, row.evidence))))
            out += [(row.case_id, f"strict audit: {r['check']} ({r['n']})") for r in found.where("level = 'error'").groupBy("check").agg(F.count("*").alias("n")).orderBy("check").collect()]
        except Exception as e:  # noqa: BLE001  whatever is wrong with a case is a complaint about it
            out.append((row.case_id, str(e)[:200]))
    return spark.createDataFrame(out, "case_id int, complaint string")


def grade(spark: SparkSession, cases: DataFrame, path: str) -> dict:
    """ok, the cases completed and all complaints of a submission file."""
    reviews, artifacts, producer, reviewer = read_submission(spark, path)
    found = complaints(cases, reviews, producer, reviewer).unionByName(audited(spark, artifacts, os.path.dirname(os.path.abspath(path))))
    rows = [tuple(r) for r in found.orderBy("case_id", "complaint").collect()]
    bad = {c for c, _ in rows}
    done = sorted(r.case_id for r in cases.join(artifacts.select("case_id").distinct(), "case_id", "left_semi").collect() if r.case_id not in bad)
    return {"ok": not rows, "completed": done, "complaints": rows}
