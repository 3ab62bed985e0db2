"""python -m evidentia plan|collect|verify|doctor: the command line."""

from __future__ import annotations

import argparse
import datetime
import json
import sys


def _arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="evidentia")
    commands = parser.add_subparsers(dest="command", required=True)
    plan = commands.add_parser("plan", help="what a run would request")
    run = commands.add_parser("collect", help="a run over captured pages")
    for one in (plan, run):
        one.add_argument("--config", required=True, help="registry of sources, YAML or JSON")
        one.add_argument("--sources", default="", help="keys, separated by commas")
        one.add_argument("--since")
        one.add_argument("--until")
        one.add_argument("--days", type=int, help="the window ends today and is so many days long")
        one.add_argument("--keywords", default="")
        one.add_argument("--exclude", default="")
        one.add_argument("--max-fetch", type=int, default=40)
        one.add_argument("--contact", default="")
        one.add_argument("--json", action="store_true")
    run.add_argument("--captured", required=True, help="folder of captures: SOURCE/listing/FILE and SOURCE/detail/TIER/NAME")
    run.add_argument("--out", required=True, help="folder of snapshots, index and archive")
    verify = commands.add_parser("verify", help="audit a report against claims and evidence")
    verify.add_argument("report")
    mode = verify.add_mutually_exclusive_group()
    mode.add_argument("--claims", help="JSON ledger of claims")
    mode.add_argument("--legacy-checks-only", action="store_true", help="links, quotations, numbers and the whole index; no audit of claims")
    verify.add_argument("--allow-unknown-citations", action="store_true", help="unknown links are warnings, with --legacy-checks-only")
    verify.add_argument("--articles", required=True, help="parquet of articles")
    verify.add_argument("--json", action="store_true")
    doctor = commands.add_parser("doctor", help="whether this installation can run")
    doctor.add_argument("--config", help="a registry to check")
    args = parser.parse_args(argv)
    if args.command in ("plan", "collect"):
        if args.max_fetch < 1 or (args.days or 1) < 1:
            parser.error("--max-fetch and --days must be positive")
        if args.days and args.since:
            parser.error("--days and --since exclude each other")
        try:
            since, until = (datetime.date.fromisoformat(x) if x else None for x in (args.since, args.until))
        except ValueError as e:
            parser.error(str(e))
        if args.days:
            args.since = str((until or datetime.date.today()) - datetime.timedelta(args.days))
        if since and until and since > until:
            parser.error("--since lies after --until")
    return args


def checks(config: str | None) -> list[tuple[str, bool, str]]:
    """(check, ok, detail): Python and Spark versions, a working session, its shared folder, optional modules, a registry."""
    import importlib.util
    import platform

    import pyspark
    from pyspark.sql import SparkSession

    from evidentia.session import cut
    from evidentia.sources import registry

    out = [("python", sys.version_info >= (3, 10), platform.python_version()), ("spark", int(pyspark.__version__.split(".")[0]) >= 4, pyspark.__version__)]
    spark = SparkSession.builder.getOrCreate()
    try:
        out.append(("shared folder", cut(spark.range(1)).count() == 1, spark.conf.get("spark.checkpoint.dir", "")))
    except Exception as e:  # noqa: BLE001
        out.append(("shared folder", False, str(e)[:200]))
    out.append(("yaml (optional)", True, "there" if importlib.util.find_spec("yaml") else "missing: registries must be JSON"))
    if config:
        try:
            broken = registry.violations(registry.read(config))
            out.append(("registry", not broken, json.dumps(broken[:5], ensure_ascii=False)))
        except (OSError, ValueError, RuntimeError) as e:
            out.append(("registry", False, str(e)[:200]))
    return out


def claims_of(path: str) -> list[tuple]:
    """The rows of a claims ledger; repeated keys, NaN, a wrong version or wrong values raise ValueError."""

    def pairs(found):
        if len({k for k, _ in found}) < len(found):
            raise ValueError("a key is repeated")
        return dict(found)

    def constant(x):
        raise ValueError(f"{x} is not JSON")

    with open(path, encoding="utf-8-sig") as f:
        raw = json.load(f, object_pairs_hook=pairs, parse_constant=constant)
    if not isinstance(raw, dict) or type(raw.get("schema_version")) is not int or raw["schema_version"] != 1 or not isinstance(raw.get("claims"), list):
        raise ValueError("schema_version must be 1 and claims a list")
    ids, rows = set(), []
    for i, c in enumerate(raw["claims"], 1):
        if not isinstance(c, dict) or not str(c.get("id") or "").strip() or c["id"] in ids or not str(c.get("text") or "").strip():
            raise ValueError(f"claim {i}: id must be unique, text given")
        if c.get("kind") not in ("fact", "inference", "assumption", "company") or c.get("importance") not in ("core", "supporting"):
            raise ValueError(f"claim {i}: kind or importance is unknown")
        if any(not str(u).startswith(("http://", "https://")) for u in c.get("evidence") or []):
            raise ValueError(f"claim {i}: evidence must be links")
        ids.add(c["id"])
        rows.append((i, c["id"], c["text"], c["kind"], c["importance"], list(c.get("evidence") or [])))
    return rows


def main(argv: list[str] | None = None) -> int:
    args = _arguments(sys.argv[1:] if argv is None else argv)
    if args.command == "doctor":
        found = checks(args.config)
        print("\n".join(f"{'ok  ' if ok else 'FAIL'} {name}: {detail}" for name, ok, detail in found))
        return 0 if all(ok for _, ok, _ in found) else 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    return _verify(spark, args) if args.command == "verify" else _run(spark, args)


def _run(spark, args: argparse.Namespace) -> int:
    from evidentia.operators.collect import Options, run_captured
    from evidentia.sources import registry

    try:
        raw = registry.read(args.config)
    except (OSError, ValueError) as e:
        print(f"the registry can't be read: {e}", file=sys.stderr)
        return 2
    problem = registry.contact_problem(args.contact)
    if (broken := registry.violations(raw)) or problem:
        print(json.dumps(broken or problem, ensure_ascii=False), file=sys.stderr)
        return 2
    keys = [k for k in args.sources.split(",") if k]
    try:
        chosen = registry.select(raw["sources"], keys)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    if args.command == "plan":
        print("\n".join(registry.plan(spark, chosen, args.max_fetch).toJSON().collect()))
        return 0
    words = lambda x: [w for w in x.split(",") if w]
    options = Options(since=args.since, until=args.until, budget=args.max_fetch, keywords=words(args.keywords), unwanted=words(args.exclude))
    run, summary = run_captured(spark, raw, args.captured, args.out, options, keys)
    told = summary.first().asDict() | {"late": run.late, "by_source": [r.asDict() for r in run.counters.orderBy("source_key").collect()]}  # one row a source
    print(json.dumps(told, ensure_ascii=False) if args.json else "\n".join(f"{k}: {v}" for k, v in told.items()))
    return 0


def _verify(spark, args: argparse.Namespace) -> int:
    from evidentia.operators import report

    with open(args.report, encoding="utf-8") as f:
        text = f.read()
    articles = spark.read.parquet(args.articles)
    if args.legacy_checks_only:
        found = report.legacy_findings(spark, text, articles, "warn" if args.allow_unknown_citations else "error")
        told: dict = {}
    else:
        try:
            rows = claims_of(args.claims) if args.claims else None
        except (OSError, ValueError) as e:
            print(f"the ledger of claims is invalid: {e}", file=sys.stderr)
            return 2
        if rows is None:
            print("a strict audit needs --claims", file=sys.stderr)
            return 2
        claims = spark.createDataFrame(rows, "claim_id long, id string, text string, kind string, importance string, evidence array<string>")
        index, snapshots = report.index_of(articles)
        found = report.findings(spark, text, claims, index, snapshots)
        told = {"stats": report.statistics(spark, text, claims, index, snapshots, found).first().asDict()}
    verdict = report.verdict(found, strict=not args.legacy_checks_only).first()
    rows = [r.asDict() for r in found.collect()]  # findings about one report
    print(json.dumps({**verdict.asDict(), **told, "findings": rows}, ensure_ascii=False) if args.json else "\n".join([f"{'ok' if verdict.ok else 'not ok'}: {verdict.errors} errors, {verdict.warnings} warnings", *(f"{r['check']} {r['level']} {r['claim_id'] or ''} {r['detail']}" for r in rows)]))
    return 0 if verdict.ok else 2


if __name__ == "__main__":
    sys.exit(main())
