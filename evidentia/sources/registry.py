"""The registry of sources: read from YAML or JSON, checked rule by rule, selected by key."""

from __future__ import annotations

import json
import re

#: Layers, kinds of source and tiers that the registry may name.
LAYERS = ("L1", "L2", "L3", "L4", "L5")
KINDS = ("json_get", "json_api", "post_json", "shanghai_policy", "html_list", "rss", "atom", "feed", "sitemap", "render")
TIERS = ("api", "text", "html", "pdf", "render")
FLAGS = ("enabled", "allow_insecure_tls", "human_assist")


def read(path: str) -> dict:
    with open(path, encoding="utf-8-sig") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML registries need PyYAML; JSON ones don't") from e
    return yaml.safe_load(text) or {}


def violations(raw: object) -> list[tuple[str, str]]:
    """(key or position, rule) for every broken rule; none for a sound registry."""
    if not isinstance(raw, dict) or not isinstance(raw.get("sources"), list):
        return [("", "sources must be a list")]
    out, seen = [], set()
    for i, s in enumerate(raw["sources"]):
        key = s.get("key") if isinstance(s, dict) else None
        if not isinstance(key, str) or not key.strip():
            out.append((f"#{i}", "key is missing"))
            continue
        sections = {n: s.get(n) or {} for n in ("listing", "extract", "detail")}
        checks = [
            ("key is repeated", key in seen),
            *[(f"{f} must be true or false", f in s and not isinstance(s[f], bool)) for f in FLAGS],
            ("layer is unknown", s.get("layer", "L1") not in LAYERS),
            ("type is unknown", s.get("type", "html_list") not in KINDS),
            *[(f"{n} must be a mapping", not isinstance(x, dict)) for n, x in sections.items()],
        ]
        if all(isinstance(x, dict) for x in sections.values()):
            at = sections["listing"]
            checks += [
                ("listing.url must be http or https", not str(at.get("url") or "").startswith(("http://", "https://"))),
                ("pages, rows and items must be positive", min(int(at.get("pages") or 1), int(at.get("rows_per_page") or 20), int(s.get("max_items") or 20)) < 1),
                ("body bounds are invalid", int(s.get("min_body_chars") or 200) < 1 or int(s.get("max_body_chars") or 0) < 0 or int(s.get("days") or 0) < 0),
                ("tier is unknown", any(t not in TIERS for t in sections["detail"].get("tiers") or [])),
            ]
        seen.add(key)
        out += [(key, rule) for rule, broken in checks if broken]
    return out


def select(sources: list[dict], keys: list[str] | None = None) -> list[dict]:
    """The named sources, even if disabled, each once; without names the enabled ones of layers 1 and 2."""
    by_key = {s["key"]: s for s in sources}
    if keys:
        if unknown := [k for k in dict.fromkeys(keys) if k not in by_key]:
            raise ValueError("unknown sources: " + ", ".join(unknown))
        return [by_key[k] for k in dict.fromkeys(keys)]
    chosen = [s for s in sources if s.get("enabled", True) and s.get("layer", "L1") in ("L1", "L2")]
    if not chosen:
        raise ValueError("no source is selected")
    return chosen


def page_targets(source: dict) -> list[tuple[str, str]]:
    """(url, body) of each listing page: {page} counts from 1, {start} counts rows from 0."""
    at = source.get("listing") or {}
    rows, out = int(at.get("rows_per_page") or 20), []
    for page in range(1, int(at.get("pages") or 1) + 1):
        fill = lambda x, p=page: str(x or "").replace("{page}", str(p)).replace("{start}", str((p - 1) * rows)).replace("{rows}", str(rows))
        out.append((fill(at.get("url")), fill(at.get("body"))))
    return out


def plan(spark, sources: list[dict], budget: int = 40):
    """One row a source: its requests, tiers and caps. What a run would ask for, without asking."""
    rows = [(s["key"], s.get("layer", "L1"), s.get("type", "html_list"), [u for u, _ in page_targets(s)], list((s.get("detail") or {}).get("tiers") or ("api", "text", "html", "pdf")), int(s.get("max_items") or 20), budget) for s in sources]
    return spark.createDataFrame(rows, "source_key string, layer string, type string, requests array<string>, tiers array<string>, max_items int, budget int")


def contact_problem(contact: str | None) -> str | None:
    """Why a contact can't be sent along with requests: a template's placeholder, or characters beyond ASCII; None if it can."""
    if not contact:
        return None
    if not contact.isascii():
        return "the contact must be ASCII"
    return "the contact is a placeholder" if re.search(r"example\.(?:com|org|net)|your[-_ ]?(?:name|mail|email|org)|<[^<>]+>|\{[^{}]+\}", contact, re.I) else None


def table(spark, sources: list[dict]):
    """The registry as a table, with its defaults: layer L1, type html_list, 200 characters, 20 items."""
    rows = [(s["key"], s.get("name", s["key"]), s.get("region", ""), s.get("layer", "L1"), s.get("type", "html_list"), bool(s.get("enabled", True)), int(s.get("min_body_chars") or 200), int(s.get("max_items") or 20)) for s in sources]
    return spark.createDataFrame(rows, "source_key string, name string, region string, layer string, source_type string, enabled boolean, min_body_chars int, max_items int")


def read_table(rows) -> dict:
    """The registry that a table of sources stands for, as read() gives it; a registry has few sources."""
    named = [r.asDict() for r in rows.collect()]
    keep = {"source_key": "key", "name": "name", "region": "region", "layer": "layer", "source_type": "type", "enabled": "enabled", "min_body_chars": "min_body_chars", "max_items": "max_items"}
    return {"sources": [{to: r[c] for c, to in keep.items() if r[c] is not None} | {"listing": {"url": f"https://{r['host']}/list/{{page}}?s={{start}}", "pages": 3}} for r in named]}
