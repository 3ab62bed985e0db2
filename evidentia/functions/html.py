"""HTML as Arrow functions: links, titles and bodies. Spark has no HTML type, so the tree lives inside the function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without content, elements that are noise, containers of bodies in order of preference, junk containers.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NOISE = {"script", "style", "noscript", "nav", "header", "footer", "form", "iframe", "svg"}
CONTAINERS = [
    "div.detail_content", "div.TRS_Editor", "div#zoom", "div#UCAP-CONTENT", "div.article-content", "div.article_content", "div.artical-content", "div.content_box", "div.pages_content",
    "div.xxgk_content", "div.zwxl-article", "div.view TRS_Editor", "article", "div.article", "div.content", "div.detail", "div.main-content", "main",
]
JUNK = re.compile(r"(nav|menu|crumb|breadcrumb|share|comment|related|recommend|search|footer|header|sidebar|banner|advert|广告|相关|推荐|分享|评论|导航|友情链接)", re.I)

_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "dt", "dd", "main", "td"}
_SIMPLE = re.compile(r"(\w+|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)")
_ATTR = re.compile(r"\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        """Text without noise elements, one line a block."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in NOISE:
                edge = ["\n"] if x.tag in _BLOCKS else []
                stack += [*edge, *reversed(x.children), *edge]
        lines = (" ".join(line.split()) for line in "".join(out).replace("​", "").replace("﻿", "").split("\n"))
        return "\n".join(x for x in lines if x)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_endtag(self, tag: str) -> None:
        node = self.now
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.now = node.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def tree(page: str) -> Node:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def _fits(node: Node, simple: str) -> bool:
    m = _SIMPLE.fullmatch(simple)
    if not m or not simple:
        raise ValueError(f"unsupported selector: {simple!r}")
    if m[1] and m[1] not in ("*", node.tag):
        return False
    classes = node.attrs.get("class", "").split()
    for mark in re.findall(r"[.#][\w-]+", re.sub(r"\[[^\]]*\]", "", m[2])):
        if mark[0] == "." and mark[1:] not in classes or mark[0] == "#" and node.attrs.get("id") != mark[1:]:
            return False
    for name, op, value in _ATTR.findall(m[2]):
        have = node.attrs.get(name)
        if have is None or op and not {"=": have == value, "*=": value in have, "^=": have.startswith(value), "$=": have.endswith(value), "~=": value in have.split(), "|=": have == value or have.startswith(value + "-")}[op]:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Nodes by a subset of CSS: tag, .class, #id, [attr op value], descendants, > children, commas. Others raise."""
    out = []
    groups = _groups(selector)
    for node in root.walk():
        if node.parent is not None and any(_chain(node, g) for g in groups):
            out.append(node)
    return out


def _groups(selector: str) -> list[list[str]]:
    return [re.sub(r"\s*>\s*", " > ", g).split() for g in re.split(r",(?![^\[]*\])", selector)]


def _chain(node: Node, steps: list[str]) -> bool:
    if not steps or not _fits(node, steps[-1]):
        return False
    rest, up = steps[:-1], node.parent
    if not rest:
        return True
    if rest[-1] == ">":
        return up is not None and up.parent is not None and _chain(up, rest[:-1])
    while up is not None and up.parent is not None:
        if _chain(up, rest):
            return True
        up = up.parent
    return False


def links_of(page: str, selector: str | None = None) -> list[tuple[str, str, int]]:
    """href, text and position of each link; of a selected node without href its first link."""
    root = tree(page)
    out = []
    for node in select(root, selector) if selector else select(root, "a[href]"):
        if "href" not in node.attrs:
            node = next((x for x in node.walk() if x.tag == "a" and "href" in x.attrs), None)
        if node is not None and node.attrs["href"]:
            out.append((node.attrs["href"], node.text().replace("\n", " ").strip(), len(out)))
    return out


def title_of(root: Node, selector: str | None = None) -> str:
    """By the declared selector, the first h1, an element of just a title class, og:title, or the page title without the site's name."""
    for pick in [*([selector] if selector else []), "h1", '[class="article-title"]', '[class="title"]']:
        if text := next((x.text().replace("\n", " ").strip() for x in select(root, pick)), ""):
            return text[:200]
    named = {"og": "", "title": ""}
    for node in root.walk():
        if node.tag == "meta" and node.attrs.get("property") == "og:title":
            named["og"] = named["og"] or node.attrs.get("content", "").strip()
        elif node.tag == "title":
            named["title"] = named["title"] or re.split(r"\s*[|\-–—]\s*", node.text().replace("\n", " "))[0].strip()
    return (named["og"] or named["title"])[:200]


def body_of(root: Node, selectors: tuple[str, ...] = (), least: int = 200) -> tuple[str, str]:
    """The body and how it was found: selector, heuristic or fallback.

    One walk: the element of the best-ranked selector wins, of equals the first; else the longest block. Junk never counts,
    whoever declared it.
    """
    ranked = [(pick, _groups(pick)) for pick in dict.fromkeys([*selectors, *CONTAINERS]) if not JUNK.search(pick)]
    at, found, longest = len(ranked), "", ""
    for node in root.walk():
        if node.parent is None or JUNK.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"):
            continue
        rank = next((i for i, (_, groups) in enumerate(ranked[:at]) if any(_chain(node, g) for g in groups)), None)
        block = at == len(ranked) and node.tag in ("div", "article", "section", "td")
        if rank is None and not block:
            continue
        text = node.text()
        if rank is not None and len(text) >= least:
            at, found = rank, text
        elif block and least <= len(text) <= 60_000 and len(text) > len(longest):
            longest = text
    if found:
        return found, f"selector:{ranked[at][0]}"
    return (longest, "heuristic") if longest else (root.text(), "fallback")


def plain_body(page: str) -> str:
    """The text of a plain-text body that may come wrapped: what its <pre> elements hold, else the text of the page."""
    head = page[:2000].lower()
    if "<pre" in head or "<html" in head:
        root = tree(page)
        pres = [x for x in root.walk() if x.tag == "pre"]
        if text := "\n".join(x.text() for x in pres) if pres else root.text():
            return text
    return re.sub(r"<[^>]+>", " ", page)


_LINKS = T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType()), T.StructField("pos", T.IntegerType())]))
_BODY = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("how", T.StringType())])


def links(page: Column, selector: str | None = None) -> Column:
    @F.pandas_udf(_LINKS)
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: [] if x is None else [{"href": h, "text": t, "pos": p} for h, t, p in links_of(x, selector)])

    return run(page)


def extracted(page: Column, selectors: tuple[str, ...] = (), least: int = 200) -> Column:
    """title, text and how of each page."""

    @F.pandas_udf(_BODY)
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for x in pages:
            root = tree(x)
            rows.append((title_of(root), *body_of(root, selectors, least)))
        return pd.DataFrame(rows, columns=["title", "text", "how"])

    return run(page)


def plain(page: Column) -> Column:
    """plain_body() of each page."""

    @F.pandas_udf(T.StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: None if x is None else plain_body(x))

    return run(page)
