"""Bodies in HTML, Markdown, wiki text or LaTeX to clean text that keeps headings, lists, tables, code and formulas.

Each body is parsed to blocks, every block with its element path (tag and class, from the root). The pages of one host are
merged into a site style tree: by path, how often each sequence of child tags (presentation) and each digit-folded text
(content) occurs. The importance of a branch blends the entropy of its presentation with the mean entropy of the contents
below it; a branch seen on enough pages whose importance is low shows the same everywhere, and is cut from each page.
The blocks that stay are written as clean text, and their markups are the record's.

Defined results: a NULL or empty body has no markup and gives NULL or an empty text; broken markup is read as far as it goes
and never fails; records that share a key give one row each for clean texts, and one row a key and markup for kinds; records
without a host form one host; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.frames import Columns, map_rows
from evidentia.session import cut, small, spread

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"

_TAGS = (
    "a abbr article aside b blockquote body br button caption center code col dd del div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins label li link main "
    "meta nav ol p pre s section select small span strike strong style script sub sup table tbody td tfoot th thead title tr u ul o:p"
).split()
_TAG = re.compile(rf"</?(?:{'|'.join(sorted(_TAGS, key=len, reverse=True))})(?:\s[^<>]*)?/?>|<!--.*?-->|<!doctype", re.I | re.S)
_ESCAPED = re.compile(rf"&(?:amp;)*lt;/?(?:{'|'.join(sorted(_TAGS, key=len, reverse=True))})(?:\s(?:(?!&(?:amp;)*[lg]t;).)*)?/?&(?:amp;)*gt;|&(?:amp;)*lt;!--", re.I | re.S)
_ENTITY = re.compile(r"&(?:#[0-9]{2,7}|#x[0-9a-f]{2,6}|[a-z][a-z0-9]{1,30});", re.I)
_VOID = {"br", "hr", "img", "input", "meta", "link", "col"}
_INLINE = {"a", "abbr", "b", "code", "del", "em", "font", "i", "ins", "label", "s", "small", "span", "strike", "strong", "sub", "sup", "u", "img", "o:p", "input"}
_HIDDEN = {"script", "style", "head", "iframe", "select", "button"}


class _Page(HTMLParser):
    """Blocks of an HTML body as (path, kind, text), and for each path the sequences of child tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = [["", []]]  # path step, child tags
        self.blocks: list[tuple[tuple[str, ...], str, str]] = []
        self.styles: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.row: list[str] | None = None

    def path(self) -> tuple[str, ...]:
        return tuple(x[0] for x in self.stack[1:])

    def flush(self) -> None:
        text = "".join(self.text)
        self.text = []
        if text.strip():
            steps = self.path()
            tags = [x.split(".")[0] for x in steps]
            kind = next((t for t in reversed(tags) if t in ("pre", "li", "td", "th", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "caption", "blockquote") or t in _HIDDEN), "p")
            if kind == "li":
                kind = "ol" if next((t for t in reversed(tags) if t in ("ol", "ul")), "") == "ol" else "ul"
            if self.row is not None and kind in ("td", "th"):
                self.row.append(" ".join(text.split()))
            else:
                self.blocks.append((steps, kind, text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.text.append("\n")
        if tag in _INLINE or tag == "br":
            return
        self.flush()
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd"):  # they end an open one of their own
            inner = [x[0].split(".")[0] for x in self.stack]
            stop = max((i for i, t in enumerate(inner) if t in ("ul", "ol", "table", "dl", "div")), default=0)
            if tag in inner[stop + 1 :]:
                self.handle_endtag(tag)
        self.stack[-1][1].append(tag)
        if tag in _VOID:
            return
        if tag == "tr":
            self.row = []
        own = dict(attrs).get("class") or ""
        self.stack.append([f"{tag}.{own.split()[0]}" if own.split() else tag, []])

    def handle_endtag(self, tag: str) -> None:
        if tag in _INLINE or tag in _VOID or all(x[0].split(".")[0] != tag for x in self.stack[1:]):
            return
        self.flush()
        while len(self.stack) > 1:
            self._close()
            if self.closed == tag:
                break

    def _close(self) -> None:
        step, children = self.stack[-1]
        self.closed = step.split(".")[0]
        self.styles.append(("/".join(self.path()), " ".join(children)))
        if self.closed == "tr" and self.row:
            self.blocks.append((self.path(), "row", " | ".join(self.row)))
        if self.closed == "tr":
            self.row = None
        self.stack.pop()

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def finish(self) -> None:
        self.close()
        self.flush()
        while len(self.stack) > 1:
            self._close()


_COMMANDS = (
    "section subsection subsubsection paragraph chapter title author textbf textit emph underline texttt item begin end cite footnote ref label href url caption centering hline frac sqrt sum prod int "
    "leq geq neq times cdot alpha beta gamma delta sigma lambda mu pi infty left right mathrm mathbf text tfrac dfrac ln log exp partial documentclass usepackage maketitle verb"
).split()
_COMMAND = re.compile(rf"\\(?:{'|'.join(_COMMANDS)})(?![a-zA-Z])|\\[a-zA-Z]+\*?\{{|\\[()\[\]](?=.)")
_FORMULA = re.compile(r"\$\$[^$]+\$\$|(?<![\\$0-9A-Za-z])\$(?=\S)(?:[^$\n]*(?:[\\^]|_\{|[A-Za-z)}]\s*[=<>]|[=<>]\s*[A-Za-z])[^$\n]*?)(?<=\S)\$(?![0-9$])")
_WIKI = re.compile(r"^={2,6}[^=\n].*?={2,6}\s*$|\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|'''[^'\n]|(?<!')''[^'\n]+''(?!')|^\{\|.*$|<ref[ >]", re.M)
_MARKDOWN = re.compile(
    r"^#{2,6} \S|\*\*[^*\n]+\*\*|(?<!\\)\[[^\[\]\n]+\]\([^()\s]+\)|^(?:```|~~~)|^\|?\s*:?-{3,}:?\s*\|[\s|:-]*$|^> \S|^[^\s|>#*+-].*\n(?:-{4,}|={4,})\s*$|(?<!`)`[^`\n]+`(?!`)|^(?:[-+] \S.*\n){1,}[-+] \S|^__[^_\n]+__", re.M
)
_WEAK = re.compile(r"^# \S|^(?:\* \S.*\n)+\* \S|^(?:[0-9]+\. \S.*\n)+[0-9]+\. .*\n*[-+*] \S", re.M)
_FENCE = re.compile(r"^(```|~~~).*?^\1\s*$|\\begin\{(verbatim|lstlisting)\}.*?\\end\{\2\}|<(syntaxhighlight|source|pre|nowiki)\b.*?</\3>", re.M | re.S)


#: Without any of these a text holds no markup of the kinds below.
_SIGNS = re.compile(r"[\\$`*#_=\[{'|>~+]|--|^- ", re.M)


def text_kinds(text: str) -> set[str]:
    """The markups other than HTML that a text holds; what stands in code blocks is not looked at."""
    kinds: set[str] = set()
    if not _SIGNS.search(text):
        return kinds
    bare = _FENCE.sub("\n", text)
    if bare is not text and any(m.group(1) for m in _FENCE.finditer(text)):
        kinds.add(MARKDOWN)
    if any(m.group(2) for m in _FENCE.finditer(text)):
        kinds.add(LATEX)
    if _COMMAND.search(bare) or _FORMULA.search(bare):
        kinds.add(LATEX)
    if _WIKI.search(bare):
        kinds.add(WIKI)
    if _MARKDOWN.search(bare) or WIKI not in kinds and _WEAK.search(bare):
        kinds.add(MARKDOWN)
    return kinds


Block = tuple[str, str, str, list[str]]


def parse(body: str) -> tuple[list[Block], list[tuple[str, str]], bool]:
    """Blocks (path, kind, text, markups of the text) and styles of a body, and whether it is HTML."""
    is_html = False
    for _ in range(3):
        if "lt;" not in body or not _ESCAPED.search(body):
            break
        is_html = True
        body = html.unescape(body)
    if "<" in body and _TAG.search(body):
        is_html = True
        page = _Page()
        page.feed(body)
        page.finish()
        blocks, styles = page.blocks, page.styles
    else:
        if "&" in body and any(html.unescape(m.group()) != m.group() for m in _ENTITY.finditer(body)):
            is_html = True
            body = html.unescape(body)
        blocks, styles = [((), "p", body)], []
    out: list[Block] = []
    for steps, kind, text in blocks:
        path = "/".join(steps)
        if kind in _HIDDEN or kind == "pre":
            out.append((path, kind, text, []))
            continue
        own = text_kinds(text)
        marks = sorted(own)
        out += [(path, k, t, marks) for k, t in _lines(text, kind, own)] if own or kind == "p" else [(path, kind, text, marks)]
    return out, styles, is_html


_TEX = [
    (re.compile(r"\\footnote\{([^{}]*)\}"), r" (\1)"),
    (re.compile(r"~?\\(?:cite|ref|label)[pt]?\{[^{}]*\}"), ""),
    (re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:textbf|textit|emph|underline|texttt|mbox|text|url)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\([%&#_{}$])"), r"\1"),
    (re.compile(r"~"), " "),
]
_TEX_HEAD = re.compile(r"^\\((?:sub)*section|chapter|paragraph|title)\*?\{(.*)\}\s*$")
_MATH = re.compile(r"\\begin\{(equation|align|displaymath|gather)\*?\}(.*?)\\end\{\1\*?\}", re.S)


def _lines(text: str, kind: str, kinds: set[str]) -> Iterator[tuple[str, str]]:
    """The blocks of a text that is Markdown, wiki text, LaTeX or plain."""
    if LATEX in kinds:
        text = _MATH.sub(lambda m: f"$${m.group(2).strip()}$$", text)
    fence = ""
    for line in text.split("\n"):
        bare = line.strip()
        if fence:
            if bare.startswith(fence):
                fence = ""
            else:
                yield "pre", line
            continue
        if MARKDOWN in kinds and bare[:3] in ("```", "~~~"):
            fence = bare[:3]
            continue
        if LATEX in kinds:
            if m := re.match(r"\\begin\{(verbatim|lstlisting)\}", bare):
                fence = f"\\end{{{m.group(1)}}}"
                continue
            if m := _TEX_HEAD.match(bare):
                yield {"section": "h2", "subsection": "h3", "subsubsection": "h4"}.get(m.group(1), "h1"), m.group(2)
                continue
            if re.match(r"\\(?:begin|end)\{|\\(?:hline|centering|maketitle)\b", bare):
                continue
            table = bare.endswith(r"\\") and "&" in bare
            if table:
                yield "row", " | ".join(x.strip() for x in re.split(r"(?<!\\)&", bare[:-2])).replace("\\%", "%")
                continue
            item = bare.startswith("\\item")
            if "$" not in bare and not bare.startswith(("\\(", "\\[")):
                for pattern, to in _TEX:
                    bare = pattern.sub(to, bare)
            if item:
                yield "ul", bare.removeprefix("\\item").strip()
                continue
        if WIKI in kinds:
            if m := re.match(r"^(={2,6})\s*(.+?)\s*\1$", bare):
                yield f"h{len(m.group(1))}", m.group(2)
                continue
            if bare[:2] in ("{|", "|}", "|-"):
                continue
            if bare[:1] in "|!" and bare:
                yield "row", " | ".join(x.strip() for x in re.split(r"\|\||!!", bare[1:]))
                continue
            bare = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", bare)
            bare = re.sub(r"\{\{[^{}]*\}\}", "", bare).replace("'''", "").replace("''", "")
            if bare[:2] in ("# ", "* "):
                yield "ol" if bare[0] == "#" else "ul", bare[2:]
                continue
            bare = bare.lstrip(":;")
        if MARKDOWN in kinds:
            if m := re.match(r"^(#{1,6}) (.*?)#*$", bare):
                yield f"h{len(m.group(1))}", _plain(m.group(2))
                continue
            if re.fullmatch(r"\|?[\s:|-]*-{3,}[\s:|-]*", bare):
                continue
            if bare.startswith("|") and bare.endswith("|") and len(bare) > 2:
                yield "row", " | ".join(_plain(x.strip()) for x in bare.strip("|").split("|"))
                continue
            if m := re.match(r"^([-+*]|[0-9]+\.) (.*)$", bare):
                yield "ol" if m.group(1)[0].isdigit() else "ul", _plain(m.group(2))
                continue
            bare = _plain(bare.removeprefix("> "))
        if bare:
            yield kind, bare


def _plain(text: str) -> str:
    text = re.sub(r"!?\[([^\[\]]+)\]\([^()\s]+\)", r"\1", text)
    return re.sub(r"\*\*|__|(?<!`)`(?!`)", "", text)


def _branches(path: str) -> list[str]:
    """A path and all paths above it."""
    return [path[:i] for i, c in enumerate(path) if c == "/"] + [path] if path else []


def render(blocks: list[Block], low: set[str]) -> str:
    """The clean text of the blocks that stand in no branch of `low`."""
    out: list[str] = []
    code = False
    for path, kind, text, _ in blocks:
        if kind in _HIDDEN or low and not low.isdisjoint(_branches(path)):
            continue
        if code != (kind == "pre"):
            out.append("```")
            code = not code
        if kind == "pre":
            out.append(text.strip("\n"))
            continue
        text = "\n".join(x for x in (" ".join(y.split()) for y in text.split("\n")) if x)
        if text:
            out.append({"ul": "- ", "ol": "1. ", "dt": "- ", "dd": "  "}.get(kind, "#" * int(kind[1]) + " " if re.fullmatch("h[1-6]", kind) else "") + text)
    return "\n".join([*out, *["```"] * code])


_PARSED = "k {kind}, h string, is_html boolean, blocks array<struct<path:string,kind:string,text:string,marks:array<string>>>, styles array<struct<path:string,style:string>>"


def parsed(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """k, h and the parse of every record: each body is parsed once, what follows works on this table."""
    docs = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(host), F.lit("")).alias("h")))

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for k, t, h in zip(b["k"], b["t"], b["h"], strict=True):
                blocks, styles, is_html = parse(t) if t else (None if t is None else [], [], False)
                yield k, h, is_html, blocks, styles

    return cut(map_rows(docs, run, _PARSED.format(kind=dict(docs.dtypes)["k"]), chunk=500))


def _above(path: Column) -> Column:
    """A path and all paths above it."""
    steps = F.split(path, "/")
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")))


def style_tree(pages: DataFrame, gamma: float = 0.5) -> DataFrame:
    """h, path, pages, importance of every branch of the merged pages, which parsed() gives."""
    nodes = pages.where("is_html")
    seen = nodes.select("h", F.explode(F.array_distinct(F.flatten(F.transform("blocks.path", _above)))).alias("path"), F.lit("page").alias("kind"), F.lit(0).cast("long").alias("v"))
    style = nodes.select("h", F.explode("styles").alias("x")).select("h", "x.path", F.lit("style").alias("kind"), F.xxhash64("x.style").alias("v"))
    text = nodes.select("h", F.explode("blocks").alias("x")).where("x.path <> ''").select("h", "x.path", F.lit("text").alias("kind"), F.xxhash64(F.regexp_replace(F.trim("x.text"), "[0-9]+", "#")).alias("v"))
    each = seen.unionByName(style).unionByName(text).groupBy("h", "path", "kind", "v").agg(F.count("*").alias("n"))
    totals = each.groupBy("h", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    # -sum(p ln p) / ln m, with p = n / m: 0 where all are alike, 1 where all differ or there is but one
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).otherwise(F.lit(1.0))
    by_kind = cut(totals.select("h", "path", "kind", "m", entropy.alias("e")))
    content = by_kind.where("kind = 'text'").select("h", F.explode(_above(F.col("path"))).alias("path"), "m", "e").groupBy("h", "path").agg((F.sum(F.col("m") * F.col("e")) / F.sum("m")).alias("text_e"))
    own = by_kind.groupBy("h", "path").agg(F.max(F.when(F.col("kind") == "page", F.col("m"))).alias("pages"), F.max(F.when(F.col("kind") == "style", F.col("e"))).alias("style_e"))
    joined = own.where("pages is not null").join(content, ["h", "path"], "left")
    importance = F.when(F.col("text_e").isNull(), F.col("style_e")).otherwise(gamma * F.least("style_e", "text_e") + (1 - gamma) * F.col("text_e"))
    return joined.select("h", "path", "pages", F.coalesce(importance, F.lit(1.0)).alias("importance"))


def _with_low(pages: DataFrame, importance: float, least: int, gamma: float) -> DataFrame:
    """The parsed pages with `low`, the branches of their host that show the same everywhere."""
    tree = style_tree(pages, gamma)
    low = cut(tree.where((F.col("importance") < importance) & (F.col("pages") >= least)).groupBy("h").agg(F.collect_set("path").alias("low")))
    return pages.join(small(low), "h", "left").withColumn("low", F.coalesce("low", F.array().cast("array<string>")))


def markups(df: DataFrame, key: str, text: str, host: str, importance: float = 0.25, pages: int = 10, gamma: float = 0.5) -> DataFrame:
    """key, markup: the kinds of each record's content; what stands only in branches that are cut is the site's, not the record's."""
    rows = _with_low(parsed(df, key, text, host), importance, pages, gamma)
    kept = F.filter("blocks", lambda b: ~F.arrays_overlap(_above(b["path"]), F.col("low")))
    own = F.array_union(F.flatten(F.transform(kept, lambda b: b["marks"])), F.when(F.col("is_html"), F.array(F.lit(HTML))).otherwise(F.array().cast("array<string>")))
    return rows.where("k is not null").select(F.col("k").alias(key), F.explode(own).alias("markup")).distinct()


def cleaned(df: DataFrame, key: str, text: str, host: str, importance: float = 0.25, pages: int = 10, gamma: float = 0.5) -> DataFrame:
    """key and clean text of every record."""
    rows = _with_low(parsed(df, key, text, host), importance, pages, gamma)

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for k, blocks, low in zip(b["k"], b["blocks"], b["low"], strict=True):
                yield k, None if blocks is None else render([(x["path"], x["kind"], x["text"], ()) for x in blocks], set(low))

    return map_rows(rows.select("k", "blocks", "low"), run, f"`{key}` {dict(rows.dtypes)['k']}, clean_text string")
