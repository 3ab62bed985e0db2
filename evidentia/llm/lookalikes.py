"""One consistent form for text that looks alike but differs in its characters.

Tokens with full-width letters, marks apart from their letters, invisible characters, odd spaces, compatibility ideographs or
letters of another script are matched against the corpus vocabulary: both sides meet by skeleton, the words of a bucket form a
trie, and a weighted edit automaton walks it with the token. Look-alikes and ignorables cost nothing, a letter of another script
that the table of look-alikes lacks costs LETTER against any Latin letter, other edits more than is allowed; of the words
reached at the least cost, the most frequent is the canonical spelling. Tokens that reach none, and single characters, are
normalised by table. A word wholly in another script stays, unless every letter has a look-alike and the vocabulary holds
the word they spell at least twice.

Defined results: NULL and empty values have nothing to normalise; values of any length are worked whole; rows that share a key
give each field once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.frames import Columns, map_rows
from evidentia.session import cut, is_small, spread

#: Letters of other scripts and the Latin letters that they look like: fixed values.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХѴаеѕіјорсухԁԛԝһӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχγϲ" "ՕՏսօոհցզ",
        "ABESIJKMHOPCTYXVaesijopcyxdqwhl" "ABEZHIKMNOPTYXaiknoptuxyc" "OSuonhgq".replace("aiknoptuxyc", "aikvoptuxyc"),
        strict=True,
    )
)
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿"
SPACES = "   -   "
_COMPAT = "⺀-⻳⼀-⿕豈-﫿"
_WIDE = "０-９Ａ-Ｚａ-ｚ"
_OTHER = "Ͱ-ϿЀ-ԯԱ-ևᎠ-ᏽⲀ-ⳮ"
#: What makes a value worth a look.
SUSPECT = f"[{_WIDE}̀-ͯ{IGNORABLE}{SPACES}{_COMPAT}{_OTHER}]"

_SUSPECT = re.compile(SUSPECT)
_TOKEN = re.compile(rf"[A-Za-z0-9À-ɏ̀-ͯ{_OTHER}{_WIDE}{IGNORABLE}Ḁ-ỿ'’./-]+|[{_COMPAT}]|[{SPACES}]")
_WORD = re.compile(r"[A-Za-z0-9À-ɏḀ-ỿ]+(?:['’./-][A-Za-z0-9À-ɏḀ-ỿ]+)*")
_PARTS = re.compile(r"(['’./-])")
_IGNORED = re.compile(f"[{IGNORABLE}]")
_LATIN = re.compile("[A-Za-zÀ-ɏＡ-Ｚａ-ｚ]")
_FOREIGN = re.compile(f"[{_OTHER}]")


def _single(char: str) -> str:
    """The plain form of one character by table; look-alikes stay."""
    if re.match(f"[{SPACES}]", char):
        return " "
    return unicodedata.normalize("NFKC", char) if re.match(f"[{_WIDE}{_COMPAT}]", char) else char


def by_table(token: str) -> str:
    """Ignorables dropped, wide and compatibility forms and marks composed; look-alikes only in words with Latin letters."""
    out = []
    for part in _PARTS.split(_IGNORED.sub("", token)):
        if _FOREIGN.search(part) and (_LATIN.search(part) or part.isupper() and len(part) > 1 and any(c.isdigit() for c in token) and all(c in LOOKALIKES or not c.isalpha() for c in part)):
            part = "".join(LOOKALIKES.get(c, c) for c in part)
        out.append("".join(map(_single, part)))
    return unicodedata.normalize("NFC", "".join(out))


def skeleton(token: str) -> str:
    """What all look-alike spellings of a token share."""
    plain = unicodedata.normalize("NFKD", _IGNORED.sub("", token))
    return "".join(LOOKALIKES.get(c, c) for c in plain if not unicodedata.combining(c))


#: What a foreign letter beyond the table costs, what any other edit costs, and the most that a match may cost.
LETTER, EDIT, MOST = 0.5, 1.0, 0.5


class Trie:
    """Words with their frequencies; find() walks them with the automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = max(n, node.get("", 0))

    def find(self, token: str, most: float = 0.0, least: int = 1) -> str | None:
        """The most frequent word (of at least `least`) at the least cost up to `most`. States are (node, position, cost)."""
        best: tuple[float, int, str] | None = None
        stack: list[tuple[dict, int, float, str]] = [(self.root, 0, 0.0, "")]
        seen: set[tuple[int, int, float]] = set()
        while stack:
            node, i, cost, word = stack.pop()
            if (id(node), i, cost) in seen:
                continue
            seen.add((id(node), i, cost))
            if i == len(token):
                if node.get("", 0) >= least and (best is None or (cost, -node[""], word) < best):
                    best = (cost, -node[""], word)
                if cost + EDIT <= most:
                    stack += [(child, i, cost + EDIT, word + c) for c, child in node.items() if c]
                continue
            c = token[i]
            if _IGNORED.match(c):
                stack.append((node, i + 1, cost, word))
                continue
            steps = {(c, 1), (_single(c), 1), (LOOKALIKES.get(c, c), 1)}
            j = i + 1
            while j < len(token) and (unicodedata.combining(token[j]) or _IGNORED.match(token[j])):
                j += 1
            if j > i + 1:  # a letter with the marks that follow it
                for first in (c, _single(c), LOOKALIKES.get(c, c)):
                    steps.add((unicodedata.normalize("NFC", first + _IGNORED.sub("", token[i + 1 : j])), j - i))
            for text, used in steps:
                if len(text) == 1 and text in node:
                    stack.append((node[text], i + used, cost, word + text))
            if cost + LETTER <= most and _strange(c):
                stack += [(child, i + 1, cost + LETTER, word + x) for x, child in node.items() if x and _LATIN.match(x)]
            if cost + EDIT <= most:
                stack.append((node, i + 1, cost + EDIT, word))
                stack += [(child, i + 1, cost + EDIT, word + x) for x, child in node.items() if x]
                stack += [(child, i, cost + EDIT, word + x) for x, child in node.items() if x]
        return best and best[2]


def _strange(char: str) -> bool:
    """Whether a character is a letter of another script that the table of look-alikes lacks."""
    return char not in LOOKALIKES and bool(_FOREIGN.match(char))


def wild(token: str) -> str | None:
    """The skeleton with ? for the one strange letter of a token with three Latin letters or more; None for other tokens."""
    plain = skeleton(token)
    odd = [i for i, c in enumerate(plain) if _strange(c)]
    if len(odd) != 1 or len(_LATIN.findall(plain)) < 3 or not any(map(_strange, token)):
        return None
    return f"{plain[: odd[0]]}?{plain[odd[0] + 1 :]}"


def canonical(token: str, trie: Trie) -> str:
    """The spelling of a token: from the trie as a whole, then part by part, else by table."""
    if single(token):
        return by_table(token)
    letters = _IGNORED.sub("", token)
    lone = len(letters) == 1 and bool(_FOREIGN.match(letters))  # a Greek or Cyrillic symbol
    if not lone and letters and (word := trie.find(token, MOST)) is not None:
        return word
    if lone or not _SUSPECT.search(token):
        return letters
    out = []
    plain = by_table(token)
    for part, table in zip(_PARTS.split(letters), _PARTS.split(plain), strict=False):
        known = trie.find(part, MOST) if _SUSPECT.search(part) and len(part) > 1 else None
        out.append(known if known is not None else table)
    return "".join(out) if len(_PARTS.split(letters)) == len(_PARTS.split(plain)) else plain


def single(token: str) -> bool:
    """Whether a token is one character that the table alone decides on."""
    return len(token) == 1 and not _FOREIGN.match(token)


def _bucket(skeleton_: str) -> int:
    return zlib.crc32(skeleton_.encode("utf-8", "surrogatepass"))


#: Words or tokens in a bucket, about; there are as many buckets as this takes.
BUCKET = 4_000


def scanned(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """In one pass: the suspicious values (k, f, t), and the words of all values with their counts and skeleton hashes (w, n, h)."""
    kind = dict(texts.dtypes)["k"]

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        counts: Counter[str] = Counter()
        for b in batches:
            for k, f, t in zip(b["k"], b["f"], b["t"], strict=True):
                if _SUSPECT.search(t):
                    yield "value", k, f, t, None, None
                counts.update(_WORD.findall(t))
            if len(counts) > 500_000:
                yield from (("word", None, None, w, n, _bucket(skeleton(w))) for w, n in counts.items())
                counts.clear()
        yield from (("word", None, None, w, n, _bucket(skeleton(w))) for w, n in counts.items())

    rows = cut(map_rows(texts, run, f"kind string, k {kind}, f string, t string, n long, h long"))
    return rows.where("kind = 'value'").select("k", "f", "t"), rows.where("kind = 'word'").select(F.col("t").alias("w"), "n", "h")


def spellings(suspects: DataFrame, words: DataFrame) -> DataFrame:
    """token, canonical for every suspicious token of suspects.t, of two characters or more, whose spelling changes; words is the
    vocabulary (w, n, h)."""

    def tokens(batches: Iterator[Columns]) -> Iterator[tuple]:
        seen: set[str] = set()
        for b in batches:
            for t in b["t"]:
                seen.update(x for x in _TOKEN.findall(t) if not single(x) and _SUSPECT.search(x))
            if len(seen) > 500_000:
                yield from (row for x in seen for row in parts_of(x))
                seen.clear()
        yield from (row for x in seen for row in parts_of(x))

    def parts_of(x: str) -> Iterator[tuple]:
        parts = _PARTS.split(_IGNORED.sub("", x))
        for p in dict.fromkeys([x, *(p for p in parts if len(parts) > 1 and len(p) > 1)]):
            yield x, p, _bucket(skeleton(p)), False
            if pattern := wild(p):
                yield x, p, _bucket(pattern), True

    wanted = cut(map_rows(suspects.select("t"), tokens, "token string, part string, h long, wild boolean").distinct())
    # Only words that share the skeleton of a token or of its part can be reached; with a strange letter, all but one place of it.
    vocabulary = cut(words.groupBy("w", "h").agg(F.sum("n").alias("n")))
    known = vocabulary.join(wanted.where("not wild").select("h").distinct(), "h").select("w", "n", "h")
    if not wanted.where("wild").isEmpty():

        def blanks(batches: Iterator[Columns]) -> Iterator[tuple]:
            for b in batches:
                for w, n in zip(b["w"], b["n"], strict=True):
                    plain = skeleton(w)
                    for i, c in enumerate(plain):
                        if len(plain) > 3 and _LATIN.match(c):
                            yield w, n, _bucket(f"{plain[:i]}?{plain[i + 1 :]}")

        known = known.unionByName(map_rows(vocabulary, blanks, "w string, n long, h long").hint("merge").join(wanted.where("wild").select("h").distinct(), "h").select("w", "n", "h"))
    known = cut(known.distinct())
    parts = wanted.select("part", "h", "wild").distinct()
    buckets = max(32, known.count() // BUCKET, wanted.count() // BUCKET)
    place = F.pmod("h", F.lit(buckets)).alias("b")

    def walk(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for w, n in zip(right["w"], right["n"], strict=True):
            trie.add(w, int(n))
        rows = [(p, trie.find(p, MOST if free else 0.0, 1 if _LATIN.search(p) else 2), free) for p, free in zip(left["part"], left["wild"], strict=True)]
        return pd.DataFrame([(p, w, free) for p, w, free in rows if w is not None and w != p], columns=["part", "word", "wild"])

    found = parts.select("part", "wild", place).groupBy("b").cogroup(known.select("w", "n", place).groupBy("b")).applyInPandas(walk, "part string, word string, wild boolean")
    found = found.groupBy("part").agg(F.min_by("word", F.struct("wild", "word")).alias("word"))  # what costs nothing comes first
    joined = wanted.select("token", "part").distinct().join(found, "part", "left").groupBy("token").agg(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("part", "word"))).alias("own"))

    def spell(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for x, own in zip(b["token"], b["own"], strict=True):
                trie = Trie()
                for p in own:
                    trie.add(p["word"], 1)
                y = canonical(x, trie)
                if y != x:
                    yield x, y

    return cut(map_rows(joined, spell, "token string, canonical string"))


def _values(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    each = [df.select(F.col(key).alias("k"), F.lit(f).alias("f"), F.col(f).alias("t")) for f in fields]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.where("k is not null and t <> ''")


def _pieces(suspects: DataFrame) -> DataFrame:
    """k, f and each suspicious token that needs the vocabulary; NULL for one that the table alone changes, once a value."""
    kind = dict(suspects.dtypes)["k"]

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for k, f, t in zip(b["k"], b["f"], b["t"], strict=True):
                own = {x for x in _TOKEN.findall(t) if _SUSPECT.search(x)}
                alone = {x for x in own if single(x)}
                if any(by_table(x) != x for x in alone):
                    yield k, f, None
                for x in own - alone:
                    yield k, f, x

    return map_rows(suspects, run, f"k {kind}, f string, token string")


#: Parts into which the rows of a token are split where its spelling can't be broadcast.
SALTS = 16


def _spelled(pieces: DataFrame, changed: DataFrame) -> DataFrame:
    """The pieces with their canonical spelling. A token that a third of all values hold meets it in SALTS tasks."""
    if is_small(changed):
        return pieces.join(F.broadcast(changed), "token")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("k", "f"), F.lit(SALTS)).cast("int"))
    return salted.join(changed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["token", "salt"]).drop("salt")


def disguised(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key and field_name of the values with tokens whose spelling changes."""
    suspects, words = scanned(spread(_values(df, key, fields)))
    changed = spellings(suspects, words)
    pieces = _pieces(suspects)
    hit = _spelled(pieces.where("token is not null"), changed).select("k", "f").unionByName(pieces.where("token is null").select("k", "f"))
    return hit.select(F.col("k").alias(key), F.col("f").alias("field_name")).distinct()


def consistent(df: DataFrame, key: str, field: str) -> DataFrame:
    """key (which must tell the rows apart) and the consistent form of every value of a field."""
    texts = spread(df.select(F.col(key).alias("k"), F.lit(field).alias("f"), F.col(field).alias("t")))
    suspects, words = scanned(texts.where("k is not null and t <> ''"))
    changed = spellings(suspects, words)
    own = _spelled(_pieces(suspects).where("token is not null"), changed).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("token", "canonical"))).alias("to"))
    kind = dict(texts.dtypes)["k"]

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for k, t, to in zip(b["k"], b["t"], b["to"], strict=True):
                if t and _SUSPECT.search(t):
                    table = dict(to or ())
                    t = _TOKEN.sub(lambda m, d=table: by_table(m.group()) if single(m.group()) else d.get(m.group(), m.group()), t)
                yield k, t

    return map_rows(texts.join(own, "k", "left").select("k", "t", "to"), run, f"`{key}` {kind}, `{field}` string")
