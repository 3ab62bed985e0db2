"""Text decoded in the wrong character set: found and repaired by tables of garbled forms.

1. The distinct words of the corpus are counted: tokens with accented or other non-ASCII letters, single characters and
   pairs of neighbouring characters of scripts without word breaks.
2. Every word is garbled by every chain of encodings, one or two deep, also where bytes get lost.
3. Lines that a chain brings back into plain text (unread()) are garbled whatever their share of the corpus. They and lines with
   lost bytes are no clean context: characters and words are counted in the other lines only.
4. Values with such lines, or with characters that few values hold in clean context, give their tokens; these are hash-joined
   with the garbled forms. A match is verified where the original word is far more frequent than the token in clean context.
5. Verified tokens are substituted: whole lines through the inverse chain if that loses nothing, else token by token. Where bytes
   are lost and several originals fit, U+FFFD marks the place and the value counts as not fully restored.

Defined results: NULL and empty values are never garbled; values of any length are worked whole; rows that share a key are
told apart by the row column; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.frames import Columns, map_rows
from evidentia.llm.grams import codes
from evidentia.session import cut, small, spread

#: (written in, read as) of each step; the first of a chain comes first.
_READ = ("latin-1", "cp1252", "gbk", "gb18030", "big5", "cp949", "cp437", "cp850", "mac_roman", "cp1251", "shift_jis")
CHAINS: list[tuple[tuple[str, str], ...]] = [
    *(((("utf-8", d),)) for d in _READ),
    *(((("gb18030", d),)) for d in ("latin-1", "cp1252", "big5", "cp949", "cp437", "mac_roman", "cp1251", "shift_jis", "utf-8")),
    *(((("big5", d),)) for d in ("latin-1", "gb18030", "utf-8")),
    *(((("cp1252", d),)) for d in ("mac_roman", "cp437", "cp850", "cp1251", "utf-8", "gb18030", "big5", "cp949")),
    *(((("mac_roman", d),)) for d in ("cp1252",)),
    *((("utf-8", a), ("utf-8", b)) for a in ("latin-1", "cp1252") for b in ("latin-1", "cp1252")),
    (("gb18030", "utf-8"), ("utf-8", "gb18030")),
    (("cp1252", "utf-8"), ("utf-8", "gb18030")),
    (("cp1252", "utf-8"), ("utf-8", "cp1252")),
]

#: Lengths of the character runs that are looked up; single characters leave no longer ones under one step, nor under two of UTF-8.
SIZES = (2, 3, 4, 5, 6, 7, 8)
#: A character is ordinary if this share of all values holds it in clean context; an original must be so many times as frequent as
#: its garbled form is there.
ORDINARY, RATIO = 0.02, 4
#: Garbled forms that a task holds before it passes the two best originals of each on.
FORMS = 300_000
#: Matched tokens up to which they go to the tasks as a table; beyond it each value is joined with its own.
TABLE = 300_000

#: Words with accented letters are those of its matches that are not ASCII.
_TOKEN = re.compile(r"[!-~¡-ʯͰ-֏Ḁ-⃏]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_SPACED = re.compile(r"[^\s　]*[^\x00-\x7f\s　][^\s　]*")


def _encode(text: str, name: str) -> bytes | None:
    try:
        return text.translate(_TO_1252).encode("latin-1") if name == "cp1252" else text.encode(name)
    except UnicodeError:
        return None


_CP1252 = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)}
#: Characters to the one of their byte; control characters that aren't in the set to one without a byte.
_TO_1252 = {c: 0xFFFF for c in range(0x80, 0xA0)} | {ord(c): b for b, c in _CP1252.items() if b >= 0x80}


def _decode(data: bytes, name: str, errors: str = "replace") -> str | None:
    if name == "cp1252":
        return "".join(map(_CP1252.__getitem__, data))
    try:
        return data.decode(name, errors)
    except UnicodeError:
        return None


def garble(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """word as the chain leaves it; None if it can't be written so."""
    for written, read in chain:
        data = _encode(word, written)
        word = data and _decode(data, read)
        if word is None:
            return None
    return word


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain; None where that isn't certain."""
    for written, read in reversed(chain):
        data = _encode(text, read)
        text = None if data is None else _decode(data, written, "strict")
        if text is None:
            return None
    return text


def partial(text: str, chain: tuple[tuple[str, str], ...]) -> str:
    """The text before the chain as far as its bytes are there; U+FFFD where they aren't."""
    for written, read in reversed(chain):
        text = _decode(b"".join(_encode(c, read) or b"" for c in text), written) or ""
    return text


def _plain() -> frozenset[str]:
    """Characters that are common by the standards, not by the corpus: Han of the first levels, punctuation, Western letters."""
    level = lambda name, highs, lows: "".join(bytes([a, b]).decode(name, "ignore") for a in highs for b in lows)
    han = level("gb2312", range(0xB0, 0xD8), range(0xA1, 0xFF)) + level("big5", range(0xA4, 0xC7), [*range(0x40, 0x7F), *range(0xA1, 0xFF)])
    return frozenset(han + "　、。·—…‘’“”〔〕〈〉《》「」『』【】（），：；？！％／－～＋℃§°€£«»–àâäçéèêëîïíôöóùûüúñœæßÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŒ" + "".join(map(chr, range(0x20, 0x7F))) + "\t\r")


PLAIN = _plain()
#: What only lost bytes leave behind, alone or read once more.
_LOST = re.compile("[\x80-\x84\x86-\x9f\ue000-\uf8ff�]|锟斤拷|斤拷锟|ï¿½")
#: What each set can be read as, and the chains that end with it; what GBK gives, GB 18030 gives too.
_BACK = [(read, [i for i, c in enumerate(CHAINS) if c[-1][1] == read]) for read in dict.fromkeys(c[-1][1] for c in CHAINS) if read != "gbk"]
_EVERY = (1 << len(_BACK)) - 1


class _Sets(dict[str, int]):
    """By character, the sets of _BACK (a bit each) that can write it so that its bytes pass a test; worked out when first asked."""

    def __init__(self, test: Callable[[bytes], bool]) -> None:
        super().__init__()
        self.test = test

    def __missing__(self, char: str) -> int:
        out = 0
        for k, (read, _) in enumerate(_BACK):
            data = _encode(char, read)
            if data is not None and self.test(data):
                out |= 1 << k
        self[char] = out
        return out


def _begins(data: bytes) -> bool:
    """Whether UTF-8 text can begin with the bytes."""
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data)
    except UnicodeError:
        return False
    return True


#: Sets that have a character; sets in which a run of UTF-8 bytes, read so, can begin and end with it.
_KNOWN, _BEGIN, _END = _Sets(lambda data: True), _Sets(_begins), _Sets(lambda data: data[-1] < 0xC0)


@lru_cache(1 << 15)  # lines repeat, and the same ones are asked for in each pass
def unread(line: str) -> int | None:
    """The chain that left the line as it is, if its inverse gives plain text and the line is none; by the standards alone.

    UTF-8 proves itself; for other encodings half of the line must be beyond ASCII, with a run of four characters, and a quarter
    of these not plain: a word of look-alikes is none.
    """
    runs = _RUN.findall(line)
    if not runs or len(runs) == 1 and len(runs[0]) < 2:
        return None
    utf8 = _EVERY
    for run in runs:
        utf8 &= _BEGIN[run[0]] & _END[run[-1]]
        if not utf8:
            break
    # Lines that are not strange can only have been UTF-8.
    other = "".join(runs)
    strange = len(other) * 2 >= len(line) and not PLAIN.issuperset(other) and max(map(len, runs)) >= 4 and sum(c not in PLAIN for c in other) * 4 >= len(other)
    if not strange and not utf8:
        return None
    sets = _EVERY if strange else utf8
    for c in set(other):
        sets &= _KNOWN[c]
        if not sets:
            return None
    for k, (read, chains) in enumerate(_BACK):
        if not sets >> k & 1 or not strange and read == "utf-8":
            continue
        data = _encode(line, read)
        if data is None:
            continue
        for i in chains:
            if not strange and CHAINS[i][0][0] != "utf-8":
                continue
            before = _decode(data, CHAINS[i][-1][0], "strict")
            before = before and restore(before, CHAINS[i][:-1])
            if before is not None and before != line and not before.isascii() and PLAIN.issuperset(before) and garble(before, CHAINS[i]) == line:
                return i
    return None


@cache
def telling(char: str) -> bool:
    """Whether a rare character may come from wrong decoding; spaces, marks and compatibility forms have other causes."""
    return char == "�" or unicodedata.category(char) not in ("Cf", "Zs", "Mn") and not ("⼀" <= char <= "⿟" or "豈" <= char <= "﫿" or "０" <= char <= "ｚ")


def _values(df: DataFrame, row: str, fields: list[str]) -> DataFrame:
    picked = df.select(F.col(row).alias("r"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    return spread(picked.where("r is not null"))


def _texts(batches: Iterator[Columns], n: int) -> Iterator[tuple[object, int, str]]:
    for b in batches:
        for f in range(n):
            for r, t in zip(b["r"], b[f"f{f}"], strict=True):
                if t and not t.isascii():
                    yield r, f, t


def vocabulary(values: DataFrame, n_fields: int) -> DataFrame:
    """kind w: words and their counts; kind c: characters and the values that hold them, both in clean context; kind n: the values."""

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        words: Counter[str] = Counter()
        chars: Counter[str] = Counter()
        total, held, parts = 0, [], []

        def flush() -> None:
            if held:
                c = codes("\0".join(held))
                wide = (c >= 0x2E80) & (c < 0xFFF0) & ~((c >= 0xE000) & (c < 0xF900)) | (c >= 0x20000) & (c < 0x40000)
                both = wide[1:] & wide[:-1]
                keys, n = np.unique((c[:-1][both].astype(np.uint64) << np.uint64(32)) | c[1:][both], return_counts=True)
                parts.append((keys, n))
                held.clear()
            if len(parts) > 12:
                merge()

        def merge() -> None:
            keys = np.concatenate([k for k, _ in parts])
            n = np.concatenate([m for _, m in parts])
            unique, at = np.unique(keys, return_inverse=True)
            parts[:] = [(unique, np.bincount(at, n, len(unique)).astype(np.int64))]

        size = 0
        for _, _, t in _texts(batches, n_fields):
            total += 1
            t = "\n".join(x for x in t.split("\n") if x.isascii() or not _LOST.search(x) and unread(x) is None)
            chars.update(set(t))
            words.update(x for x in _TOKEN.findall(t) if not x.isascii())
            held.append(t)
            size += len(t)
            if size > 1_000_000:
                flush()
                size = 0
        flush()
        if total:
            yield "n", "", total
            for c, n in chars.items():
                yield "c", c, n
            for w, n in words.items():
                yield "w", w, n
        if parts:
            merge()
            for k, n in zip(parts[0][0].tolist(), parts[0][1].tolist(), strict=True):
                yield "w", chr(k >> 32) + chr(k & 0xFFFFFFFF), n

    return map_rows(values, run, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def garbled_forms(words: DataFrame, clean: set[str]) -> DataFrame:
    """g, w, n, chain, lossy: every word under every chain that changes it. Lossy forms only of words in ordinary or plain characters.

    Many words may leave one form where bytes get lost, so each task keeps of a form only the two most frequent originals with and
    without loss: no other can be chosen, nor make the choice uncertain. Forms of lost bytes alone tell nothing and are left out.
    """
    known = clean | PLAIN

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        best: dict[tuple[str, bool], list[tuple[int, str, int]]] = {}
        for b in batches:
            for w, n in zip(b["word"], b["n"], strict=True):
                if "�" in w or any(0xE000 <= ord(c) < 0xF900 or 0x80 <= ord(c) < 0xA0 for c in w):
                    continue
                ordinary, seen = known.issuperset(w), set()
                for i, chain in enumerate(CHAINS):
                    g = garble(w, chain)
                    # One character for one says nothing, and a form in ASCII can't be told from a clean word.
                    if not g or len(g) == 1 or g == w or g in seen or g.isascii() or not g.strip("� \t\r\n　"):
                        continue
                    lossy = restore(g, chain) != w
                    # Where bytes are lost many words fit, so the original must be known well.
                    if lossy and (not ordinary or n < RATIO):
                        continue
                    seen.add(g)
                    own = best.setdefault((g, lossy), [])
                    own.append((-n, w, i))
                    if len(own) > 2:
                        own.remove(max(own))
            if len(best) > FORMS:
                yield from ((g, w, -n, i, lossy) for (g, lossy), own in best.items() for n, w, i in own)
                best.clear()
        yield from ((g, w, -n, i, lossy) for (g, lossy), own in best.items() for n, w, i in own)

    return map_rows(words, run, "g string, w string, n long, chain int, lossy boolean")


def _line_tokens(line: str) -> set[str]:
    out = set(_SPACED.findall(line))
    for run in _RUN.findall(line):
        for size in SIZES:
            out.update(run[i : i + size] for i in range(len(run) - size + 1))
    return out


def matches(df: DataFrame, row: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The values with unread lines or rare characters (r, f, t, rare), and the verified tokens (g, w, chain, lossy)."""
    values = _values(df, row, fields)
    stats = cut(vocabulary(values, len(fields)))
    total = stats.where("kind = 'n'").agg(F.sum("n")).first()[0] or 0
    ordinary = {r.word for r in stats.where((F.col("kind") == "c") & (F.col("n") >= total * ORDINARY)).select("word").collect()}
    clean = ordinary | {chr(i) for i in range(128)}

    def rare(batches: Iterator[Columns]) -> Iterator[tuple]:
        for r, f, t in _texts(batches, len(fields)):
            odd = {c for c in set(t) - clean if telling(c)}
            odd.update(c for x in t.split("\n") if not x.isascii() and unread(x) is not None for c in x if c > "\x7f")
            if odd:
                yield r, f, t, "".join(sorted(odd))

    suspects = cut(map_rows(values, rare, f"r {dict(values.dtypes)['r']}, f int, t string, rare string"))

    def tokens(batches: Iterator[Columns]) -> Iterator[tuple]:
        counts: Counter[str] = Counter()
        for b in batches:
            for t, odd in zip(b["t"], b["rare"], strict=True):
                chars = set(odd)
                for line in t.split("\n"):
                    # Lines that a chain brings back need no tokens. Lines with lost bytes name some, but don't speak against a match.
                    if not chars.isdisjoint(line) and unread(line) is None:
                        plain = not _LOST.search(line)
                        for x in _line_tokens(line):
                            counts[x] += plain
                if len(counts) > 400_000:
                    yield from counts.items()
                    counts.clear()
        yield from counts.items()

    seen = map_rows(spread(suspects.select("t", "rare")), tokens, "g string, ng long").groupBy("g").agg(F.sum("ng").alias("ng"))
    words = stats.where((F.col("kind") == "w") | (F.col("kind") == "c") & (F.col("word") > "\x7f")).groupBy("word").agg(F.max("n").alias("n"))
    forms = garbled_forms(spread(words), clean)
    # The optimizer takes the forms for as few as the words they come from, and would broadcast them.
    joined = seen.join(forms.hint("merge"), "g").where((F.col("n") >= RATIO * F.col("ng")) | (F.instr("g", "�") > 0))
    best = Window.partitionBy("g").orderBy(F.col("lossy"), F.desc("n"), "w", "chain")
    # An original is certain if the chain loses nothing, or if no other word is nearly as frequent.
    ranked = joined.withColumn("k", F.row_number().over(best)).withColumn("second", F.lead("n").over(best)).withColumn("other", F.lead("w").over(best))
    sure = ~F.col("lossy") | F.col("second").isNull() | (F.col("other") == F.col("w")) | (F.col("n") >= 3 * F.col("second"))
    return suspects, cut(ranked.where("k = 1").select("g", F.when(sure, F.col("w")).alias("w"), "chain", "lossy"))


Table = dict[str, tuple[str | None, int, bool]]


def _strong(token: str, table: Table) -> bool:
    """Whether a match says enough on its own: three characters, or two that no word would hold side by side."""
    return len(token) > 2 or max(token) < "⺀" and not (token.isalpha() and (table[token][0] or "a").isalpha())


def _scan(line: str, odd: set[str], table: Table) -> tuple[list[tuple[int, int, str]], bool]:
    """Matched tokens of a line from left to right, longest first; whether they say enough: two short ones, a longer one or a word."""
    found, word = [], False
    taken = 0
    for m in _SPACED.finditer(line):
        x = m.group()
        if odd.isdisjoint(x):
            continue
        if x in table:
            found.append((m.start(), m.end(), x))
            word = word or any(c.isascii() and c.isalpha() for c in x) or _strong(x, table)
            continue
        i = m.start()
        while i < m.end():
            if line[i] < "\x80":
                i += 1
                continue
            for size in reversed(SIZES):
                x = line[i : i + size]
                if len(x) == size and x in table and not odd.isdisjoint(x):
                    found.append((i, i + size, x))
                    i += size
                    taken += 1 + _strong(x, table)
                    break
            else:
                if line[i] == "�":
                    found.append((i, i + 1, "�"))
                i += 1
    return found, word or taken > 1 or any("�" in x for _, _, x in found)


def _lookups(line: str, odd: set[str]) -> set[str]:
    """Every token that _scan() may look up in a line."""
    out: set[str] = set()
    for m in _SPACED.finditer(line):
        if odd.isdisjoint(m.group()):
            continue
        out.add(m.group())
        for i in range(m.start(), m.end()):
            if line[i] > "\x7f":
                out.update(x for size in SIZES if len(x := line[i : i + size]) == size and not odd.isdisjoint(x))
    return out


def repair(text: str, odd: set[str], table: Table) -> tuple[str, bool, bool]:
    """The text with originals put back, whether it was garbled, and whether all came back."""
    lines, garbled, whole = text.split("\n"), False, True
    out = list(lines)
    for k, line in enumerate(lines):
        if odd.isdisjoint(line):
            continue
        if (chain := unread(line)) is not None:
            garbled, out[k] = True, restore(line, CHAINS[chain])
            continue
        found, sure = _scan(line, odd, table)
        if not sure:
            continue
        garbled = True
        chains = [c for c, _ in Counter(table[x][1] for _, _, x in found if x in table and not table[x][2]).most_common(2)]
        before = next((b for c in chains if (b := restore(line, CHAINS[c])) is not None and "�" not in b), None)
        if before is None and chains:
            before = partial(line, CHAINS[chains[0]])
            if sum(c in odd or c == "�" for c in before) * 4 > len(before):
                before = None
            else:
                whole = False
        if before is not None:
            out[k] = before
        else:
            parts, last = [], 0
            for a, b, x in found:
                w = table[x][0] if x in table else None
                whole = whole and w is not None
                parts += [line[last:a], "�" if w is None else w]
                last = b
            out[k] = "".join([*parts, line[last:]])
    return ("\n".join(out) if garbled else text), garbled, whole


def repaired(df: DataFrame, row: str = "arrival", fields: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """row, field_name, restored value and whether all of it came back, for every garbled value."""
    suspects, found = matches(df, row, list(fields))
    kind, names = dict(suspects.dtypes)["r"], list(fields)
    rows = found.limit(TABLE + 1).count()
    if rows <= TABLE:
        shared = df.sparkSession.sparkContext.broadcast({r.g: (r.w, r.chain, r.lossy) for r in found.toLocalIterator()})

        def run(batches: Iterator[Columns]) -> Iterator[tuple]:
            table = shared.value
            for b in batches:
                for r, f, t, odd in zip(b["r"], b["f"], b["t"], b["rare"], strict=True):
                    text, garbled, whole = repair(t, set(odd), table)
                    if garbled:
                        yield r, names[f], text, whole

        return map_rows(spread(suspects), run, f"`{row}` {kind}, field_name string, restored string, complete boolean")

    def own(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for r, f, t, odd in zip(b["r"], b["f"], b["t"], b["rare"], strict=True):
                chars = set(odd)
                for g in set().union(*(_lookups(x, chars) for x in t.split("\n") if not chars.isdisjoint(x))):
                    yield r, f, g

    tokens = map_rows(suspects, own, f"r {kind}, f int, g string").join(found, "g").groupBy("r", "f").agg(F.collect_list(F.struct("g", "w", "chain", "lossy")).alias("own"))

    def apply(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for r, f, t, odd, mine in zip(b["r"], b["f"], b["t"], b["rare"], b["own"], strict=True):
                text, garbled, whole = repair(t, set(odd), {x["g"]: (x["w"], x["chain"], x["lossy"]) for x in mine or ()})
                if garbled:
                    yield r, names[f], text, whole

    # Lines that a chain brings back, or with lost bytes, need no match: a value without any stays.
    return map_rows(suspects.join(tokens, ["r", "f"], "left"), apply, f"`{row}` {kind}, field_name string, restored string, complete boolean")


def garbled_values(df: DataFrame, key: str = "article_id", row: str = "arrival", fields: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """key and field_name of the garbled values."""
    found = repaired(df, row, fields).select(F.col(row).alias("_row"), "field_name")
    keys = df.select(F.col(key).alias("_key"), F.col(row).alias("_row"))
    return keys.join(small(cut(found)), "_row").where("_key is not null").select(F.col("_key").alias(key), "field_name").distinct()
