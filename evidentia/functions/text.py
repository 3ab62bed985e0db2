"""Folding, fingerprints and clean-up of text as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Any white space, in a syntax that Java and RE2 share.
WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def fold(text: Column) -> Column:
    """The form in which texts are compared: compatibility forms folded, no white space, no zero-width characters."""
    return F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), rf"(?:{WS}|[\x{{200b}}\x{{feff}}])+", "")


_BLANK = re.compile(r"[\s\u200b\ufeff]+")


def folded(text: str) -> str:
    """fold() for a text in the driver, such as a report."""
    return _BLANK.sub("", unicodedata.normalize("NFKC", text or ""))


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256 over the folded text; empty for a text that folds to nothing."""
    bare = fold(text)
    return F.when(bare == "", F.lit("")).otherwise(F.left(F.sha2(bare, 256), F.lit(16)))


def snapshot_id(url: Column, text: Column) -> Column:
    return F.left(F.sha2(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))), 256), F.lit(16))


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(nfkc(F.coalesce(title, F.lit("")))), r"(?U)[^\w]+", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{WS}+", " "))


def head_tail(text: Column, n: int = 200) -> tuple[Column, Column]:
    """The first and last n characters of the squeezed text; the whole twice if it has at most 2n."""
    one = squeezed(text)
    short = F.length(one) <= 2 * n
    return F.when(short, one).otherwise(F.left(one, F.lit(n))), F.when(short, one).otherwise(F.right(one, F.lit(n)))


def normalized(text: Column) -> Column:
    """Zero-widths dropped, long encoded blobs blanked, white space collapsed per line, empty lines dropped."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{200b}\x{feff}]", "")
    bare = F.regexp_replace(bare, r"[A-Za-z0-9+/=_-]{40,}", " ")
    lines = F.split(bare, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]")
    clean = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t\x{3000}]+", " "), rf"^{WS}+|{WS}+$", ""))
    return F.array_join(F.filter(clean, lambda x: x != ""), "\n")


def or_none(value: Column) -> Column:
    """NULL for an empty string: many fields mark absence so."""
    return F.nullif(value, F.lit(""))
