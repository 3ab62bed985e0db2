"""URLs as column expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: tracking arguments, with the separator before them.
TRACKING = r"([?&])(?:utm_[^&#]*|spm=[^&#]*|from=[^&#]*|share_[^&#]*)"


def cleaned(url: Column) -> Column:
    """Without tracking arguments, where the URL has any; separators are tidied."""
    bare = F.regexp_replace(F.regexp_replace(url, TRACKING, "$1"), "[?&]+$", "")
    tidy = F.replace(F.replace(bare, F.lit("?&"), F.lit("?")), F.lit("&&"), F.lit("&"))
    return F.trim(F.when(F.contains(url, F.lit("utm_")) | F.contains(url, F.lit("spm=")), tidy).otherwise(F.coalesce(url, F.lit(""))))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))


@F.pandas_udf(T.StringType())
def joined(base: pd.Series, href: pd.Series) -> pd.Series:
    """href against its page: absolute as it is, else by RFC 3986."""
    return pd.Series([None if h is None else "" if not h.strip() else h.strip() if h.strip().startswith(("http://", "https://")) else urljoin(b or "", h.strip()) for b, h in zip(base, href, strict=True)])


def is_pdf(url: Column) -> Column:
    low = F.lower(url)
    return low.endswith(".pdf") | F.contains(low, F.lit(".pdf?")) | F.contains(low, F.lit("/resource/file?"))
