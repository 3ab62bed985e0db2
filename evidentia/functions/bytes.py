"""Bytes that came over the wire: sniffing, tolerant decoding, and the text of PDF files as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.pdf import pdf_text


def is_pdf(content: Column) -> Column:
    return F.contains(F.substring(content, 1, 1024), F.unhex(F.lit("255044462D")))


def decode(data: bytes, declared: str | None = None) -> str:
    """By the declared encoding, UTF-8, then the Chinese and Western ones; at last with replacements."""
    for name in [declared, "utf-8", "gb18030", "gbk", "big5", "latin-1"]:
        try:
            if name:
                return data.decode(name)
        except (UnicodeError, LookupError):
            pass
    return data.decode("utf-8", "replace")


def decoded(content: Column, declared: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(data: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else decode(d, n) for d, n in zip(data, names, strict=True)])

    return run(content, declared)


_PDF = T.StructType([T.StructField("text", T.StringType()), T.StructField("method", T.StringType())])


def pdf_extracted(content: Column) -> Column:
    @F.pandas_udf(_PDF)
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pdf_text(x) for x in data], columns=["text", "method"])

    return run(content)
