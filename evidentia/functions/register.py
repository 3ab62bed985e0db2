"""The Arrow functions under names that SQL can use."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.udtf(returnType="href: string, text: string, pos: int")
class HtmlLinks:
    """One row a link of a page."""

    def eval(self, page: str):
        from evidentia.functions.html import links_of

        yield from links_of(page or "")


def register(spark: SparkSession) -> None:
    """nfkc(text), url_join(base, href), decode_any(bytes, encoding), pdf_text(bytes), and the table function html_links(page)."""
    from evidentia.functions import bytes as raw
    from evidentia.functions.text import nfkc
    from evidentia.functions.urls import joined

    @F.pandas_udf(T.StringType())
    def decode_any(data: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else raw.decode(d, n) for d, n in zip(data, names, strict=True)])

    @F.pandas_udf(T.StringType())
    def pdf_text(data: pd.Series) -> pd.Series:
        return data.map(lambda x: raw.pdf_text(x)[0])

    for name, fn in (("nfkc", nfkc), ("url_join", joined), ("decode_any", decode_any), ("pdf_text", pdf_text)):
        spark.udf.register(name, fn)
    spark.udtf.register("html_links", HtmlLinks)
