"""URL templates with {field} places, split once and compiled to a concatenation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(template: str, columns: list[str], strict: bool = False) -> Column:
    """The template with the columns' values; a missing value gives an empty place, or NULL for all if strict."""
    parts = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(part))
        else:
            value = F.col(part).cast("string") if part in columns else F.lit(None).cast("string")
            parts.append(F.nullif(value, F.lit("")) if strict else F.coalesce(value, F.lit("")))
    return F.concat(*parts)


def field_map(params: Column, docno: Column, date: Column, url: Column) -> Column:
    """The fields that a detail template may name, as a map: of a name given twice the first holds. In order: the listed record's
    fields, their names in lower case, document number, date and its parts, and the arguments of the URL, also in lower case."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    lower = lambda pairs: F.transform(pairs, lambda x: F.struct(F.lower(x.key).alias("key"), x.value.alias("value")))
    given = F.coalesce(F.map_entries(params), none)
    number = F.when(docno != "", F.array(entry("docno", docno), entry("documentNo", docno)))
    day = date.cast("string")
    parts = F.when(date.isNotNull(), F.array(entry("date", day), entry("year", F.left(day, F.lit(4))), entry("month", F.substring(day, 6, 2)), entry("day", F.substring(day, 9, 2))))
    # Only key=value arguments with a value; + and %xx are decoded as in a form.
    query = F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&")
    pairs = F.transform(F.filter(query, lambda x: x.rlike("^[^=]*=.")), lambda x: F.struct(F.try_url_decode(F.regexp_extract(x, "^([^=]*)=", 1)).alias("key"), F.try_url_decode(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("value")))
    every = F.filter(F.concat(given, lower(given), F.coalesce(number, none), F.coalesce(parts, none), F.coalesce(F.flatten(F.transform(pairs, lambda x: F.array(x, F.struct(F.lower(x.key).alias("key"), x.value.alias("value"))))), none)), lambda x: x.key.isNotNull())
    names = F.array_distinct(F.transform(every, lambda x: x.key))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.get(F.filter(every, lambda x: x.key == k), 0)["value"]))


def filled_from(template: str, fields: Column, strict: bool = False) -> Column:
    """filled() with the values of a map."""
    parts = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        value = F.lit(part) if i % 2 == 0 else F.try_element_at(fields, F.lit(part))
        parts.append(value if i % 2 == 0 else F.nullif(value, F.lit("")) if strict else F.coalesce(value, F.lit("")))
    return F.concat(*parts)
