"""Records out of JSON payloads of unknown schema, by a mapping that is compiled to expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_given(variant: Column, spec: str) -> Column:
    """The first of a|b|c (dotted paths) that isn't missing or empty; of a list its first item."""

    def one(path: str) -> Column:
        value = F.try_variant_get(variant, f"$.{path}", "string")
        head = F.try_variant_get(variant, f"$.{path}[0]", "string")
        return F.coalesce(head, F.when(~value.isin("", "[]", "{}"), value))

    return F.coalesce(*[one(p.strip()) for p in spec.split("|")])


def records(payloads: DataFrame, column: str, path: str, spec: dict[str, str]) -> DataFrame:
    """One row a record: the list (or the object) at `path` of each payload, mapped field by field. Bad JSON gives no rows.

    Where the path leads nowhere, it is the first list at the top of the payload that begins with an object (by the names' order of
    appearance), or the payload itself if that is a list.
    """
    parsed = payloads.select(F.try_parse_json(column).alias("v"), F.col(column).alias("_raw")).where("v is not null")
    at = F.try_variant_get("v", f"$.{path}" if path else "$", "variant")
    found = parsed.select("v", "_raw", at.alias("r"))
    lost = F.col("r").isNull() | F.is_variant_null("r")
    listed = found.where(~lost).select(F.coalesce(F.try_variant_get("r", "$", "array<variant>"), F.array("r")).alias("rows"))
    if path:
        # A variant orders its names; the text of the payload tells which came first.
        fields = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
        lists = F.filter(F.transform(fields, lambda x: F.struct(F.instr(F.col("_raw"), F.concat(F.lit('"'), x.key, F.lit('"'))).alias("at"), F.try_variant_get(x.value, "$", "array<variant>").alias("rows"))), lambda x: F.try_variant_get(F.get(x.rows, 0), "$", "map<string,variant>").isNotNull())
        first = F.get(F.array_sort(lists, lambda a, b: a.at - b.at), 0)["rows"]
        others = found.where(lost).select(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), first).alias("rows"))
        listed = listed.unionByName(others.where("rows is not null"))
    each = listed.select(F.explode("rows").alias("r"))
    return each.select(*[first_given(F.col("r"), s).alias(name) for name, s in spec.items()])
