"""Python steps over Arrow batches: rows of plain values in, rows of plain values out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Columns = dict[str, list]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[Columns]], Iterator[tuple]], ddl: str, chunk: int = 10_000) -> DataFrame:
    """fn sees a partition as batches, each a dict of lists by column name, and yields the rows of the result."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches):
            rows.append(row)
            if len(rows) >= chunk:
                yield _batch(rows, arrow)
                rows = []
        if rows:
            yield _batch(rows, arrow)

    return df.mapInArrow(run, schema)
