"""A data source that replays captured payloads: one partition a file, the attempt logged with it.

A live reader can take its place by reading the same columns. Use: spark.dataSource.register(Replay);
spark.read.format("replay").option("path", folder).option("limit", bytes).load().
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, source_key string, status int, ok boolean, chars int, error string, content binary"
#: Bytes beyond which a payload is refused, never cut.
LIMIT = 8 << 20


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit

    def partitions(self) -> list[File]:
        found = [os.path.join(at, f) for at, _, files in os.walk(self.folder) for f in files]
        return [File(p) for p in sorted(found)]

    def read(self, partition: File) -> Iterator[tuple]:
        key = os.path.relpath(partition.path, self.folder).split(os.sep)[0]
        try:
            size = os.path.getsize(partition.path)
            if size > self.limit:
                yield partition.path, key, 200, False, size, "too large", None
                return
            with open(partition.path, "rb") as f:
                yield partition.path, key, 200, True, size, None, f.read()
        except OSError as e:
            yield partition.path, key, 404, False, 0, str(e)[:300], None


class Replay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("limit", LIMIT)))
