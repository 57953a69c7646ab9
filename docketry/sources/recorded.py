"""A data source over recorded responses, in the place of live visits: ``spark.read.format("recorded")``."""

from __future__ import annotations

import glob
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.files = path

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(self.files))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    r = json.loads(line)
                    yield (r.get("source_uri"), r.get("checked_at"), r.get("http_status"), r.get("content_type"), r.get("body"))


class RecordedResponses(DataSource):
    """One row per recorded response in JSON lines; option ``path`` is a glob, a partition per file."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "source_uri string, checked_at string, http_status int, content_type string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
