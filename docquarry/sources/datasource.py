"""A Spark data source that reads page files: ``spark.read.format("docpages").load(folder)``."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES_PER_TASK = 500


class PageFiles(DataSource):
    """JSON page files, one page each. A file that is no page is a row of its name and an error."""

    @classmethod
    def name(cls) -> str:
        return "docpages"

    def schema(self) -> str:
        return "path string, title string, description string, body string, file string, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return PageFilesReader(self.options["path"])


class _Files(InputPartition):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class PageFilesReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        files = sorted(os.path.join(d, f) for d, _, fs in os.walk(self.folder) for f in fs if f.endswith(".json"))
        return [_Files(files[i : i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for name in partition.files:
            try:
                with open(name, encoding="utf8") as f:
                    page = json.load(f)
            except (OSError, ValueError, RecursionError) as e:
                yield None, None, None, None, name, f"unreadable: {type(e).__name__}"
                continue
            if isinstance(page, dict) and isinstance(page.get("path"), str):
                yield page["path"], page.get("title"), page.get("description"), json.dumps(page.get("body"), ensure_ascii=False), name, None
            else:
                yield None, None, None, None, name, "no page: a path is missing"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageFiles)
