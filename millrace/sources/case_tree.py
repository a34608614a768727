"""A Python data source for trees of one folder a case: ``spark.read.format("case_tree").load(root)``.

Folders are the unit of planning: each task lists and reads its own share of them, so no listing of
files passes through the driver. Hidden folders are skipped; a file that cannot be read gives a null
text and its error.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Folders(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class CaseTree(DataSource):
    """Options: path (the root), suffix (of the files to read, default all), folders_per_task (default 256)."""

    @classmethod
    def name(cls) -> str:
        return "case_tree"

    def schema(self) -> str:
        return "folder string, file string, bytes bigint, text string, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return CaseTreeReader(self.options)


class CaseTreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.suffix, self.each = options["path"].removeprefix("file:"), options.get("suffix", ""), int(options.get("folders_per_task", 256))

    def partitions(self) -> list[InputPartition]:
        folders = sorted(str(p) for p in Path(self.root).iterdir() if p.is_dir() and not p.name.startswith("."))
        return [Folders(folders[k : k + self.each]) for k in range(0, len(folders), self.each)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder in map(Path, partition.paths):
            for f in sorted(folder.iterdir()):
                if f.is_file() and f.name.endswith(self.suffix):
                    try:
                        data = f.read_bytes()
                        yield folder.name, f.name, len(data), data.decode("utf-8", errors="ignore"), None
                    except OSError as e:
                        yield folder.name, f.name, None, None, str(e)


def register(spark: SparkSession) -> None:
    """Make the source known; it is sent whole, for the processes that plan a read need not be able to import this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CaseTree)
