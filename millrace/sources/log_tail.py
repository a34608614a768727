"""A Python streaming source for log files that grow: ``spark.readStream.format("log_tail").load(pattern)``.

The offset is the end of the last complete line of each file, so a line that is still being written waits for the next
micro-batch; a file that has shrunk is read again from its begin. The driver looks at the sizes and the last bytes only;
the ranges are read by tasks, a long one in pieces of ``bytes_per_task`` that begin with a line of their own.
"""

from __future__ import annotations

import glob
import json
import os
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_BLOCK = 1 << 16


class Range(InputPartition):
    def __init__(self, file: str, start: int, begin: int, end: int) -> None:
        self.file, self.start, self.begin, self.end = file, start, begin, end


def complete_end(file: str, size: int) -> int:
    """Offset after the last line end of the first ``size`` bytes, found from the back."""
    with open(file, "rb") as f:
        at = size
        while at:
            begin = max(0, at - _BLOCK)
            f.seek(begin)
            if (k := f.read(at - begin).rfind(b"\n")) >= 0:
                return begin + k + 1
            at = begin
    return 0


class LogTail(DataSource):
    """Options: path (a file or a pattern below a folder all executors see), bytes_per_task (default 64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "source string, offset bigint, text string"

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return LogTailReader(self.options["path"].removeprefix("file://").removeprefix("file:"), int(self.options.get("bytes_per_task", 1 << 26)))


class LogTailReader(DataSourceStreamReader):
    def __init__(self, pattern: str, each: int) -> None:
        self.pattern, self.each = pattern, each

    def initialOffset(self) -> dict:
        return {"ends": "{}"}

    def latestOffset(self) -> dict:
        files = sorted(f for f in glob.glob(self.pattern) if os.path.isfile(f))
        return {"ends": json.dumps({f: complete_end(f, os.path.getsize(f)) for f in files})}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, out = json.loads(start["ends"]), []
        for file, stop in json.loads(end["ends"]).items():
            first = before.get(file, 0)
            first = 0 if stop < first else first
            out += [Range(file, first, a, min(a + self.each, stop)) for a in range(first, stop, self.each)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        """The lines that begin within the range."""
        if part.begin == part.end:
            return
        with open(part.file, "rb") as f:
            f.seek(part.begin)
            if part.begin > part.start:
                f.seek(part.begin - 1)
                f.readline()  # the line before belongs to the range before
            while (at := f.tell()) < part.end:
                line = f.readline()
                yield part.file, at, line.rstrip(b"\r\n").decode("utf-8", errors="replace")

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint holds the offset."""


def register(spark: SparkSession) -> None:
    """Make the source known; it is sent whole, for the processes that plan a read need not be able to import this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LogTail)
