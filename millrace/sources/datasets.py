"""Specifications of a corpus of issues: which issues of a table belong to it, and how they are named."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DatasetSpec:
    """Issues of one repository (or tracker) that carry every one of the labels; names are the prefix with a number."""

    name: str
    repository: str | None = None
    tracker: str | None = None
    labels: tuple[str, ...] = ()
    prefix: str = "Issue"

    def holds(self) -> Column:
        """The base condition; equality on columns, so that it reaches the scan."""
        out = F.lit(True)
        for column, value in (("repository", self.repository), ("tracker", self.tracker)):
            out = out & (F.col(column) == value) if value is not None else out
        for label in self.labels:
            out = out & F.coalesce(F.array_contains("labels", label), F.lit(False))
        return out

    def issues(self, table: DataFrame) -> DataFrame:
        return table.filter(self.holds()).withColumn("dataset", F.lit(self.name))

    def issue_id(self, number: Column) -> Column:
        return F.concat(F.lit(f"{self.prefix}-"), number.cast("string"))
