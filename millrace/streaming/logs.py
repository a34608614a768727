"""Grouping of log lines by context, in batches and as a stream."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Forms of a log line.
CONTEXT = r"\[([^\]]+)\] - "
LEVEL = r"^\[(INFO|DEBUG|WARN|ERROR|FATAL|TRACE)\s*\].*"
BUG = "BUG FOUND"


def grouped_lines(lines: DataFrame, source: str = "source", order: str = "line_no", text: str = "text") -> DataFrame:
    """Adds context: a line with ``[context] - `` opens or continues it, a plain level line ends it, other lines belong to
    the one that is open; null is no context. The running state is ``last`` over a window for each source."""
    ctx = F.nullif(F.regexp_extract(text, CONTEXT, 1), F.lit(""))
    mark = F.when(ctx.isNotNull(), F.struct(ctx.alias("c"))).when(F.col(text).rlike(LEVEL), F.struct(F.lit(None).cast("string").alias("c")))
    w = W.partitionBy(source).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("context", F.last(mark, ignorenulls=True).over(w)["c"])


def group_report(grouped: DataFrame, source: str = "source", order: str = "line_no", text: str = "text") -> DataFrame:
    """source, context, first_line, lines, has_bug of each context."""
    return grouped.groupBy(source, "context").agg(F.min(order).alias("first_line"), F.count("*").alias("lines"), F.max(F.col(text).contains(BUG)).alias("has_bug"))


def stream_grouped_lines(lines: DataFrame, source: str = "source", order: str = "line_no", text: str = "text") -> DataFrame:
    """As ``grouped_lines`` for a stream: the open context of each source is the state. Lines of a source must arrive in
    order over micro-batches, as a file source gives them; complete lines only are read."""
    names, types = lines.columns, ", ".join(f"{k} {t}" for k, t in lines.dtypes)
    find, level = re.compile(CONTEXT).search, re.compile(LEVEL).match

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        part = pd.concat(list(batches)).sort_values(order)
        out = []
        for t in part[text]:
            if m := find(t or ""):
                now = m[1]
            elif level(t or ""):
                now = None
            out.append(now)
        state.update((now,))
        yield part[names].assign(context=out)

    return lines.groupBy(source).applyInPandasWithState(step, f"{types}, context string", "context string", "append", GroupStateTimeout.NoTimeout)
