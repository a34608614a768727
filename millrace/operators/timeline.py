"""Date windows, evaluation windows, keyed state and decision caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def date_windows(df: DataFrame, start: str, end: str, days: int = 90) -> DataFrame:
    """Adds from_day and to_day (inclusive): windows of ``days`` days from start, the last one cut at end."""
    step = F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"INTERVAL {days} DAY")))
    return df.filter(F.col(start) <= F.col(end)).withColumn("from_day", step).withColumn("to_day", F.least(F.date_add("from_day", days - 1), F.col(end)))


def split_windows(daily: DataFrame, start: str, end: str, limit: int = 900) -> DataFrame:
    """from_day, to_day, n: the whole range halved until each window holds at most ``limit``; a single day beyond it is
    kept and marked. ``daily`` (day, n) has one row a day, so prefix sums are a bounded table of days."""
    from datetime import date, timedelta

    spark = daily.sparkSession
    lo, hi = date.fromisoformat(start), date.fromisoformat(end)
    days = (hi - lo).days + 1
    if days > 200_000:
        raise ValueError("range of days too long")
    have = {r["day"]: r["n"] for r in daily.filter(F.col("day").between(F.lit(lo), F.lit(hi))).groupBy("day").agg(F.sum("n").alias("n")).collect()}
    sums = [0]
    for k in range(days):
        sums.append(sums[-1] + int(have.get(lo + timedelta(k), 0)))
    out, stack = [], [(0, days - 1)]
    while stack:
        a, b = stack.pop()
        n = sums[b + 1] - sums[a]
        if n <= limit or a == b:
            out.append((lo + timedelta(a), lo + timedelta(b), n, n > limit))
        else:
            mid = a + (b - a) // 2
            stack += [(mid + 1, b), (a, mid)]
    return spark.createDataFrame(out, "from_day date, to_day date, n bigint, over_limit boolean")


def window_statistics(samples: DataFrame, ts: str, width: str = "2 minutes", least: int = 10) -> DataFrame:
    """Tumbling windows with at least ``least`` completions: throughput of productive ones, mean load (negative samples
    are invalid), mean wait (whole milliseconds). Works on batches and streams (with a watermark)."""
    w = F.window(ts, width)
    seconds = (F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))) / 1_000_000
    by = samples.groupBy(w.alias("w")).agg(
        F.count("*").alias("completed"),
        F.count_if("productive").alias("productive"),
        F.avg(F.when(F.col("cpu") >= 0, F.col("cpu"))).alias("cpu"),
        F.floor(F.sum(F.greatest("wait_ms", F.lit(0))) / F.count("*")).alias("wait_ms"),
    )
    return by.filter(F.col("completed") >= least).select(F.col("w.start").alias("start"), "completed", "productive", (F.col("productive") / seconds).alias("throughput"), F.coalesce("cpu", F.lit(-1.0)).alias("cpu"), "wait_ms")


def against_previous(stats: DataFrame, order: str = "start", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the throughput before, and raise/lower/hold: the comparison of a window with the one before it."""
    w = W.partitionBy(*by).orderBy(order) if by else W.orderBy(order)
    before, wait = F.lag("throughput").over(w), F.lag("wait_ms").over(w)
    limit = F.greatest(F.lit(100), F.round(F.coalesce(wait, F.lit(0)) * 1.2))
    up = (F.col("cpu") >= 0) & (F.col("cpu") < 0.85) & (F.col("wait_ms") <= limit) & (F.col("throughput") > before * 1.03)
    down = (F.col("cpu") >= 0.95) | (F.col("wait_ms") > limit * 2) | (F.col("throughput") < before * 0.97)
    return stats.withColumn("before", before).withColumn("advice", F.when(before.isNull(), "first").when(up, "raise").when(down, "lower").otherwise("hold"))


def worker_plan(stats: DataFrame, by: str, most_workers: int, start: int = 1, settle: int = 3) -> DataFrame:
    """by, start, workers, reason: the recurrence over the windows of each group in order (rows streamed, state constant)."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, base, stable, settled = object(), start, None, 0, False
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if getattr(r, by) != key:
                    key, n, base, stable, settled = getattr(r, by), start, None, 0, False
                if settled:
                    rows.append((key, r.start, n, "settled"))
                    continue
                limit = 100 if base is None or base.wait_ms <= 0 else max(100, round(base.wait_ms * 1.2))
                if base is None:
                    why, stable = "first", 0
                elif n < most_workers and 0 <= r.cpu < 0.85 and r.wait_ms <= limit and r.throughput > base.throughput * 1.03:
                    n, why, stable = n + 1, "raise", 0
                elif n > 1 and (r.cpu >= 0.95 or r.wait_ms > 2 * limit or r.throughput < base.throughput * 0.97):
                    n, why, stable = n - 1, "lower", 0
                elif r.cpu < 0.95 and r.wait_ms <= limit and r.throughput <= base.throughput * 1.03:
                    stable += 1
                    why, settled = "stable", stable >= settle
                else:
                    why, stable = "hold", 0
                base = r
                rows.append((key, r.start, n, why))
            yield pd.DataFrame(rows, columns=[by, "start", "workers", "reason"])

    types = dict(stats.dtypes)
    return stats.repartition(by).sortWithinPartitions(by, "start").mapInPandas(fold, f"{by} {types[by]}, start {types['start']}, workers int, reason string")


def query_window(df: DataFrame, first: str, last: str, instant: str) -> DataFrame:
    """Rows whose instant lies in the days first to last, both included, as a half-open range that reaches the scan."""
    return df.filter((F.col(instant) >= F.col(first).cast("timestamp")) & (F.col(instant) < F.date_add(F.col(last), 1).cast("timestamp")))


def emergency_steps(samples: DataFrame, by: str, ts: str, cpu: str, limit: float = 0.98, needed: int = 2) -> DataFrame:
    """The samples at which one worker has to go at once: every second one in a row at or beyond the limit (each step begins
    the count anew). One window over the samples of a group; where only one worker is left the caller keeps it."""
    w = W.partitionBy(by).orderBy(ts)
    calm = F.coalesce(F.col(cpu) < limit, F.lit(True))
    runs = samples.withColumn("__run", F.sum(calm.cast("int")).over(w))
    k = F.sum((~calm).cast("int")).over(W.partitionBy(by, "__run").orderBy(ts))
    return runs.withColumn("__k", k).filter(~calm & (F.col("__k") % needed == 0)).drop("__run", "__k")


def upserted(state: DataFrame, changes: DataFrame, key: str, updated: str, tie: str) -> DataFrame:
    """The state table after the changes: the newest row of each key."""
    w = W.partitionBy(key).orderBy(F.desc_nulls_last(updated), F.desc(tie))
    return state.unionByName(changes).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def encoded_decision(accepted: Column, reason: Column, rule: Column, detail: Column) -> Column:
    """A for accepted; R|reason|rule|detail with the last two in base 64."""
    b64 = lambda c: F.base64(F.encode(F.coalesce(c, F.lit("")), "UTF-8"))
    return F.when(accepted, "A").otherwise(F.concat_ws("|", F.lit("R"), F.coalesce(reason, F.lit("")), b64(rule), b64(detail)))


def decoded_decision(value: Column) -> Column:
    """accepted, reason, rule, detail of an encoded decision."""
    p = F.split(value, r"\|", -1)
    text = lambda k: F.decode(F.unbase64(F.get(p, F.lit(k))), "UTF-8")
    return F.struct((value == "A").alias("accepted"), F.when(value != "A", F.get(p, F.lit(1))).alias("reason"), F.when(value != "A", text(2)).alias("rule"), F.when(value != "A", text(3)).alias("detail"))
