"""Counts, shares, distributions, histograms and their percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions.text import percent, percent_text

# Upper bounds of the duration buckets in milliseconds; the last bucket has none.
BUCKETS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1_000, 2_000, 5_000, 10_000, 15_000, 30_000, 45_000, 60_000, 90_000, 120_000, 180_000)
NO_BOUND = 9223372036854775807


def distribution(df: DataFrame, value: Column, order: str, total: int | None = None, name: str = "value") -> DataFrame:
    """value, count, percent, first_seen of each value; sort by count, then first_seen, for the usual report.
    The percentage is of all rows (or ``total``); no global sort is forced here."""
    by = df.groupBy(value.alias(name)).agg(F.count("*").alias("count"), F.min(order).alias("first_seen"))
    if total is not None:
        return by.withColumn("percent", percent(F.col("count"), F.lit(total)))
    n = df.agg(F.count("*").alias("__n"))
    return by.crossJoin(F.broadcast(n)).withColumn("percent", percent(F.col("count"), F.col("__n"))).drop("__n")  # one row


def transitions(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """Counts and shares of label pairs."""
    by = df.groupBy(before.alias("screen"), after.alias("analyze")).agg(F.count("*").alias("count"))
    n = df.agg(F.count("*").alias("__n"))
    return by.crossJoin(F.broadcast(n)).withColumn("percent", percent(F.col("count"), F.col("__n"))).drop("__n")  # one row


def zero_filled(dim: DataFrame, dim_key: str, facts: DataFrame, fact_key: str, case: str, total: Column | None = None) -> DataFrame:
    """The dimension with the number of distinct cases of each entry, 0 included."""
    by = facts.groupBy(F.col(fact_key).alias("__k")).agg(F.count_distinct(case).alias("cases"))
    out = dim.join(by, dim[dim_key] == F.col("__k"), "left").drop("__k").withColumn("cases", F.coalesce("cases", F.lit(0)).cast("bigint"))
    return out if total is None else out.withColumn("share", percent_text(F.col("cases"), total))


def two_levels(df: DataFrame, upper: str, lower: str, case: str) -> DataFrame:
    """Distinct cases of each upper value and each (upper, lower) pair; the sums of the lower level do not add up to the upper."""
    return df.groupingSets([[upper], [upper, lower]], upper, lower).agg(F.count_distinct(case).alias("cases"), F.grouping(lower).alias("is_total"))


def conditional_counts(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """One count for each condition, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def features_by_case(occurrences: DataFrame, case: str = "case_id") -> DataFrame:
    """The distinct features of each case in the order they were first seen."""
    first = occurrences.groupBy(case, "feature").agg(F.min("seq").alias("seq"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "feature")))
    return first.groupBy(case).agg(F.transform(ordered, lambda x: x["feature"]).alias("features"))


def prevalence(features: DataFrame, cases: DataFrame, occurrences: DataFrame, case: str = "case_id") -> DataFrame:
    """feature, cases, share of the analysed cases for each reported feature, 0 included; skipped cases are in no denominator."""
    n = cases.agg(F.count_distinct(case).alias("n_cases"))
    seen = occurrences.join(cases.select(case).distinct(), case, "left_semi")
    out = zero_filled(features.filter("reported"), "feature", seen, "feature", case).crossJoin(F.broadcast(n))  # one row
    return out.select("ord", features["feature"], "cases", percent_text(F.col("cases"), F.col("n_cases")).alias("share"))


def details(occurrences: DataFrame, case: str = "case_id") -> DataFrame:
    """Occurrences and cases of each detail text."""
    return occurrences.filter("detail IS NOT NULL").groupBy("detail").agg(F.count("*").alias("occurrences"), F.count_distinct(case).alias("cases"))


def bucket(ms: Column) -> Column:
    """Upper bound of the bucket of a duration; negative ones count as 0."""
    ms = F.greatest(ms.cast("bigint"), F.lit(0))
    out = F.when(ms <= BUCKETS[0], BUCKETS[0])
    for b in BUCKETS[1:]:
        out = out.when(ms <= b, b)
    return out.otherwise(F.lit(NO_BOUND))


def histogram(df: DataFrame, by: list[str], ms: Column) -> DataFrame:
    """by, bucket, count, total, least, most."""
    x = F.greatest(ms.cast("bigint"), F.lit(0))
    return df.filter(ms.isNotNull()).groupBy(*by, bucket(ms).alias("bucket")).agg(F.count("*").alias("count"), F.sum(x).alias("total"), F.min(x).alias("least"), F.max(x).alias("most"))


def histogram_percentiles(hist: DataFrame, by: list[str], ps: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Count, average, least, most and the percentiles of a histogram: the bound of the first bucket that reaches the
    rank, in the last bucket the largest value. Windows run over at most 21 rows a group."""
    w = W.partitionBy(*by)
    run = hist.withColumns({"n": F.sum("count").over(w), "cum": F.sum("count").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)), "top": F.max("most").over(w)})
    at = lambda p: F.min(F.when(F.col("cum") >= F.greatest(F.ceil(F.col("n") * F.lit(p)), F.lit(1)), F.when(F.col("bucket") == NO_BOUND, F.col("top")).otherwise(F.col("bucket"))))
    return run.groupBy(*by).agg(F.sum("count").alias("count"), (F.sum("total") / F.sum("count")).alias("average"), F.min("least").alias("least"), F.max("most").alias("most"), *[at(p).alias(f"p{round(p * 100)}") for p in ps])


def accounting(df: DataFrame, by: list[str], outcome: Column, total: Column) -> DataFrame:
    """Routed outcomes, their sum, and what is not accounted for."""
    kinds = ("valid", "bug", "fail_compiled", "no_main", "discarded", "timeout", "environment", "internal")
    out = df.groupBy(*by).agg(total.alias("total"), *[F.count_if(outcome == k).alias(k) for k in kinds])
    known = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    return out.withColumn("accounted", known).withColumn("unaccounted", F.greatest(F.col("total") - F.col("accounted"), F.lit(0)))


def routed(verdict: Column, reason: Column, message: Column, filtered: Column, duplicate: Column) -> Column:
    """The counter an outcome goes to; a consistent failure is a compile failure by the word in its message."""
    return (
        F.when(verdict.isNull(), "internal")
        .when(verdict == "MATCH_SUCCESS", "valid")
        .when(verdict == "MATCH_FAILURE", F.when(reason == "MAIN_CLASS_NOT_FOUND", "no_main").when(message.contains("Compiler"), "fail_compiled").otherwise("discarded"))
        .when(verdict == "MATCH_TIMEOUT", "timeout")
        .when(verdict == "ENVIRONMENT_ERROR", "environment")
        .when(filtered | duplicate, "discarded")
        .otherwise("bug")
    )


def generations(df: DataFrame, generation: str, top: int = 10) -> DataFrame:
    """generation, n for 0 to top, 0 included."""
    spark = df.sparkSession
    by = df.groupBy(F.col(generation).cast("int").alias("generation")).agg(F.count("*").alias("n"))
    return spark.range(top + 1).select(F.col("id").cast("int").alias("generation")).join(by, "generation", "left").select("generation", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def size_report(df: DataFrame, chars: Column, batch: Column) -> DataFrame:
    """Items, characters, average, rough tokens and average batch size in one row."""
    return df.agg(F.count("*").alias("items"), F.sum(chars).alias("chars"), F.avg(chars).alias("average"), F.floor(F.sum(chars) / 4).alias("rough_tokens"), (F.count("*") / F.count_distinct(batch)).alias("per_batch"))


def crosstab(left: DataFrame, right: DataFrame, case: str, a: str, b: str) -> DataFrame:
    """a, b, cases: in how many cases a value of the left table meets one of the right."""
    l, r = left.select(case, a).distinct(), right.select(case, b).distinct()
    return l.join(r, case).groupBy(a, b).agg(F.count("*").alias("cases"))


def feature_lines(occurrences: DataFrame, case: str = "case_id", most: int = 10) -> DataFrame:
    """case, feature, lines: the first ``most`` lines with a feature in order, each once (a limit of the export)."""
    once = occurrences.groupBy(case, "feature", "line").agg(F.min("seq").alias("seq"))
    first = once.withColumn("__r", F.row_number().over(W.partitionBy(case, "feature").orderBy("line"))).filter(F.col("__r") <= most)
    ordered = F.array_sort(F.collect_list("line"))
    return first.groupBy(case, "feature").agg(F.array_join(F.transform(ordered, lambda x: x.cast("string")), ",").alias("lines"))
