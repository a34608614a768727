"""Duplicates by content hash, and set operations on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions.text import content_hash


def first_of_content(df: DataFrame, text: str, *order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each content (white space aside), in the given order."""
    w = W.partitionBy(*within, "__h").orderBy(*order)
    return df.withColumn("__h", content_hash(F.col(text))).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").withColumnRenamed("__h", "content_sha256")


def shared_contents(df: DataFrame, text: str, owner: str) -> DataFrame:
    """content_sha256, owners (number), first_owner for contents that more than one owner holds. An aggregation, not a
    self join: a content held by a third of all rows is one row after the partial aggregation."""
    by = df.filter(F.col(text).isNotNull()).groupBy(content_hash(F.col(text)).alias("content_sha256"))
    return by.agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("first_owner"), F.count("*").alias("copies")).filter("owners > 1")


def prior_occurrences(df: DataFrame, text: str, owner: str, order: str) -> DataFrame:
    """Rows whose content was held by another owner earlier, with that first owner."""
    keyed = df.withColumn("content_sha256", content_hash(F.col(text)))
    first = keyed.groupBy("content_sha256").agg(F.min(F.struct(order, owner)).alias("__f"))
    return keyed.join(first, "content_sha256").filter((F.col(f"__f.{owner}") != F.col(owner))).select(order, owner, "content_sha256", F.col(f"__f.{owner}").alias("first_owner"))


def ordered_distinct(items: Column, *first: Column, without: tuple[str, ...] = ("Unknown",)) -> Column:
    """The given values, then the items, each once and in order, without the excluded ones and nulls."""
    both = F.concat(F.array(*first), F.coalesce(items, F.array().cast("array<string>"))) if first else F.coalesce(items, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull() & ~x.isin(*without)))


def no_subset(a: Column, b: Column) -> Column:
    """Neither of two arrays holds the other."""
    return (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)


def distinct_capped(df: DataFrame, owner: str, keys: list[str], order: str, most: int) -> DataFrame:
    """Distinct keys of each owner in order of appearance, at most ``most`` (a feature of the report)."""
    first = df.groupBy(owner, *keys).agg(F.min(order).alias(order))
    return first.withColumn("__r", F.row_number().over(W.partitionBy(owner).orderBy(order, *keys))).filter(F.col("__r") <= most).drop("__r")
