"""Near-duplicate texts with small edits (problem 5).

MinHash bands give candidate pairs of distinct texts; the Bayesian test compares their MinHash
values in steps and drops a pair when the posterior chance that it reaches the threshold falls
below the tolerance; the rest is verified on whole texts. Equal sets of runs are one class from
the start, so copies never meet in a bucket. Members of buckets beyond ``hot`` go through an
exact prefix filter instead of being paired within the bucket.

Defined results: null texts and texts with fewer tokens than a run are in no pair; equal texts
under different ids are pairs of similarity 1; rows repeated under one id count once; an empty
table gives no pairs. The chance that a pair at the threshold shares no band is
``1 - Similarity.recall(threshold)`` (0.6 % at 0.6, under 0.01 % from 0.66 on).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shingles import Similarity, bucket_pairs, prefix_pairs, prune, signatures, verify
from millrace.session import written


def classes(sigs: DataFrame) -> DataFrame:
    """id, rep: each id with the least id whose set of runs is the same."""
    reps = sigs.groupBy("cls").agg(F.min("id").alias("rep"))
    return sigs.select("id", "cls").distinct().join(reps, "cls").select("id", "rep")


def similar_representatives(df: DataFrame, id_col: str, text_col: str, sim: Similarity) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members id, rep; pairs a < b, similarity, of representatives of different sets."""
    sigs = written(signatures(df, id_col, text_col, sim), "signatures")
    members = written(classes(sigs), "members")
    reps = sigs.join(members.filter("id = rep").select("id"), "id", "left_semi")
    keys = reps.select("id", "n", F.explode("bands").alias("key"))
    raw = written(bucket_pairs(keys, sim).distinct(), "candidates")
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    pairs = raw.filter("a <> b")
    hot = raw.filter("b IS NULL").select(F.col("a").alias("id"))
    if hot.head(1):
        one = texts.join(hot, "id", "left_semi").dropDuplicates(["id"])
        pairs = pairs.unionByName(prefix_pairs(one, sim)).distinct()
    left = prune(pairs, reps.select("id", "sig"), sim)
    return members, verify(left, texts, sim).dropDuplicates(["a", "b"])


#: Copies of a class that are paired with all of it in one task, about.
PART = 2000


def pairs_of(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of ids (a < b): those of similar classes and those within a class."""
    x, y = members.select(F.col("rep").alias("a"), F.col("id").alias("i")), members.select(F.col("rep").alias("b"), F.col("id").alias("j"))
    across = pairs.select("a", "b").join(x, "a").join(y, "b").filter("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    # A class of many copies is divided: each of its parts meets the whole class in a task of its own.
    parts = members.groupBy("rep").agg(F.ceil(F.count("*") / PART).cast("bigint").alias("parts"))
    sized = members.join(parts, "rep")
    l = sized.select("rep", "id", F.pmod(F.xxhash64("id"), "parts").alias("part")).alias("l")
    r = sized.select("rep", "id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")).alias("r")
    within = l.join(r, (F.col("l.rep") == F.col("r.rep")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    return across.unionByName(within)


def found_pairs(artifacts: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """artifact_a, artifact_b of every similar pair."""
    members, pairs = similar_representatives(artifacts, "artifact_id", "content", sim)
    return pairs_of(members, pairs).select(F.col("a").alias("artifact_a"), F.col("b").alias("artifact_b"))


def found_classes(artifacts: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """artifact_id, class_id, copies in its class, links of its class to other classes."""
    members, pairs = similar_representatives(artifacts, "artifact_id", "content", sim)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    return members.join(sizes, "rep").join(links, "rep", "left").select(F.col("id").alias("artifact_id"), F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
