"""New batches against all history (problem 3).

The history is a folder with two bucketed Parquet tables: ``keys`` (minwise band keys with the size
and id they stand for, bucketed and sorted by key) and ``records`` (id, class digest, size,
signature, text; bucketed and sorted by id). Only the least id of each class of equal sets is kept.
``check`` takes the rows of one or more new batches, gives each that is similar to an earlier row,
and appends the classes that are new:

1. Band keys of the new classes are probed. If they are few, they are pushed into the scan: Spark
   prunes the buckets, Parquet skips the pages whose key range holds none. If they are many, they
   are joined bucket by bucket: only they are shuffled, the history is read where it lies.
2. Candidates pass the Bayesian test on signatures and are verified on whole texts; records are
   looked up by id in the same two ways. A candidate of equal class digest is a copy.
3. Keys that more than ``hot`` rows share do not give pairs; their ids go through the exact prefix
   filter.
4. Classes the history does not hold (or holds by a greater id only) are appended. Nothing is
   compared with the history as a whole. Rows repeated in a call, or by an append that broke off and
   was made again, are repeated records and keys, which changes no result.

A table that has outgrown its number of buckets is rewritten with four times as many, so the cost
of growing stays in proportion to what is added.

Defined results: null texts and texts with fewer tokens than a run match nothing; rows without a
batch number are left out; every row of the history counts as earlier than every row of a call, and
within a call batches follow their numbers; rows of one batch are not compared with each other;
``sha256`` is only a hint that may be null or stale, so equality is taken from the texts; rows
repeated under one id count once; ids need not rise with the batches.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.shingles import Similarity, bucket_pairs, prefix_pairs, prune, signatures, verify
from millrace.session import discard, exists, fresh_path, read_text, write_text, written

_COLUMNS = {"keys": "key bigint, n int, id bigint", "records": "id bigint, cls binary, n int, sig binary, text string"}
_BY = {"keys": "key", "records": "id"}
#: Spark takes no more buckets; beyond, they become larger.
_MOST_BUCKETS = 100_000
#: Scans among which a look-up of few keys is divided, by their buckets.
_SCANS = 16


def _any_of(c: Column, values: list[int]) -> Column:
    """Whether c is one of the values, as a balanced tree of equalities: a list of values would reach the pages of the scan
    as their range only."""
    if len(values) < 2:
        return c == F.lit(values[0]) if values else F.lit(False)
    half = len(values) // 2
    return _any_of(c, values[:half]) | _any_of(c, values[half:])


class History:
    """What has been accepted so far, as tables below ``path``; a path that is there already is continued."""

    def __init__(self, spark: SparkSession, path: str, sim: Similarity = Similarity(), keys_a_bucket: int = 2_000_000, pushed: int = 1024, page_rows: int = 256) -> None:
        self.spark, self.path, self.sim, self.keys_a_bucket, self.pushed, self.page_rows = spark, path.rstrip("/"), sim, keys_a_bucket, pushed, page_rows
        state = f"{self.path}/state.json"
        #: version and buckets of the tables, and about how many keys they hold.
        self.state: dict = json.loads(read_text(spark, state)) if exists(spark, state) else {"version": 0, "buckets": 0, "keys": 0}
        self._names: dict[tuple[str, int], str] = {}

    @property
    def empty(self) -> bool:
        return not self.state["buckets"]

    def _table(self, kind: str) -> str:
        """Name under which this session knows the present version of a table."""
        at = kind, self.state["version"]
        if at not in self._names:
            name = f"millrace_{kind}_{uuid.uuid4().hex}"
            by, n = _BY[kind], self.state["buckets"]
            # Short pages, so that a look-up of a few keys reads a few of them.
            self.spark.sql(
                f"CREATE TABLE {name} ({_COLUMNS[kind]}) USING parquet OPTIONS ('parquet.page.row.count.limit'='{max(1, self.page_rows)}', 'compression'='zstd') CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{self.path}/{kind}-{at[1]}'"
            )
            self._names[at] = name
        return self._names[at]

    def close(self) -> None:
        """Take the names of the tables out of the session's catalog; the files stay where they are."""
        while self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._names.popitem()[1]}")

    def keys(self) -> DataFrame:
        return self.spark.table(self._table("keys"))

    def records(self) -> DataFrame:
        return self.spark.table(self._table("records"))

    def _insert(self, kind: str, df: DataFrame, placed: bool = False) -> None:
        by, rows = _BY[kind], df.select(*[c.split()[0] for c in _COLUMNS[kind].split(", ")])
        (rows if placed else rows.repartition(self.state["buckets"], by)).write.insertInto(self._table(kind))

    def picked(self, kind: str, columns: list[str], wanted: DataFrame, size: int | None = None) -> DataFrame:
        """Rows of a table whose key (or id) is among ``wanted`` (one column, of ``size`` rows; counted if not given): read
        from the pages that hold them if they are few and these pages a small part of the table, else by a join with the
        table as it is bucketed."""
        by, rows = _BY[kind], self.spark.table(self._table(kind)).select(*columns)
        size = wanted.count() if size is None else size
        held = self.state["keys"] if kind == "keys" else self.state["keys"] // self.sim.bands
        if size > self.pushed or size * self.page_rows > held / 4:
            return rows.join(wanted.toDF(by).hint("shuffle_hash"), by, "left_semi")
        # Each bucket is sorted over all keys, so a scan of many buckets would read a page in each for every key: the
        # buckets are scanned in groups, each with the keys that belong there.
        group = F.pmod(F.pmod(F.hash(by), F.lit(self.state["buckets"])), F.lit(_SCANS))
        of: dict[int, set[int]] = {}
        for value, g in wanted.toDF(by).select(by, group).collect():  # at most ``pushed`` numbers
            of.setdefault(g, set()).add(value)
        parts = [rows.filter(_any_of(F.col(by), sorted(values))) for _, values in sorted(of.items())] or [rows.limit(0)]
        return written(reduce(DataFrame.unionByName, parts), "picked")

    def append(self, entries: DataFrame, texts: DataFrame) -> None:
        """Add entries (id, cls, n, bands, sig) with their texts (id, text)."""
        count = entries.count()
        if not count:
            return
        keys = self.state["keys"] + count * self.sim.bands
        if self.empty:
            self.state["buckets"] = min(_MOST_BUCKETS, max(16, -(-keys // self.keys_a_bucket)))
            write_text(self.spark, f"{self.path}/state.json", json.dumps(self.state))
        # A record without keys is never looked up, so the records go first.
        # Both sides of the join are shuffled by the buckets of the table, so its rows are where they are written.
        n = self.state["buckets"]
        full = entries.select("id", "cls", "n", "sig").repartition(n, "id").join(texts.repartition(n, "id").hint("merge"), "id")
        self._insert("records", full, placed=True)
        self._insert("keys", entries.select(F.explode("bands").alias("key"), "n", "id"))
        self.state["keys"] = keys
        if keys > 4 * self.keys_a_bucket * self.state["buckets"] and self.state["buckets"] < _MOST_BUCKETS:
            self._grow()
        write_text(self.spark, f"{self.path}/state.json", json.dumps(self.state))

    def _grow(self) -> None:
        """Both tables with four times as many buckets, as a new version; the old one stays for readers that have it."""
        old = {kind: self.spark.table(self._table(kind)) for kind in _COLUMNS}
        self.state |= {"version": self.state["version"] + 1, "buckets": min(_MOST_BUCKETS, 4 * self.state["buckets"])}
        for kind, df in old.items():
            self._insert(kind, df)

    def check(self, rows: DataFrame, id_col: str, text_col: str, batch_col: str) -> DataFrame:
        """earlier_id, id: each row that is similar to one of the history or of an earlier batch of the call, with the least
        such id. Then the call's classes are part of the history."""
        sim = self.sim
        src = rows.filter(F.col(batch_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(batch_col).alias("batch")).filter("text IS NOT NULL AND id IS NOT NULL")
        texts = src.select("id", "text")
        sigs = written(signatures(src, "id", "text", sim, keep=("batch",)).withColumn("row", F.monotonically_increasing_id()), "batches")
        # One row of each class stands for it: of its least id, and of rows repeated under that the first.
        least = written(sigs.groupBy("cls").agg(F.min(F.struct("id", "row")).alias("at")).select("cls", F.col("at.id").alias("rep"), F.col("at.row").alias("row")), "classes")
        members = written(sigs.select("id", "batch", "cls").distinct().join(least, "cls").select("id", "batch", "rep"), "members")
        reps = written(sigs.join(least.select("row"), "row", "left_semi").drop("batch", "row"), "representatives")
        discard(sigs)  # all of it is in the two tables
        if self.empty and members.select("batch").distinct().limit(2).count() < 2:
            # The first batch of all: there is nothing earlier.
            self.append(reps, texts)
            return self.spark.createDataFrame([], "earlier_id bigint, id bigint")

        old, new, hot = self._candidates(reps)
        ours = reps.select("id", "sig", "cls")
        theirs, their_texts = ours.limit(0), texts.limit(0)
        if not self.empty:
            ids = written(old.select("a").union(hot.filter("old").select(F.col("id").alias("a"))).distinct(), "ids")
            theirs = self.picked("records", ["id", "sig", "cls"], ids)
            their_texts = self.picked("records", ["id", "text"], ids)
        if hot.head(1):
            wide = self._hot_pairs(hot, texts, their_texts)
            old = old.unionByName(wide.filter("old").select("a", "b")).distinct()
            new = new.unionByName(wide.filter("NOT old").select("a", "b")).distinct()
        found_new = verify(prune(new, ours, sim), texts, sim).select("a", "b")
        left = written(prune(old, theirs, sim, ours), "left")
        copies = left.filter("same").select("a", "b")
        found_old = written(copies.unionByName(verify(left.filter("NOT same").select("a", "b"), texts, sim, texts_a=their_texts).select("a", "b")).distinct(), "old")

        answer = written(self._earlier(members, found_old, found_new), "earlier")
        self.append(reps.join(copies.filter("a <= b").select(F.col("b").alias("id")), "id", "left_anti"), texts)
        return answer

    def _candidates(self, reps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(a of the history, b of reps), (a < b of reps) that share a key, and hot (id, old): members of hot keys."""
        mine = reps.select(F.explode("bands").alias("key"), "n", "id")
        rows = mine.withColumn("side", F.lit(1))
        if not self.empty:
            probe = reps.select(F.explode("bands").alias("key"))
            rows = self.picked("keys", ["key", "n", "id"], probe, reps.count() * self.sim.bands).withColumn("side", F.lit(0)).unionByName(rows)
        raw = written(bucket_pairs(rows, self.sim).distinct(), "near")
        pairs = raw.filter("b IS NOT NULL AND a <> b")
        return pairs.filter("old").select("a", "b"), pairs.filter("NOT old").select("a", "b"), raw.filter("b IS NULL").select(F.col("a").alias("id"), "old").distinct()

    def _hot_pairs(self, hot: DataFrame, texts: DataFrame, their_texts: DataFrame) -> DataFrame:
        """a, b, old of the members of hot keys, by the exact prefix filter; pairs within the history are left out."""
        both = texts.join(hot.filter("NOT old").select("id"), "id", "left_semi").unionByName(their_texts.join(hot.filter("old").select("id"), "id", "left_semi"))
        side = lambda k: hot.select(F.col("id").alias(k), F.col("old").alias(f"old_{k}"))
        wide = prefix_pairs(both.dropDuplicates(["id"]), self.sim).join(side("a"), "a").join(side("b"), "b").filter("NOT (old_a AND old_b)")
        turned = F.col("old_b")
        return wide.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), (F.col("old_a") | F.col("old_b")).alias("old"))

    @staticmethod
    def _earlier(members: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
        """earlier_id, id of every member: the least id of similar classes of the history, of earlier batches of its own class
        and of similar classes."""
        heads = members.groupBy("rep", "batch").agg(F.min("id").alias("head"))
        from_history = heads.select("rep", "batch").join(old.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("earlier_id")), "rep")
        before = F.min("head").over(W.partitionBy("rep").orderBy("batch").rowsBetween(W.unboundedPreceding, -1))
        own = heads.select("rep", "batch", before.alias("earlier_id")).filter("earlier_id IS NOT NULL")
        ways = new.unionByName(new.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = heads.select(F.col("rep").alias("a"), F.col("batch").alias("batch_a"), "head")
        others = ways.join(first, "a").join(heads.select(F.col("rep").alias("b"), "batch"), "b").filter("batch_a < batch")
        others = others.groupBy(F.col("b").alias("rep"), "batch").agg(F.min("head").alias("earlier_id"))
        best = from_history.unionByName(own).unionByName(others).groupBy("rep", "batch").agg(F.min("earlier_id").alias("earlier_id"))
        return members.join(best, ["rep", "batch"]).select("earlier_id", "id")


def found_earlier(artifacts: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """earlier_id, artifact_id: each artifact with the lowest similar artifact of an earlier batch. The first batch makes the
    history, the others are checked against it and one another."""
    spark = artifacts.sparkSession
    history = History(spark, fresh_path(spark, "history"), sim)
    first = artifacts.agg(F.min("batch_no")).head(1)[0][0]  # one number
    history.check(artifacts.filter(F.col("batch_no") == F.lit(first)), "artifact_id", "content", "batch_no")
    found = history.check(artifacts.filter(F.col("batch_no") > F.lit(first)), "artifact_id", "content", "batch_no")
    history.close()
    return found.withColumnRenamed("id", "artifact_id")
