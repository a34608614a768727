"""Frequency of every distinct value or term, by a suffix array (problem 4).

Each record is a sequence of terms. Its suffixes are sorted within the record, and each suffix
keeps the length of the prefix it shares with the one before it there: an n-gram no longer than
that is a repetition within the record. Equal suffixes are then combined with their counts
before the shuffle, so a value in a third of all rows is one row. Range partitioning of the
distinct suffixes gives the suffix array in pieces; common-prefix intervals are read off by one
pass over each piece: the occurrences of an n-gram are the weight of its interval, its records
the weight less the within-record duplicates. Intervals that go over the edge of a piece are
added up at the end.

Suffixes are whole and n-grams of every length come out, unless a caller that needs only short
ones gives ``max_n``. All n-grams of a record of m terms are m (m + 1) / 2 rows, and its
suffixes hold as many terms: this is for values and short texts.

Defined results: null, empty and blank values give no term; equal rows are separate records; an
empty table gives no rows; a term that is both rare and common is rare.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

_TERM = re.compile(r"[A-Za-z0-9_]+")


#: Terms held by a Python worker before rows are given out.
_HELD_TERMS = 500_000


def record_suffixes(terms: list[str], max_n: int | None = None) -> Iterator[tuple[tuple[str, ...], int]]:
    """The suffixes of a record (whole, or cut to max_n terms) in order, with the prefix length shared with the one before."""
    before: tuple[str, ...] = ()
    for s in sorted(tuple(terms[k:] if max_n is None else terms[k : k + max_n]) for k in range(len(terms))):
        shared = 0
        for x, y in zip(before, s, strict=False):
            if x != y:
                break
            shared += 1
        yield s, shared
        before = s


def weighted_suffixes(df: DataFrame, value_fields: tuple[str, ...], term_fields: tuple[str, ...], max_n: int | None = None) -> DataFrame:
    """field, suffix, shared, occ: distinct suffixes with their occurrences, by the length of the prefix that is a
    duplicate within the record."""
    cols = [*value_fields, *term_fields]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[tuple[str, tuple[str, ...], int]] = Counter()
        size = 0

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"field": [k[0] for k in held], "suffix": [list(k[1]) for k in held], "shared": [k[2] for k in held], "occ": list(held.values())})

        for b in batches:
            for f in cols:
                for v in b[f]:
                    if v is None:
                        continue
                    terms = [t] if f in value_fields and (t := v.strip().lower()) else [] if f in value_fields else [t.lower() for t in _TERM.findall(v)]
                    for s, shared in record_suffixes(terms, max_n):
                        k = f, s, shared
                        size += 0 if k in held else len(s)
                        held[k] += 1
                        if size > _HELD_TERMS:
                            yield rows()
                            held.clear()
                            size = 0
        if held:
            yield rows()

    part = df.select(*[F.col(c).cast("string") for c in cols]).mapInPandas(cut, "field string, suffix array<string>, shared int, occ bigint")
    return part.groupBy("field", "suffix", "shared").agg(F.sum("occ").alias("occ"))


def ngram_counts(df: DataFrame, value_fields: tuple[str, ...] = (), term_fields: tuple[str, ...] = (), max_n: int | None = None) -> DataFrame:
    """field, ngram (array), n, occurrences, records of every n-gram (of up to max_n terms, if given)."""
    # Written first: the range partitioning below reads its input twice.
    suffixes = written(weighted_suffixes(df, value_fields, term_fields, max_n), "suffixes")
    array = suffixes.repartitionByRange("field", "suffix").sortWithinPartitions("field", "suffix")

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple[str, ...] = ()
        field = None
        open_: list[list[int]] = []  # occurrences and records of the prefixes of `now`, without those of longer ones
        done: list[tuple] = []
        size = 0

        def rows() -> pd.DataFrame:
            return pd.DataFrame(done, columns=["field", "ngram", "n", "occ", "recs"])

        def close(depth: int) -> Iterator[pd.DataFrame]:
            nonlocal size
            while len(open_) > depth:
                n = len(open_)
                occ, recs = open_.pop()
                if open_:
                    open_[-1][0] += occ
                    open_[-1][1] += recs
                done.append((field, list(now[:n]), n, occ, recs))
                size += n
                if size > _HELD_TERMS:
                    yield rows()
                    done.clear()
                    size = 0

        for b in batches:
            for f, s, repeated, occ in zip(b["field"], b["suffix"], b["shared"], b["occ"], strict=True):
                s = tuple(s)
                shared = 0
                if f == field:
                    while shared < min(len(now), len(s)) and now[shared] == s[shared]:
                        shared += 1
                yield from close(shared)
                field, now = f, s
                open_ += [[0, 0] for _ in range(len(s) - len(open_))]
                open_[-1][0] += occ
                open_[-1][1] += occ
                if repeated:
                    open_[repeated - 1][1] -= occ
        yield from close(0)
        if done:
            yield rows()

    pieces = array.mapInPandas(intervals, "field string, ngram array<string>, n int, occ bigint, recs bigint")
    return pieces.groupBy("field", "ngram", "n").agg(F.sum("occ").alias("occurrences"), F.sum("recs").alias("records"))


def marked(counts: DataFrame, rows: int, rare: int = 2, common: float = 0.25) -> DataFrame:
    """Adds mark: rare (in at most ``rare`` records), common (in more than that share of the rows) or null."""
    return counts.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * rows, "common"))


def term_report(df: DataFrame, value_fields: tuple[str, ...], term_fields: tuple[str, ...]) -> DataFrame:
    """field, term, occurrences, records, mark of every single value or term."""
    singles = ngram_counts(df, value_fields, term_fields).filter("n = 1")
    return marked(singles.select("field", F.col("ngram")[0].alias("term"), "occurrences", "records"), df.count())
