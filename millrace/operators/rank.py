"""Scores, top-k, budgets, weighted order and names without collisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StructField, StructType

# Terms of diagnostic value in a comment.
TERMS = (
    "root cause", "regression", "regressed", "introduced", "bisect", "fix", "fixed", "patch", "commit", "pull request", "reproducer",
    "reproduce", "workaround", "crash", "assert", "assertion", "fatal", "segfault", "SIGSEGV", "exception", "wrong code", "miscompile",
    "incorrect result", "stack trace", "failure", "fails", "failed",
)


def term_pattern(terms: tuple[str, ...] = TERMS) -> str:
    """One alternation, longest term first."""
    return "(?i)" + "|".join(sorted(terms, key=len, reverse=True))


# Points of a comment for its place, for each term (and at most), a code block, a stack frame, a link, a
# commit; and what is taken off a short one.
FIRST, LAST, TERM, TERMS_MOST, FENCE, FRAME, LINK, COMMIT, SHORT = 8, 8, 3, 30, 4, 4, 3, 2, 4


def text_score(text: Column, terms: tuple[str, ...] = TERMS) -> Column:
    """Value of a comment as evidence by its text alone."""
    return (
        F.least(F.regexp_count(text, F.lit(term_pattern(terms))) * TERM, F.lit(TERMS_MOST))
        + F.when(text.contains("```"), FENCE).otherwise(0)
        + F.when(text.rlike(r"\bat\s+[\w.$]+\([^)]*\)"), FRAME).otherwise(0)
        + F.when(text.rlike(r"https?://(?:github\.com|bugs\.openjdk\.org)"), LINK).otherwise(0)
        + F.when(text.rlike(r"(?i)\b[0-9a-f]{7,40}\b"), COMMIT).otherwise(0)
        - F.when(F.length(F.trim(text)) < 40, SHORT).otherwise(0)
    )


def comment_score(text: Column, position: Column, total: Column, terms: tuple[str, ...] = TERMS) -> Column:
    """Value of a comment as evidence; position counts from 0."""
    return text_score(text, terms) + F.when(position == 0, FIRST).otherwise(0) + F.when(position == total - 1, LAST).otherwise(0)


def top_comments(df: DataFrame, case: str, order: str, text: str, k: int, tie: str) -> DataFrame:
    """case, order, tie, position, score: the k best comments of each case and always its first and last. Texts are scored
    before the windows and do not go through them; join them back by ``tie`` where they are needed."""
    scored = df.select(case, order, tie, text_score(F.coalesce(F.col(text), F.lit(""))).alias("__s"))
    by = W.partitionBy(case).orderBy(order, tie)
    placed = scored.withColumns({"position": F.row_number().over(by) - 1, "__n": F.count("*").over(W.partitionBy(case))})
    last = F.col("position") == F.col("__n") - 1
    points = placed.withColumn("score", F.col("__s") + F.when(F.col("position") == 0, FIRST).otherwise(0) + F.when(last, LAST).otherwise(0))
    r = F.row_number().over(W.partitionBy(case).orderBy(F.desc("score"), "position"))
    return points.withColumn("__r", r).filter((F.col("__r") <= k) | (F.col("position") == 0) | last).drop("__r", "__n", "__s")


def budget_shares(sizes: Column, budget: int, least: int = 600, most: int = 3000) -> Column:
    """Share of each of an ordered array of block sizes: an equal part of what is left, within bounds, in turn."""
    n = F.size(sizes)
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        rest = F.greatest(n - F.size(acc["out"]), F.lit(1))
        share = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(acc["left"] / rest)))
        used = F.when(acc["left"] <= 0, F.lit(0)).otherwise(F.least(size, share, acc["left"])).cast("bigint")
        return F.struct((acc["left"] - used).cast("bigint").alias("left"), F.concat(acc["out"], F.array(used)).alias("out"))

    return F.aggregate(sizes, start, step)["out"]


def greedy_batches(df: DataFrame, group: str, order: str, size: str, most: int, most_size: int, extra: int = 100) -> DataFrame:
    """Adds batch (from 0 within the group): items in order, closed before ``most`` items or ``most_size`` are exceeded;
    an item that alone exceeds it closes its batch. Sequential within a group; rows of a group are streamed in
    sorted order, never held together."""
    schema = StructType([*df.schema.fields, StructField("batch", LongType())])
    names = df.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, n, total, fresh = None, -1, 0, 0, True
        for b in batches:
            out = []
            for g, s in zip(b[group], b[size], strict=True):
                s = 0 if pd.isna(s) else int(s)
                if g != key:
                    key, batch, n, total, fresh = g, -1, 0, 0, True
                if fresh or n >= most or total + s + extra > most_size:
                    batch, n, total, fresh = batch + 1, 0, 0, False
                n += 1
                total += s + extra
                fresh = s > most_size
                out.append(batch)
            yield b[names].assign(batch=out)

    return df.repartition(group).sortWithinPartitions(group, order).mapInPandas(fold, schema)


def weighted_order(df: DataFrame, weight: Column, seed: int, key: Column | None = None) -> DataFrame:
    """Adds draw: sorted downwards it is a random order without replacement in which heavier rows come earlier (u^(1/w)).
    With a key the draw depends on it and the seed only, not on how rows are spread."""
    u = F.rand(seed) if key is None else (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2**31 - 1)) + 0.5) / (2**31 - 1)
    return df.withColumn("draw", F.pow(u, 1 / F.when(weight > 0, weight).otherwise(0.001)))


def generation_weights(df: DataFrame, generation: str) -> DataFrame:
    """generation, n, weight, share: the first generation counts as half of all, the others once each."""
    by = df.groupBy(F.col(generation).alias("generation")).agg(F.count("*").alias("n"))
    total = by.agg(F.count("*").alias("__g"))
    w = F.when(F.col("generation") == 0, F.greatest(F.lit(2), F.floor(F.col("__g") / 2) + 1)).otherwise(1)
    weighted = by.crossJoin(F.broadcast(total)).withColumn("weight", w.cast("bigint")).drop("__g")  # one row
    s = weighted.agg(F.sum("weight").alias("__s"))
    return weighted.crossJoin(F.broadcast(s)).withColumn("share", F.col("weight") / F.col("__s")).drop("__s")  # one row


def letters(index: Column) -> Column:
    """a … z, aa, ab … of an index from 0 (up to four letters)."""
    out = F.lit("")
    rest = index.cast("bigint")
    for _ in range(4):
        out = F.when(rest >= 0, F.concat(F.char(97 + F.pmod(rest, F.lit(26))), out)).otherwise(out)
        rest = F.when(rest >= 0, F.floor(rest / 26) - 1).otherwise(-1)
    return out


def lettered_names(df: DataFrame, base: str, *order: str) -> DataFrame:
    """Adds name: the base, with _a, _b … if it occurs more than once."""
    n = F.count("*").over(W.partitionBy(base))
    r = F.row_number().over(W.partitionBy(base).orderBy(*order)) - 1
    return df.withColumn("name", F.when(n > 1, F.concat(F.col(base), F.lit("_"), letters(r))).otherwise(F.col(base)))


def numbered_names(df: DataFrame, base: str, scope: str, *order: str) -> DataFrame:
    """Adds name: the base, with _1, _2 … before its extension from the second on, without letter case."""
    r = F.row_number().over(W.partitionBy(scope, F.lower(base)).orderBy(*order)) - 1
    stem, ext = F.regexp_extract(base, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(base, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn("name", F.when(r > 0, F.concat(stem, F.lit("_"), r.cast("string"), ext)).otherwise(F.col(base)))


def file_priority(name: Column) -> Column:
    """Order of source files: tests and reproducers first."""
    x = F.lower(name)
    return F.when(x.contains("test") | x.contains("repro") | x.contains("main"), 10).otherwise(0) + F.when(x.isin("test.java", "main.java"), 10).otherwise(0)


def patch_penalty(name: Column) -> Column:
    """Order of patches: backports last."""
    x = F.lower(name)
    return F.when(x.contains("backport"), 20).otherwise(0) + F.when(x.rlike(r"(?:jdk|java)[-_]?(?:8u|11u|17u|21u)"), 10).otherwise(0)


def path_score(path: Column, terms: tuple[str, ...] = ()) -> Column:
    """Value of a changed file by its path."""
    x = F.lower(path)
    out = F.when(x.rlike(r"\.(?:cpp|hpp|c|h|cc|java)$"), 5).otherwise(0) - F.when(x.contains("/test/") | x.contains("/tests/") | x.contains("docs/") | x.contains("doc/"), 5).otherwise(0)
    for t in terms:
        out = out + F.when(x.contains(t.lower()), 12).otherwise(0)
    return out


def diff_lines(patches: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, t, section (0 before the first file), hunk (0 before the first of the section) of every line of a diff."""
    lines = patches.select(key, F.posexplode(F.split(text, r"\r?\n", -1)).alias("line", "t"))
    w = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.count_if(F.col("t").startswith("diff --git ")).over(w))
    v = W.partitionBy(key, "section").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("hunk", F.count_if(F.col("t").startswith("@@")).over(v))


def is_change(line: Column) -> Column:
    """An added or removed line, not the head of a file."""
    return (line.startswith("+") & ~line.startswith("+++")) | (line.startswith("-") & ~line.startswith("---"))


def hunk_score(header: Column, line: Column, terms: tuple[str, ...]) -> list[Column]:
    """For each term the points a line earns its hunk: 15 if it is in the header, 10 if in the line. A hunk gets the most
    of its lines for each term, and one for each changed line up to 20."""
    return [F.when(F.lower(header).contains(t.lower()), 15).when(F.lower(line).contains(t.lower()), 10).otherwise(0) for t in terms]


def diff_hunks(patches: DataFrame, key: str, text: str, terms: tuple[str, ...] = ()) -> DataFrame:
    """key, section, path, hunk, header, changed, score for each hunk of each file of a diff."""
    lines = diff_lines(patches, key, text)
    named = F.coalesce(F.nullif(F.regexp_extract("t", r"^\+\+\+ b/(.+?)\s*$", 1), F.lit("")), F.nullif(F.regexp_extract("t", r"^diff --git a/.+? b/(.+)$", 1), F.lit("")))
    paths = lines.filter("hunk = 0").groupBy(key, "section").agg(F.max_by(named, F.when(named.isNotNull(), F.col("line"))).alias("path"))
    in_hunk = W.partitionBy(key, "section", "hunk").orderBy("line")
    body = lines.filter("hunk > 0").withColumns({"header": F.first("t").over(in_hunk), "change": is_change(F.col("t"))})
    earned = [F.max(F.when(F.col("change") | F.col("t").startswith("@@"), s).otherwise(0)) for s in hunk_score(F.col("header"), F.col("t"), terms)]
    hunks = body.groupBy(key, "section", "hunk").agg(F.first("header").alias("header"), F.count_if("change").alias("changed"), sum(earned, F.least(F.count_if("change"), F.lit(20))).alias("score"))
    return hunks.join(paths, [key, "section"], "left").select(key, "section", F.coalesce("path", F.lit("unknown")).alias("path"), "hunk", "header", "changed", "score")


def fix_order(title: Column) -> tuple[Column, Column]:
    """Sort keys of fixing commits: those of the main line first, then by title."""
    t = F.coalesce(title, F.lit(""))
    return F.when(F.lower(t).contains("master"), 0).otherwise(1), t


def applicable_draws(draws: DataFrame, group: str, draw: str, applies: str, order: str) -> DataFrame:
    """group and the row of its greatest draw that applies: operators are tried in the order of their draws until one does."""
    rest = [c for c in draws.columns if c not in (group, applies)]
    return draws.filter(applies).groupBy(group).agg(F.max_by(F.struct(*rest), F.struct(draw, order)).alias("__r")).select(group, "__r.*")


def rolled_order(file: Column) -> Column:
    """Order of rolled logs: the highest index first, the live file last."""
    return -F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(file, r"\.(\d+)$", 1), F.lit("")), F.lit("9999999999")), F.lit(0))
