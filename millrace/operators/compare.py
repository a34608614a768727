"""Comparison of replicated runs of one case: verdicts, signatures, first differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def replicas(df: DataFrame, case: str, order: str, *fields: str) -> DataFrame:
    """One row for each case with its replicas (a bounded number of targets) as an array in order."""
    return df.groupBy(case).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("rs"))


def _ids(rs: Column, keep) -> Column:
    return F.array_join(F.transform(F.filter(rs, keep), lambda r: r["id"]), ", ")


def compile_verdict(df: DataFrame, case: str = "case_id", ignore_timeouts: bool = False) -> DataFrame:
    """case, verdict, message. Input: case, pos, id, status, reason, lines (sorted array of fingerprint keys).

    In order: any interrupted; all without a class; any crash; a time-out (single or ignored); both success
    and failure; of two or more replicas, failures whose lines and those of the first are no subsets of each
    other; else a match, a success if any succeeded.
    """
    c = replicas(df, case, "pos", "id", "status", "reason", "lines")
    rs = F.col("rs")
    has = lambda s: F.exists(rs, lambda r: r["status"] == s)
    failed = F.filter(rs, lambda r: r["status"] == "FAILURE")
    first = F.get(failed, F.lit(0))["lines"]
    apart = lambda r: (F.size(F.array_except(first, r["lines"])) > 0) & (F.size(F.array_except(r["lines"], first)) > 0)
    match = F.when(has("SUCCESS"), "MATCH_SUCCESS").otherwise("MATCH_FAILURE")
    single = F.size(rs) == 1
    pick = (
        (has("INTERRUPTED"), F.lit("ENVIRONMENT_ERROR"), F.concat(F.lit("interrupted: "), _ids(rs, lambda r: r["status"] == "INTERRUPTED"))),
        (F.forall(rs, lambda r: r["reason"] == "COMPILER_SYMBOL_NOT_FOUND"), F.lit("ENVIRONMENT_ERROR"), F.lit("missing class dependency")),
        (has("CRASH"), F.lit("CRASH"), F.concat(F.lit("Compiler crash detected in: "), _ids(rs, lambda r: r["status"] == "CRASH"))),
        (has("TIMEOUT") & (single | F.lit(ignore_timeouts)), F.lit("MATCH_TIMEOUT"), F.lit("Compiler timeout")),
        (has("SUCCESS") & has("FAILURE"), F.lit("DIFFERENCE"), F.lit("Compiler results differ: success and failure")),
        (~single & F.exists(failed, apart), F.lit("DIFFERENCE"), F.lit("Compiler results differ: failing lines")),
        (F.lit(True), match, F.concat(F.when(single, "Compile-only result: ").otherwise("Consistent Compiler Behavior: "), match)),
    )
    return _picked(c, case, pick)


def _picked(c: DataFrame, case: str, pick: tuple) -> DataFrame:
    verdict = message = None
    for when, v, m in pick:
        verdict = F.when(when, v) if verdict is None else verdict.when(when, v)
        message = F.when(when, m) if message is None else message.when(when, m)
    return c.select(case, verdict.alias("verdict"), message.alias("message"))


def ground_truth(rs: Column) -> Column:
    """Of the replicas in order: the first of the reference compiler on the reference runtime, else of that compiler, else the first."""
    javac = lambda r: F.coalesce(F.lower(r["compiler"]).contains("javac"), F.lit(False))
    both = F.filter(rs, lambda r: javac(r) & F.coalesce(F.lower(r["runtime"]).contains("hotspot"), F.lit(False)))
    return F.coalesce(F.get(both, F.lit(0)), F.get(F.filter(rs, javac), F.lit(0)), F.get(rs, F.lit(0)))


def equivalent(a: Column, b: Column) -> Column:
    """Whether two replicas behave alike: by output, issues or exit code, as their common status asks; issues as sorted entries."""
    return (a["status"] == b["status"]) & (
        F.when(a["status"] == "SUCCESS", a["stdout"].eqNullSafe(b["stdout"]))
        .when(a["status"] == "FAILURE", a["issues"].eqNullSafe(b["issues"]))
        .when(a["status"] == "UNKNOWN", a["exit_code"] == b["exit_code"])
        .when(a["status"] == "CRASH", a["issues"].eqNullSafe(b["issues"]) & (a["exit_code"] == b["exit_code"]))
        .otherwise(True)
    )


def run_verdict(df: DataFrame, case: str = "case_id", ignore_timeouts: bool = False) -> DataFrame:
    """case, verdict, message. Input: case, pos, id, status, reason, stdout, issues, exit_code, compiler, runtime.

    As ``compile_verdict`` up to time-outs; then every replica against the ground truth: the verdict is that
    of the last one that differs.
    """
    c = replicas(df, case, "pos", "id", "status", "reason", "stdout", "issues", "exit_code", "compiler", "runtime").withColumn("gt", ground_truth(F.col("rs")))
    rs, gt = F.col("rs"), F.col("gt")
    has = lambda s: F.exists(rs, lambda r: r["status"] == s)
    single = F.size(rs) == 1
    differing = F.filter(rs, lambda r: (r["pos"] != gt["pos"]) & ~equivalent(gt, r))
    last = F.element_at(differing, -1)
    kind = F.when((gt["status"] == "SUCCESS") & (last["status"] == "SUCCESS"), "DIFFERENCE_STDOUT").otherwise("DIFFERENCE")
    match = F.when(gt["status"] == "SUCCESS", "MATCH_SUCCESS").otherwise("MATCH_FAILURE")
    pick = (
        (has("INTERRUPTED"), F.lit("ENVIRONMENT_ERROR"), F.concat(F.lit("interrupted: "), _ids(rs, lambda r: r["status"] == "INTERRUPTED"))),
        (F.forall(rs, lambda r: r["reason"] == "MAIN_CLASS_NOT_FOUND"), F.lit("ENVIRONMENT_ERROR"), F.lit("main class not found")),
        (has("CRASH"), F.lit("CRASH"), F.concat(F.lit("Run crashed in: "), _ids(rs, lambda r: r["status"] == "CRASH"))),
        (has("TIMEOUT") & (single | F.lit(ignore_timeouts)), F.lit("MATCH_TIMEOUT"), F.lit("Run timeout")),
        (~single & (F.size(differing) > 0), kind, F.concat(F.lit("differs from "), gt["id"], F.lit(": "), F.array_join(F.transform(differing, lambda r: r["id"]), ", "))),
        (F.lit(True), match, F.concat(F.when(single, "Run-only result: ").otherwise("Consistent with "), F.when(single, match).otherwise(gt["id"]))),
    )
    return _picked(c, case, pick)


def signatures(df: DataFrame, verdicts: DataFrame, case: str = "case_id", scoped: bool = True) -> DataFrame:
    """case, signature: verdict, and for each replica by id its status and the names (not counts) of its issues."""
    part = F.transform(F.array_sort(F.collect_list(F.struct("id", "status", "names"))), lambda r: F.concat(r["id"], F.lit("["), r["status"], F.lit(":"), F.array_join(F.array_sort(F.array_distinct(r["names"])), ","), F.lit("]")))
    sig = df.groupBy(case).agg(F.array_join(part, "|").alias("s")).join(verdicts.select(case, "verdict"), case)
    text = F.concat_ws("|", "verdict", "s")
    return sig.select(case, (F.concat(F.col(case), F.lit("::"), text) if scoped else text).alias("signature"))


def distinct_behaviours(sigs: DataFrame, order: str = "case_id") -> DataFrame:
    """The first case of each signature, with the number of cases that share it."""
    return sigs.groupBy("signature").agg(F.min(order).alias(order), F.count("*").alias("cases"))


def first_difference(outputs: DataFrame, case: str = "case_id", id_col: str = "id", text: str = "stdout", around: int = 2) -> DataFrame:
    """case, line (from 0), variants: the first line at which the outputs of a case differ; one that ended is
    ``<END_OF_OUTPUT>``. A variant has its id, the line, and the lines around it. Null outputs are left out."""
    outputs = outputs.filter(F.col(text).isNotNull())
    # A case whose outputs are all equal ends here. For the others the hashes of their lines are compared, not the lines:
    # least and greatest hash and a count for each place are combined before the shuffle. An id counts once.
    digest = F.sha2(text, 256)
    same = outputs.groupBy(case).agg(F.min(digest).alias("__a"), F.max(digest).alias("__b")).filter("__a <> __b").select(case)
    open_ = outputs.join(same, case, "left_semi").dropDuplicates([case, id_col, text])
    lines = open_.select(case, F.posexplode(F.transform(F.split(text, r"\R"), lambda x: F.xxhash64(x))).alias("line", "h"))
    n = open_.groupBy(case).agg(F.count("*").alias("ids"))
    by = lines.groupBy(case, "line").agg(F.count("*").alias("have"), F.min("h").alias("least"), F.max("h").alias("most")).join(n, case)
    first = by.filter("least <> most OR have < ids").groupBy(case).agg(F.min("line").alias("line"))
    wide = first.join(outputs.select(case, id_col, F.split(text, r"\R").alias("ls")), case)
    shown = F.coalesce(F.get("ls", F.col("line")), F.lit("<END_OF_OUTPUT>"))
    return wide.groupBy(case, "line").agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), shown.alias("content"), F.slice("ls", F.greatest(F.col("line") + 1 - around, F.lit(1)), F.lit(2 * around + 1)).alias("around")))).alias("variants"))


def planned(executions: DataFrame, plans: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Each execution with the first of the plans of its id; executions without a plan fall out."""
    others = [c for c in plans.columns if c not in (key, order)]
    first = plans.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), order).alias("plan"))
    return executions.join(first, key).select(*executions.columns, "plan.*")


def against_first(df: DataFrame, case: str, order: str, value: str) -> DataFrame:
    """Adds same: whether the value is that of the first replica of its case."""
    w = W.partitionBy(case).orderBy(order)
    return df.withColumn("same", F.col(value).eqNullSafe(F.first(value).over(w)))
