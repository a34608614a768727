"""Predicates, ordered rule tables and closed-set validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Exit codes of recorded runs.
TIMEOUT, NOT_STARTED = -124, -999
INTERRUPTED = (130, 143, 137, -1073741510)
CRASHES = (134, 139, 136, 6, 11)
# Names dropped from, and merged within, issue maps.
DROPPED_ISSUES = ("ExceptionInInitializerError", "ensureError", "recordInitializationFailure", "ImportError")
SAME_ISSUES = {"newNoSuchMethodException": "NoSuchMethodException", "NoClassDefFoundError": "ClassNotFoundException", "JvmOutput-TIMEOUT": "StackOverflowError"}
# Rules on source text, in order: name, reason, pattern.
STATIC_RULES = (
    ("time-api", "STATIC_TIME", r"\b(Date|Calendar|DateFormat|SimpleDateFormat|TimeZone|LocalDate|LocalTime|LocalDateTime|ZonedDateTime|Instant|nanoTime|currentTimeMillis)\b"),
    ("external-java-process", "STATIC_SYSTEM", r"\bProcessBuilder\s*\(\s*\"java\"|\bRuntime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec\s*\(\s*\"java\""),
    (
        "thread-api",
        "STATIC_THREAD",
        r"\b(Thread|Runnable|Callable|ExecutorService|ThreadPoolExecutor|ScheduledExecutorService|ForkJoinPool|ForkJoinTask|CountDownLatch|CyclicBarrier|Semaphore|Phaser|Exchanger|Future|CompletableFuture|BlockingQueue|ConcurrentHashMap|ConcurrentLinkedQueue|CopyOnWriteArrayList|LockSupport|ReentrantLock|ReadWriteLock|StampedLock|Condition|ProcessBuilder|Currency)\b|java\.util\.concurrent\.|\bRuntime\s*\.\s*getRuntime\s*\(",
    ),
    ("random-api", "STATIC_SYSTEM", r"(?i)\b(?:Random|ThreadLocalRandom|SplittableRandom)\b|\bMath\s*\.\s*random\s*\("),
    ("properties-usage", "STATIC_SYSTEM", r"\b(?:System|Properties)\s*\.\s*(?:getProperty|setProperty)\s*\(|\bjava\.util\.Properties\b"),
    ("java-compiler-api", "STATIC_SYSTEM", r"\bjavax\.tools\.JavaCompiler\b|\bToolProvider\s*\.\s*getSystemJavaCompiler\s*\(|\bcompiler\.lib\."),
    ("unsafe-api", "STATIC_SYSTEM", r"\b(?:sun\.misc\.|jdk\.internal\.misc\.)?Unsafe\b|\bUnsafe\s*\.\s*getUnsafe\s*\(|\btheUnsafe\b"),
    (
        "unsupported-lib",
        "STATIC_SYSTEM",
        r"\b(?:import\s+)?(?:javafx\.|com\.sun\.|sun\.|jdk\.internal\.|jdk\.nashorn\.|java\.lang\.foreign\.|javax\.|java\.net\.|java\.rmi\.|java\.security\.|java\.io\.|java\.awt\.|java\.nio\.|java\.text\.|java\.sql\.|org\.|java\.util\.Locale|MethodHandleProxies\b)",
    ),
)


#: Texts of which every match of a rule holds at least one.
NEEDED = {
    "external-java-process": ("ProcessBuilder", "getRuntime"),
    "properties-usage": ("Property", "java.util.Properties"),
    "java-compiler-api": ("javax.tools.JavaCompiler", "ToolProvider", "compiler.lib."),
    "unsafe-api": ("Unsafe",),
    "time-api": ("Date", "Calendar", "TimeZone", "LocalTime", "Instant", "nanoTime", "currentTimeMillis"),
    "thread-api": ("Thread", "Runnable", "Callable", "Executor", "ForkJoin", "CountDownLatch", "CyclicBarrier", "Semaphore", "Phaser", "Exchanger", "Future", "BlockingQueue", "Concurrent", "CopyOnWrite", "LockSupport", "Lock", "Condition", "ProcessBuilder", "Currency", "java.util.concurrent.", "getRuntime"),
}


def exit_status(code: Column) -> Column:
    """Status of a finished process by its exit code."""
    return (
        F.when(code == 0, "SUCCESS")
        .when(code == TIMEOUT, "TIMEOUT")
        .when(code.isin(*INTERRUPTED), "INTERRUPTED")
        .when(code == NOT_STARTED, "UNKNOWN")
        .when(code.isin(*CRASHES) | (code < 0) | ((code > 128) & (code != 255)), "CRASH")
        .when(code.isNotNull(), "FAILURE")
    )


def run_status(code: Column, crashes: Column, errors: Column, exceptions: Column) -> Column:
    """Status of a run of a program: what it printed counts before exit code 0; arrays of issue names."""
    return (
        F.when(code == TIMEOUT, "TIMEOUT")
        .when(code.isin(*INTERRUPTED), "INTERRUPTED")
        .when((F.size(crashes) > 0) | code.isin(*CRASHES) | ((code < 0) & (code != NOT_STARTED)), "CRASH")
        .when((F.size(errors) > 0) | (F.size(exceptions) > 0), "FAILURE")
        .when(code == 0, "SUCCESS")
        .otherwise("UNKNOWN")
    )


def first_rule(df: DataFrame, text: Column, rules: tuple[tuple[str, str, str], ...] = STATIC_RULES) -> DataFrame:
    """Adds rule and reason: of the first rule whose pattern is found. One CASE gives its place in the list, later patterns
    are not tried; name and reason are looked up by the place. A text is searched for a word of the pattern first where
    every match of it must hold one (``NEEDED``)."""
    place = None
    for k, (name, _, pattern) in enumerate(rules):
        hit = text.rlike(pattern)
        words = NEEDED.get(name)
        if words and rules is STATIC_RULES:
            held = text.contains(words[0])
            for w in words[1:]:
                held = held | text.contains(w)
            hit = held & hit
        place = F.when(hit, k) if place is None else place.when(hit, k)
    # A filter on the rule would be evaluated beside it, so the place goes through an array: it is computed once.
    found = df.withColumn("__place", F.explode_outer(F.array(place)))
    look_up = lambda n: F.try_element_at(F.array(*[F.lit(r[n]) for r in rules]), F.col("__place") + 1)
    return found.withColumns({"rule": look_up(0), "reason": look_up(1)}).drop("__place")


def first_rule_of_unit(files: DataFrame, unit: str, order: str, text: Column, excluded: Column) -> DataFrame:
    """unit, rule, reason: the first match over the files of a unit in their order; units without a match have nulls."""
    hit = first_rule(files.filter(~excluded), text).filter("rule IS NOT NULL")
    best = hit.groupBy(unit).agg(F.min_by(F.struct("rule", "reason"), order).alias("r"))
    return files.select(unit).distinct().join(best, unit, "left").select(unit, "r.rule", "r.reason")


def first_pattern(text: Column, patterns: list[tuple[str, str]], default: str = "Unknown") -> Column:
    """Value of the first pattern that is found (pattern, value)."""
    out = None
    for pattern, value in patterns:
        hit = text.rlike(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(default) if out is None else out.otherwise(default)


def canonical_issues(issues: DataFrame, keys: list[str], name: str = "name", count: str = "n") -> DataFrame:
    """Issue counts with unconditional drops and merges of equal names; counts that are null or not positive fall out."""
    alias = F.create_map(*[F.lit(x) for kv in SAME_ISSUES.items() for x in kv])
    kept = issues.filter(~F.col(name).isin(*DROPPED_ISSUES) & (F.col(count) > 0))
    return kept.withColumn(name, F.coalesce(F.try_element_at(alias, F.col(name)), F.col(name))).groupBy(*keys, name).agg(F.sum(count).alias(count))


def canonical_name(df: DataFrame, value: Column, taxonomy: DataFrame, aliases: DataFrame, out: str = "pass", default: str = "Unknown") -> DataFrame:
    """Adds the entry a name is equal to without letter case, directly, then by an alias; else the default.
    Both lists are dimensions; they are broadcast only while Spark's size estimate allows it."""
    exact = taxonomy.groupBy(F.lower("pass").alias("__e")).agg(F.min("pass").alias("__p"))
    other = aliases.groupBy(F.lower("alias").alias("__a")).agg(F.min("pass").alias("__q"))
    keyed = df.withColumn("__k", F.lower(F.trim(value)))
    joined = keyed.join(exact, F.col("__k") == F.col("__e"), "left").join(other, F.col("__k") == F.col("__a"), "left")
    return joined.withColumn(out, F.coalesce("__p", "__q", F.lit(default))).drop("__k", "__e", "__p", "__a", "__q")


def rules_satisfied(actual: DataFrame, expected: DataFrame, unit: str) -> DataFrame:
    """unit, rule: relational division - every expected row (rule, target, status, issues; null issues: any) of the
    rule has an equal actual row (unit, target, status, issues as sorted text)."""
    n = expected.groupBy("rule").agg(F.count("*").alias("need"))
    fits = (F.col("a.target") == F.col("e.target")) & (F.col("a.status") == F.col("e.status")) & (F.col("e.issues").isNull() | F.col("e.issues").eqNullSafe(F.col("a.issues")))
    hits = actual.alias("a").join(expected.alias("e"), fits).groupBy(f"a.{unit}", "e.rule").agg(F.count_distinct("e.target").alias("got"))
    return hits.join(n, "rule").filter("got = need").select(unit, "rule")


def first_violation(checks: list[tuple[Column, str]]) -> Column:
    """Reason of the first check that does not hold, else ok."""
    out = None
    for holds, reason in checks:
        bad = ~F.coalesce(holds, F.lit(False))
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return F.lit("ok") if out is None else out.otherwise("ok")


# Closed vocabularies of answers.
LABELS = ("Yes", "No", "Unclear")
TIERS = ("C1", "C2", "Shared", "Unknown")
BASES = ("Patch", "Issue", "Log", "Testcase", "Mixed", "Unknown")
CONFIDENCES = ("High", "Medium", "Low")
UNKNOWN_REASONS = ("N/A", "InsufficientEvidence", "NoTaxonomyMatch")


def answer_violation() -> Column:
    """First reason why an answer (columns as in analyze_results, with the canonical name in ``pass``) is invalid."""
    c = F.col
    return first_violation(
        [
            (F.trim("ID") == c("case_id"), "wrong ID"),
            (c("Type_Related").isin(*LABELS), "invalid Type_Related"),
            (c("Compiler_Tier").isin(*TIERS), "invalid Compiler_Tier"),
            (c("Faulty_Compiler_Component").isNotNull(), "Faulty_Compiler_Component must be string"),
            (c("Optimization_Mapping_Reason").isNotNull(), "Optimization_Mapping_Reason must be string"),
            (c("Optimization_Evidence_Basis").isin(*BASES), "invalid Optimization_Evidence_Basis"),
            (c("Optimization_Confidence").isin(*CONFIDENCES), "invalid Optimization_Confidence"),
            (c("Optimization_Unknown_Reason").isin(*UNKNOWN_REASONS), "invalid Optimization_Unknown_Reason"),
            (c("Primary_Faulty_Optimization").isNotNull(), "Primary_Faulty_Optimization must be string"),
            (c("Interacting_Optimizations").isNotNull(), "Interacting_Optimizations must be list"),
            (~F.exists("Interacting_Optimizations", lambda x: x.isNull()), "Interacting_Optimizations entries must be strings"),
            (c("Java_Evidence").isNotNull(), "Java_Evidence must be list"),
            (c("Patch_Evidence").isNotNull(), "Patch_Evidence must be list"),
            (~((c("pass") == "Unknown") & (c("Optimization_Unknown_Reason") == "N/A")), "Unknown primary requires Optimization_Unknown_Reason"),
            (~((c("pass") != "Unknown") & (c("Optimization_Unknown_Reason") != "N/A")), "known primary requires Optimization_Unknown_Reason=N/A"),
        ]
    )


def capped_answer(df: DataFrame) -> DataFrame:
    """Arrays and texts of an answer cut to their limits: 4 interactions, 2 evidences, 300 and 600 characters."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)
    java = F.transform(F.slice("Java_Evidence", 1, 2), lambda e: F.when(e.isNotNull(), F.struct(e["file"].alias("file"), cut(e["snippet"], 300).alias("snippet"), cut(e["why_relevant"], 600).alias("why_relevant"))))
    patch = F.transform(F.slice("Patch_Evidence", 1, 2), lambda e: F.when(e.isNotNull(), F.struct(e["file"].alias("file"), e["location_or_symbol"].alias("location_or_symbol"), cut(e["why_relevant"], 600).alias("why_relevant"))))
    return df.withColumns({"Interacting_Optimizations": F.slice("Interacting_Optimizations", 1, 4), "Java_Evidence": java, "Patch_Evidence": patch})


def rejection(verdict: Column, has_compile_results: Column, reject_timeout: bool = True) -> Column:
    """Reason to turn a validated seed down, or null. A consistent failure without compile results is accepted."""
    return (
        F.when(verdict.isNull() | (verdict == "ENVIRONMENT_ERROR"), F.when(has_compile_results, "COMPILE_FAILED").otherwise("RAW_ENVIRONMENT_ERROR"))
        .when(verdict.isin("DIFFERENCE", "DIFFERENCE_STDOUT", "CRASH"), "RAW_DIFF_FAILURE")
        .when((verdict == "MATCH_TIMEOUT") & F.lit(reject_timeout), "RAW_TIMEOUT")
        .when((verdict == "MATCH_FAILURE") & has_compile_results, "COMPILE_FAILED")
    )


#: Evidence of a named optimization, from the specific to the general.
EVIDENCE_TERMS = (
    (r"(?i)\bPhaseStringOpts\b|\bOptimizeStringConcat\b|\bStringConcat::(?:build_candidate|validate_control_flow|replace_string_concat)\b", "String Concatenation Optimization"),
    (r"(?i)\bloop_predication(?:_impl)?\b|\bloopPredicate\.cpp\b|\bloop_predication_should_follow_branches\b", "Loop Predication"),
    (r"(?i)\bloopUnswitch\.cpp\b|\bUnswitchCandidate\b|\bloop[_ ]?unswitch(?:ing)?\b", "Loop Unswitching"),
    (r"(?i)\bC1 LICM\b|\bloop-invariant code motion\b|\bloop invariant code motion\b|\bc1_ValueMap\b.*\bhoist", "Loop Invariant Code Motion"),
    (r"(?i)\bPhaseIdealLoop::(?:do_split_if|split_up|split_thru_phi)\b|\bsplit_if_with_blocks(?:_pre)?\b|\bsplit_thru_phi\b|\bIfNode::fold_compares\b", "Control Flow Optimization"),
    (r"(?i)\bPhaseVector::(?:expand_vbox_node_helper|scalarize_vbox_node)\b|\bVectorBox\b|\bscalarize_vbox\b|\bvector-box scalarization\b|\bvector box expansion\b", "Vector API Optimization"),
    (r"(?i)\bCompile::compute_(?:logic_cone|truth_table)\b|\boptimize_logic_cones\b|\bMacroLogicV?\b|\bmacro[- ]logic\b", "Macro Logic Optimization"),
    (r"(?i)\bPhaseGVN\b|\bPhaseIterGVN\b|\bIGVN\b|\bGVN/IGVN\b", "Global Value Numbering"),
)


def inferred_entry(primary: Column, reason: Column, *evidence: Column) -> Column:
    """primary, inferred, reason: an unknown entry without a match in the list is read from the evidence texts (``Unknown``
    and nulls among them do not count); then no reason is left."""
    text = F.concat_ws("\n", *[F.when(e != "Unknown", e) for e in evidence])
    found = first_pattern(text, list(EVIDENCE_TERMS))
    applies = F.coalesce((primary == "Unknown") & (reason == "NoTaxonomyMatch"), F.lit(False))
    now = F.when(applies, found).otherwise(primary)
    return F.struct(now.alias("primary"), (applies & (now != "Unknown")).alias("inferred"), F.when(now != "Unknown", "N/A").otherwise(reason).alias("reason"))


def stage_gate(verdict: Column, reason: Column, runtime: Column) -> Column:
    """Whether a case goes on to the run stage: all compilers agree on success and there is a runtime."""
    return runtime & F.coalesce((verdict == "MATCH_SUCCESS") & ~reason.eqNullSafe("COMPILER_SYMBOL_NOT_FOUND"), F.lit(False))


def valid_utf8(data: Column) -> Column:
    """Whether bytes are UTF-8: half a surrogate pair, written as if it were a character, is not."""
    return F.is_valid_utf8(data)


def is_bug(verdict: Column) -> Column:
    return verdict.isin("DIFFERENCE", "DIFFERENCE_STDOUT", "CRASH")


def is_productive(verdict: Column) -> Column:
    return verdict.isin("MATCH_SUCCESS", "DIFFERENCE", "DIFFERENCE_STDOUT", "CRASH")


def staged_decision(seeds: DataFrame, cache: DataFrame, static: DataFrame, validated: DataFrame, key: str = "seed_id") -> DataFrame:
    """key, decision, source: the cached decision, else a static reason, else that of validation, else accepted."""
    d = (
        seeds.select(key)
        .join(cache.select(key, F.col("decision").alias("__c")), key, "left")
        .join(static.select(key, F.col("reason").alias("__s")), key, "left")
        .join(validated.select(key, F.col("reason").alias("__v")), key, "left")
    )
    source = F.when(F.col("__c").isNotNull(), "cache").when(F.col("__s").isNotNull(), "static").when(F.col("__v").isNotNull(), "validation").otherwise("none")
    return d.select(key, F.coalesce("__c", "__s", "__v", F.lit("ACCEPTED")).alias("decision"), source.alias("source"))


def unfinished(candidates: DataFrame, state: DataFrame, key: str, done: tuple[str, ...] = ("saved", "no_source")) -> DataFrame:
    """Candidates whose latest state is not among the final ones."""
    return candidates.join(state.filter(F.col("status").isin(*done)).select(key), key, "left_anti")


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order; Spark keeps one candidate a key in each task before the shuffle."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def matched_responses(batch: DataFrame, responses: DataFrame, key: str = "ID", order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(answered, retry): the items of a batch with the last of their responses, and those without any."""
    others = [c for c in responses.columns if c not in (key, order)]
    last = responses.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), order).alias("response"))
    return batch.join(last, key), batch.join(last, key, "left_anti")


def uncovered(fixes: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Fixes whose keys another source does not cover already; nulls match nothing."""
    return fixes.join(covered.select(*keys).distinct(), keys, "left_anti")
