import pytest
from pyspark.sql import functions as F

from millrace.operators import compare, rules


def test_statuses(spark):
    df = spark.createDataFrame([(x,) for x in (0, -124, 130, -1073741510, -999, 134, 11, -5, 129, 255, 1, None)], "c int")
    assert [r[0] for r in df.select(rules.exit_status(df.c)).collect()] == ["SUCCESS", "TIMEOUT", "INTERRUPTED", "INTERRUPTED", "UNKNOWN", "CRASH", "CRASH", "CRASH", "CRASH", "FAILURE", "FAILURE", None]
    none, some = F.array().cast("array<string>"), F.array(F.lit("X"))
    assert [r[0] for r in df.select(rules.run_status(df.c, none, none, none)).collect()] == ["SUCCESS", "TIMEOUT", "INTERRUPTED", "INTERRUPTED", "UNKNOWN", "CRASH", "CRASH", "CRASH", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert df.filter("c = 0").select(rules.run_status(df.c, none, some, none)).head(1)[0][0] == "FAILURE"


def test_static_rules_and_units(spark):
    f = spark.createDataFrame([("u", 1, "A.java", "int x;"), ("u", 2, "B.java", "new Random(); Thread t;"), ("v", 1, "FuzzerUtils.java", "Thread"), ("w", 1, "A.java", None)], "unit string, ord int, file string, code string")
    got = {r["unit"]: (r["rule"], r["reason"]) for r in rules.first_rule_of_unit(f, "unit", "ord", f.code, f.file == "FuzzerUtils.java").collect()}
    assert got == {"u": ("thread-api", "STATIC_THREAD"), "v": (None, None), "w": (None, None)}


def test_issue_maps_and_division(spark):
    i = spark.createDataFrame([("k", "NoClassDefFoundError", 2), ("k", "ClassNotFoundException", 3), ("k", "ImportError", 9), ("k", "X", 0)], "k string, name string, n bigint")
    assert [tuple(r) for r in rules.canonical_issues(i, ["k"]).collect()] == [("k", "ClassNotFoundException", 5)]
    actual = spark.createDataFrame([("u", "a", "OK", "x"), ("u", "b", "OK", None), ("v", "a", "OK", "y")], "u string, target string, status string, issues string")
    exp = spark.createDataFrame([("r1", "a", "OK", None), ("r1", "b", "OK", None), ("r2", "a", "OK", "y")], "rule string, target string, status string, issues string")
    assert {tuple(r) for r in rules.rules_satisfied(actual, exp, "u").collect()} == {("u", "r1"), ("v", "r2")}


def test_decisions(spark):
    s = spark.createDataFrame([(k,) for k in "abcd"], "seed_id string")
    one = lambda k, col, v: spark.createDataFrame([(k, v)], f"seed_id string, {col} string")
    got = {r[0]: (r[1], r[2]) for r in rules.staged_decision(s, one("a", "decision", "R"), one("b", "reason", "S"), one("c", "reason", "V")).collect()}
    assert got == {"a": ("R", "cache"), "b": ("S", "static"), "c": ("V", "validation"), "d": ("ACCEPTED", "none")}
    v = spark.createDataFrame([("MATCH_FAILURE",), ("DIFFERENCE",), ("MATCH_TIMEOUT",), (None,)], "v string")
    assert [r[0] for r in v.select(rules.rejection(v.v, F.lit(False))).collect()] == [None, "RAW_DIFF_FAILURE", "RAW_TIMEOUT", "RAW_ENVIRONMENT_ERROR"]


C = "case_id string, pos int, id string, status string, reason string, lines array<string>"


@pytest.mark.parametrize(
    ("replicas", "verdict"),
    [
        ([("SUCCESS", "NONE", [])], "MATCH_SUCCESS"),
        ([("TIMEOUT", "NONE", [])], "MATCH_TIMEOUT"),
        ([("TIMEOUT", "NONE", []), ("TIMEOUT", "NONE", [])], "MATCH_FAILURE"),
        ([("SUCCESS", "NONE", []), ("FAILURE", "NONE", ["1"])], "DIFFERENCE"),
        ([("FAILURE", "NONE", ["1", "2"]), ("FAILURE", "NONE", ["1"]), ("FAILURE", "NONE", ["3"])], "DIFFERENCE"),
        ([("FAILURE", "NONE", ["1", "2"]), ("FAILURE", "NONE", ["1"])], "MATCH_FAILURE"),
        ([("FAILURE", "NONE", ["1"]), ("CRASH", "NONE", [])], "CRASH"),
        ([("CRASH", "NONE", []), ("INTERRUPTED", "NONE", [])], "ENVIRONMENT_ERROR"),
        ([("FAILURE", "COMPILER_SYMBOL_NOT_FOUND", ["1"])], "ENVIRONMENT_ERROR"),
    ],
)
def test_compile_verdicts(spark, replicas, verdict):
    df = spark.createDataFrame([("c", k, f"t{k}", *r) for k, r in enumerate(replicas)], C)
    assert compare.compile_verdict(df).head(1)[0]["verdict"] == verdict
    assert compare.compile_verdict(df.orderBy(F.desc("pos"))).head(1)[0]["verdict"] == verdict


R = "case_id string, pos int, id string, status string, reason string, stdout string, issues array<string>, exit_code int, compiler string, runtime string"


def run(spark, *rows):
    return compare.run_verdict(spark.createDataFrame([("c", k, f"t{k}", s, "NONE", out, iss, 1, comp, rt) for k, (s, out, iss, comp, rt) in enumerate(rows)], R)).head(1)[0]


def test_run_verdicts(spark):
    ok = lambda out, comp="ecj", rt="x": ("SUCCESS", out, [], comp, rt)
    assert run(spark, ok("a"), ok("a"))["verdict"] == "MATCH_SUCCESS"
    r = run(spark, ok("b"), ok("a", "javac-8", "HotSpot-8"), ok("a"))
    assert r["verdict"] == "DIFFERENCE_STDOUT" and r["message"].endswith("t0")
    # the last one that differs decides
    assert run(spark, ok("a", "javac", "hotspot"), ok("b"), ("FAILURE", "", ["E"], "e", "y"))["verdict"] == "DIFFERENCE"
    assert run(spark, ok("a", "javac", "hotspot"), ("FAILURE", "", ["E"], "e", "y"), ok("b"))["verdict"] == "DIFFERENCE_STDOUT"
    assert run(spark, ("FAILURE", "", ["E"], "javac", "hotspot"), ("FAILURE", "z", ["E"], "e", "y"))["verdict"] == "MATCH_FAILURE"


def test_signatures_do_not_depend_on_order(spark):
    v = spark.createDataFrame([("a", "DIFFERENCE"), ("b", "DIFFERENCE")], "case_id string, verdict string")
    rows = [("a", "t1", "FAILURE", ["X", "Y", "X"]), ("a", "t2", "SUCCESS", []), ("b", "t2", "SUCCESS", []), ("b", "t1", "FAILURE", ["Y", "X"])]
    df = spark.createDataFrame(rows, "case_id string, id string, status string, names array<string>")
    d = compare.distinct_behaviours(compare.signatures(df, v, scoped=False)).collect()
    assert [(r["case_id"], r["cases"]) for r in d] == [("a", 2)] and compare.signatures(df, v).select("signature").distinct().count() == 2


def test_first_difference(spark):
    df = spark.createDataFrame([("c", "x", "a\nb\nc"), ("c", "y", "a\nb"), ("d", "x", "a"), ("d", "y", "a")], "case_id string, id string, stdout string")
    r = compare.first_difference(df).collect()
    assert len(r) == 1 and r[0]["line"] == 2 and [v["content"] for v in r[0]["variants"]] == ["c", "<END_OF_OUTPUT>"]


def test_responses(spark):
    b = spark.createDataFrame([("a",), ("b",)], "ID string")
    r = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), (None, 3, "x"), ("z", 4, "y")], "ID string, pos int, v string")
    done, retry = rules.matched_responses(b, r)
    assert [(x["ID"], x["response"]["v"]) for x in done.collect()] == [("a", "new")] and [x["ID"] for x in retry.collect()] == ["b"]
    assert [x["ID"] for x in rules.uncovered(b, r, ["ID"]).collect()] == ["b"]
