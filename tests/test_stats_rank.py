import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from millrace.operators import dedup, graph, rank, stats, timeline


def test_distribution_and_prevalence(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate("bbaac")], "seq int, v string")
    got = [(r["value"], r["count"], r["percent"]) for r in stats.distribution(df, df.v, "seq").orderBy(F.desc("count"), "first_seen").collect()]
    assert got == [("b", 2, 40.0), ("a", 2, 40.0), ("c", 1, 20.0)]
    assert stats.distribution(df.limit(0), df.v, "seq").count() == 0
    feats = spark.createDataFrame([(0, "if", True), (1, "loop", True), (2, "x", False)], "ord int, feature string, reported boolean")
    occ = spark.createDataFrame([("a", 1, "if"), ("a", 2, "if"), ("b", 1, "x"), ("skipped", 1, "loop")], "case_id string, seq int, feature string")
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    assert {r["feature"]: (r["cases"], r["share"]) for r in stats.prevalence(feats, cases, occ).collect()} == {"if": (1, "33.33%"), "loop": (0, "0.00%")}


def test_percentiles_give_bounds(spark):
    df = spark.createDataFrame([("m", 3), ("m", 3), ("m", 3), ("n", 500_000), ("n", -7)], "metric string, ms bigint")
    r = {x["metric"]: x for x in stats.histogram_percentiles(stats.histogram(df, ["metric"], df.ms), ["metric"]).collect()}
    assert r["m"]["p50"] == 5 and r["n"]["p99"] == 500_000 and r["n"]["p50"] == 1 and r["n"]["least"] == 0


def test_accounting(spark):
    df = spark.createDataFrame([(1, "MATCH_FAILURE", "Compile-only result"), (2, "MATCH_FAILURE", "Consistent Compiler Behavior"), (3, None, None), (4, "CRASH", ""), (5, "MATCH_SUCCESS", "")], "run_id int, v string, m string")
    out = stats.routed(df.v, F.lit("NONE"), df.m, F.lit(False), df.run_id == 99)
    r = stats.accounting(df, [], out, F.count("*") + 2).head(1)[0]
    assert (r["discarded"], r["fail_compiled"], r["internal"], r["bug"], r["valid"], r["accounted"], r["unaccounted"]) == (1, 1, 1, 1, 1, 5, 2)


def test_batches_and_shares_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.choice([10, 50, 400, 1200])) for g in "ab" for k in range(60)]
    want = {}
    for g in "ab":
        batch, n, total, fresh = -1, 0, 0, True
        for _, k, s in sorted(r for r in rows if r[0] == g):
            if fresh or n >= 4 or total + s + 100 > 1000:
                batch, n, total, fresh = batch + 1, 0, 0, False
            n, total, fresh = n + 1, total + s + 100, s > 1000
            want[g, k] = batch
    df = spark.createDataFrame(rows, "g string, k int, s int")
    assert {(r["g"], r["k"]): r["batch"] for r in rank.greedy_batches(df, "g", "k", "s", 4, 1000).collect()} == want
    shares = spark.range(1).select(rank.budget_shares(F.array(*[F.lit(x).cast("bigint") for x in (5000, 100, 5000, 900)]), 4000)).head(1)[0][0]
    left, out = 4000, []
    for k, s in enumerate((5000, 100, 5000, 900)):
        u = min(s, max(600, min(3000, left // (4 - k))), left)
        out.append(u)
        left -= u
    assert shares == out


def test_names(spark):
    df = spark.createDataFrame([(k, "x") for k in range(800)] + [(900, "y")], "k int, base string")
    names = {r["k"]: r["name"] for r in rank.lettered_names(df, "base", "k").collect()}
    assert (names[0], names[25], names[26], names[701], names[702], names[900]) == ("x_a", "x_z", "x_aa", "x_zz", "x_aaa", "y") and len(set(names.values())) == 801
    n = spark.createDataFrame([(1, "c", "A.java"), (2, "c", "a.java"), (3, "c", "b"), (4, "c", "B")], "k int, c string, f string")
    assert [r["name"] for r in rank.numbered_names(n, "f", "c", "k").orderBy("k").collect()] == ["A.java", "a_1.java", "b", "B_1"]


def test_comments(spark):
    bodies = ["first", "nothing here that is long enough to be worth a look at", "root cause: crash ``` at a.B.c(D.java:1) https://github.com/x deadbeef1", None, "regression fixed by patch, and a lot more text than forty characters", "last"]
    df = spark.createDataFrame([("c", k, b, k) for k, b in enumerate(bodies)], "case_id string, idx int, body string, seq int")
    got = sorted((r["position"], r["score"]) for r in rank.top_comments(df, "case_id", "idx", "body", 1, "seq").collect())
    assert [p for p, _ in got] == [0, 2, 5] and dict(got)[0] == 4 and dict(got)[2] == 6 + 4 + 4 + 3 + 2


def test_weighted_order_prefers_weight_and_repeats(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 9.0).otherwise(1.0).alias("w"))
    a = rank.weighted_order(df, df.w, 3, df.id).orderBy(F.desc("draw")).limit(1000)
    assert a.filter("id % 2 = 0").count() > 750
    assert a.collect() == rank.weighted_order(df.repartition(7), df.w, 3, df.id).orderBy(F.desc("draw")).limit(1000).collect()


def test_hunks(spark):
    d = "diff --git a/x.cpp b/y.cpp\n--- a/x.cpp\n+++ b/y.cpp\n@@ -1 +1 @@ fn\n-a\n+b\n c\n@@ -9 +9 @@\n+igvn\ndiff --git a/docs/r b/docs/r\nrename from r\n"
    df = spark.createDataFrame([("p", d), ("q", "--- a\n+++ b/z.c\n@@ x\n+1\n"), ("r", None), ("s", "")], "k string, t string")
    got = sorted((r["k"], r["path"], r["hunk"], r["changed"], r["score"]) for r in rank.diff_hunks(df, "k", "t", ("IGVN",)).collect())
    assert got == [("p", "y.cpp", 1, 2, 2), ("p", "y.cpp", 2, 1, 11), ("q", "z.c", 1, 1, 1)]


def test_dedup(spark):
    df = spark.createDataFrame([(1, "i", "a b"), (2, "i", "ab"), (3, "j", "a\nb"), (4, "j", None)], "k int, o string, t string")
    assert {r["k"] for r in dedup.first_of_content(df, "t", "k").collect()} == {1, 4}
    assert [(r["owners"], r["copies"]) for r in dedup.shared_contents(df, "t", "o").collect()] == [(2, 3)]
    assert [(r["k"], r["first_owner"]) for r in dedup.prior_occurrences(df, "t", "o", "k").collect()] == [(3, "i")]


def test_components_and_paths(spark):
    rng = random.Random(2)
    e = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500, 500), (None, 3)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in e:
        if a is not None:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    df = spark.createDataFrame(e, "src bigint, dst bigint")
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == {n: find(n) for n in par}
    assert graph.components(df.limit(0)).count() == 0
    line = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (3, 4)], "src bigint, dst bigint")
    got = {(r["origin"], r["node"]): (r["depth"], r["path"]) for r in graph.path_of(graph.bounded_paths(spark.createDataFrame([(1,)], "node bigint"), line, 2), 2).collect()}
    assert got == {(1, 1): (0, [1]), (1, 2): (1, [1, 2]), (1, 3): (1, [1, 3]), (1, 4): (2, [1, 3, 4])}
    assert {tuple(r) for r in graph.closure(line.filter("src <> 3 OR dst <> 1")).collect()} == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}


def test_reference_edges_and_hierarchy(spark):
    f = spark.createDataFrame([("u", "A.java", "class A { B b; }", ["A"]), ("u", "B.java", "class B { Bx c; }", ["B"]), ("v", "B.java", "A", ["B"])], "unit string, file string, code string, types array<string>")
    assert [tuple(r) for r in graph.reference_edges(f, "unit", "file", "code", "types").collect()] == [("u", "A.java", "B.java")]
    h = spark.createDataFrame([("c", "B", "CLASS", "A", "CLASS"), ("c", "B", "CLASS", "I", "INTERFACE"), ("c", "B", "CLASS", "A", "CLASS"), ("c", "X", "ENUM", "J", "INTERFACE")], "case_id string, src string, src_type string, dst string, dst_type string")
    assert sorted(r["pattern"] for r in graph.hierarchy_pattern(h).collect()) == ["C0->C1, C0->I0", "E0->I0"]


def test_windows(spark):
    d = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 10))], "a date, b date")
    assert [(r["from_day"].day, r["to_day"].day) for r in timeline.date_windows(d, "a", "b", 4).collect()] == [(1, 4), (5, 8), (9, 10)]
    daily = spark.createDataFrame([(date(2024, 1, 1) + timedelta(k), 5000 if k == 3 else 100) for k in range(20)], "day date, n bigint")
    w = timeline.split_windows(daily, "2024-01-01", "2024-01-20", 900).collect()
    assert sum(r["n"] for r in w) == 19 * 100 + 5000 and [r["from_day"].day for r in w if r["over_limit"]] == [4] and all(r["n"] <= 900 or r["over_limit"] for r in w)
    t0 = datetime(2024, 1, 1)
    s = spark.createDataFrame([(t0 + timedelta(seconds=k), True, -1.0 if k else 0.5, 10 * k) for k in range(10)] + [(t0 + timedelta(minutes=3), True, 0.5, 1)], "ts timestamp, productive boolean, cpu double, wait_ms bigint")
    r = timeline.window_statistics(s, "ts").collect()
    assert len(r) == 1 and r[0]["completed"] == 10 and r[0]["cpu"] == 0.5 and r[0]["wait_ms"] == 45
    st = spark.createDataFrame([("p", t0 + timedelta(minutes=k), x, c, w) for k, (x, c, w) in enumerate([(1.0, 0.5, 10), (2.0, 0.5, 10), (2.0, 0.96, 10), (2.0, 0.5, 10), (2.0, 0.5, 10), (2.0, 0.5, 10), (9.0, 0.5, 10)])], "pool string, start timestamp, throughput double, cpu double, wait_ms bigint")
    assert [(x["workers"], x["reason"]) for x in timeline.worker_plan(st, "pool", 4).orderBy("start").collect()] == [(1, "first"), (2, "raise"), (1, "lower"), (1, "stable"), (1, "stable"), (1, "stable"), (1, "settled")]


def test_state(spark):
    a = spark.createDataFrame([("k", 1, 1), ("l", 5, 2)], "k string, u int, s int")
    b = spark.createDataFrame([("k", 3, 3), ("l", 5, 9), ("m", None, 4)], "k string, u int, s int")
    assert {r["k"]: r["s"] for r in timeline.upserted(a, b, "k", "u", "s").collect()} == {"k": 3, "l": 9, "m": 4}
    d = spark.range(1).select(timeline.decoded_decision(timeline.encoded_decision(F.lit(False), F.lit("R1"), F.lit("a|b"), F.lit(None).cast("string"))).alias("d")).head(1)[0]["d"]
    assert tuple(d) == (False, "R1", "a|b", "")


def test_crosstab_and_lines(spark):
    a = spark.createDataFrame([("c", "f"), ("c", "f"), ("d", "f")], "case_id string, f string")
    b = spark.createDataFrame([("c", "p"), ("d", "q"), ("c", "q")], "case_id string, p string")
    assert {tuple(r) for r in stats.crosstab(a, b, "case_id", "f", "p").collect()} == {("f", "p", 1), ("f", "q", 2)}
    occ = spark.createDataFrame([("c", k, "f", (7 * k) % 12) for k in range(24)], "case_id string, seq int, feature string, line int")
    assert stats.feature_lines(occ, most=3).head(1)[0]["lines"] == "0,1,2"


def test_paths_with_a_budget(spark):
    """Unknown nodes cost one; known ones are followed whatever is left."""
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "d"), ("d", "e")], "src string, dst string")
    start, cost = spark.createDataFrame([("r",)], "node string"), spark.createDataFrame([("r", 0), ("b", 0)], "node string, cost int")
    got = {r["node"]: r["followed"] for r in graph.bounded_paths(start, edges, 4, expand=cost, budget=0).collect()}
    assert got == {"r": True, "a": False, "b": True, "d": False}
    every = {r["node"]: (r["depth"], r["path"]) for r in graph.path_of(graph.bounded_paths(start, edges, 4), 4).collect()}
    assert every["e"] == (3, ["r", "b", "d", "e"]) and every["c"] == (2, ["r", "a", "c"]) and len(every) == 6
    assert graph.bounded_paths(start.limit(0), edges, 2).count() == 0


def test_first_difference_of_repeated_and_null_outputs(spark):
    from millrace.operators import compare

    df = spark.createDataFrame([("a", 1, "x\ny"), ("a", 1, "x\ny"), ("a", 2, "x\nz"), ("b", 1, None), ("b", 2, "q"), ("c", 1, "s"), ("c", 2, "s")], "case_id string, id int, stdout string")
    assert [(r["case_id"], r["line"]) for r in compare.first_difference(df).collect()] == [("a", 1)]
