import random
import re

from pyspark.sql import functions as F

from millrace.functions import evidence, extract, features

CODE = """public class A<T extends Comparable<T>> extends Base implements I, J<String> {
    // if (x) { for (;;) }
    static int f(Object o) {
        for (int i = 0; i < 50; i++) {
            for (long j = 9; j >= 0; j -= 3) { if (o instanceof String) f("switch ("); }
        }
        do { i--; } while (i > 0);
        int[] a = new int[3]; Runnable r = () -> { }; Integer b = Integer.valueOf((int) 3L);
        return a[0] << 2;
    }
    interface K { } abstract static class Q { }
}
"""


def test_occurrences():
    rows = features.occurrences(CODE)
    by = {}
    for f, line, d in rows:
        by.setdefault(f, []).append((line, d))
    assert [d for _, d in by["loop"]] == ["Depth: 1, Count: [11, 100]", "Depth: 2, Count: [0, 10]", "Depth: 1, Count: Unknown"]
    assert by["ifStmt"] == [(5, None)] and "switchStmt" not in by and [d for _, d in by["hierarchy"]] == ["A->Base", "A->I", "A->J"]
    for f in ("lambda", "instanceofOperator", "arrayAccess", "arrayType", "shiftOperator", "TypeCast", "primitiveConversion", "boxingUnboxing", "wrapperType", "nestedType", "interfaceType", "abstractType", "genericType", "boundedTypeParameter", "parameterizedType"):
        assert f in by, f
    assert set(by) <= set(features.FEATURES) and set(features.REPORTED) <= set(features.FEATURES)


def test_trip_counts():
    cases = {(0, "<", 10, 1): "[0, 10]", (0, "<=", 10, 1): "[11, 100]", (0, "<", 10, -1): "[0, 10]", (100, ">", 0, -1): "[11, 100]", (0, "!=", 9, 2): "Unknown", (0, "<", 20000, 1): "[10000, inf)", (5, "<", 5, 1): "[0, 10]"}
    for k, want in cases.items():
        assert features.trip_bucket(*k) == want


def test_rows(spark):
    df = spark.createDataFrame([("a", CODE), ("b", None), ("c", "")], "case_id string, code string")
    got = features.feature_rows(df, "case_id", "code")
    assert {r["case_id"] for r in got.collect()} == {"a"} and got.filter("NOT approximate").count() == 0
    assert features.feature_rows(df.limit(0), "case_id", "code").count() == 0


def _kept_by_trial(text, budget):
    """The same rule by rendering every proposal from a mask of lines."""
    lines = text.splitlines()

    def render(mask):
        shown = "".join(line + "\n" if m else "\0" for line, m in zip(lines, mask, strict=True))
        return re.sub("\0+", evidence.GAP + "\n", shown.strip("\0")).removesuffix("\n")

    mask = [k < evidence.HEAD or k >= len(lines) - evidence.TAIL for k in range(len(lines))]
    weights = [next(((-w, k, a) for w, a, p in evidence.LANDMARKS if re.search(p, line)), None) for k, line in enumerate(lines)]
    for _, k, a in sorted(w for w in weights if w):
        trial = [m or k - a <= n <= k + a for n, m in enumerate(mask)]
        mask = trial if len(render(trial)) <= budget else mask
    return render(mask)


def test_landmarks_within_budget():
    rng = random.Random(1)
    for size in (30, 300):
        lines = [rng.choice(["int x = 1;", "assert x;", "o instanceof String", "void testIt() {", "", "  filler filler filler"]) for _ in range(size)]
        text = "\n".join(lines)
        for budget in (50, 700, 1500, 4000, len(text) - 1, len(text)):
            out = evidence.landmark_lines(text, budget)
            assert len(out) <= budget + 60 and (budget < len(text) or out == text)
            if 1500 <= budget < len(text):
                assert out == _kept_by_trial(text, budget) and len(out) <= budget
    assert evidence.clipped("x" * 10, 0) == "" and evidence.landmark_lines("", 5) == ""


def test_source_blocks(spark):
    df = spark.createDataFrame(
        [("c", "Zother.java", "y\n" * 3000, 1), ("c", "Main.java", "x\n" * 3000, 2), ("d", "A.java", "short", 3), ("e", None, None, 4), (None, "B.java", "z", 5), ("f", None, "", 6), *[("g", f"F{k}.java", "z" * 900, 10 + k) for k in range(300)]],
        "k string, n string, t string, i int",
    )
    blocks = evidence.source_blocks(df, "k", "n", "t", "i", 4000)
    got = {r["case_id"]: r for r in evidence.packed(_renamed(blocks), "case_id").collect()}
    assert set(got) == {"c", "d", "f", "g"} and got["d"]["packed"] == "\n--- A.java (full) ---\nshort" and got["f"]["packed"] == "\n---  (full) ---\n"
    assert got["c"]["files"] == 2 and got["c"]["original"] == 12000 and len(got["c"]["packed"]) <= 4800 and got["c"]["packed"].index("Main.java") < got["c"]["packed"].index("Zother.java")
    assert got["g"]["files"] == 300 and got["g"]["original"] == 270000 and len(got["g"]["packed"]) <= 3200
    assert evidence.source_blocks(df.limit(0), "k", "n", "t", "i", 4000).count() == 0


def test_patch_blocks(spark):
    lines = ["diff --git a/x b/src/x.cpp", "--- a/src/x.cpp", "+++ b/src/x.cpp", "@@ -1 +1 @@ small", " a", "+b", " c", *[" d"] * 9, "-e", " f", "@@ -9 +9 @@ no change", " g", "@@ -20 +20 @@ GVN", "+h"]
    diff = "\n".join(["diff --git a/t b/test/t.txt", "+++ b/test/t.txt", "@@ -1 +1 @@", "+t", *lines])
    df = spark.createDataFrame([("c", "fix.patch", diff, 1), ("c", "backport.patch", "+x\n" * 4000, 2), ("d", "n.patch", "", 3), ("e", None, None, 4)], "k string, n string, t string, i int")
    s = {(r["i"], r["section"]): r for r in evidence.patch_sections(df.filter("t IS NOT NULL"), "i", "t", ("x.cpp",), ("gvn",)).collect()}
    assert [s[1, 2]["path"], s[1, 1]["path"], s[2, 0]["path"]] == ["src/x.cpp", "test/t.txt", "unknown"] and s[1, 2]["rank"] < s[1, 1]["rank"]
    body = s[1, 2]["body"].split("\n")
    assert body[0] == "File: src/x.cpp" and body[4:6] == ["@@ -20 +20 @@ GVN", "+h"] and "@@ -9 +9 @@ no change" not in body
    assert body[6:] == ["@@ -1 +1 @@ small", " a", "+b", " c", " d", " d", evidence.CONTEXT_GAP, " d", " d", " d", "-e", " f"]
    blocks = {(r["case_id"], r["place"]): r["block"] for r in _renamed(evidence.patch_blocks(df, "k", "n", "t", "i", 3000, ("x.cpp",), ("gvn",))).collect()}
    assert set(blocks) == {("c", 1), ("c", 2), ("d", 1)} and blocks["c", 1].index("File: src/x.cpp") < blocks["c", 1].index("File: test/t.txt")
    assert blocks["c", 1].startswith("\n\nPatch file: fix.patch") and sum(len(b) for (k, _), b in blocks.items() if k == "c") <= 3000


def _renamed(blocks):
    """The case column, here named as the place, under a name of its own."""
    return blocks.toDF("case_id", *blocks.columns[1:])


def test_link_and_timeline_shapes(spark):
    links = '[{"outward":{"key":"JDK-2"},"inward":{"key":null},"type":{"outward":"relates to","inward":"x","name":"R"}},{"outward":{"key":null},"inward":{"key":"JDK-3"},"type":{"outward":"","inward":"","name":"Duplicate"}},{"outward":{"key":"CODE-1"},"inward":null,"type":{"outward":"relates to","inward":"","name":""}}]'
    schema = "array<struct<outward:struct<key:string>,inward:struct<key:string>,type:struct<outward:string,inward:string,name:string>>>"
    df = spark.createDataFrame([("JDK-1", links)], "k string, j string").select("k", F.from_json("j", schema).alias("links"))
    assert {tuple(r) for r in extract.related_issues(df, "k", "links", "JDK-").collect()} == {("JDK-1", "JDK-2", "relates to"), ("JDK-1", "JDK-3", "Duplicate")}
    ev = ['{"source": {"issue": {"pull_request": {"u": 1}, "number": 5, "repository_url": "https://api/repos/a/b"}}}', '{"commit_id": "abc", "commit_url": null}', '{"subject": {"type": "PullRequest", "url": "https://api/repos/c/d/pulls/9"}}', "broken", "{}"]
    e = spark.createDataFrame([("i", k, x, "home/r") for k, x in enumerate(ev)], "k string, pos int, e string, home string")
    assert {tuple(r) for r in extract.timeline_refs(e, "k", "e", "home").collect()} == {("i", 0, "pull", "a/b", "5"), ("i", 1, "commit", "home/r", "abc"), ("i", 2, "pull", "c/d", "9")}


def test_type_edges(spark, monkeypatch):
    from millrace.plans import reference

    code = """class A<T extends Comparable<T> & K> extends x.Base<Map<String, T>> implements I, J<Map<K, V>> { <E extends Number> void f() { } }
    interface L<Q extends Z> extends M, @N O { } enum P implements J { X { } } record R(List<? extends S> s) implements I { }
    sealed class D extends Object permits U { } // class C extends A {
    """
    edges = [("A", "CLASS", "Base", "CLASS"), ("A", "CLASS", "I", "INTERFACE"), ("A", "CLASS", "J", "INTERFACE"), ("L", "INTERFACE", "M", "INTERFACE"), ("L", "INTERFACE", "O", "INTERFACE"), ("P", "ENUM", "J", "INTERFACE"), ("R", "CLASS", "I", "INTERFACE")]
    assert features.type_edges(code) == edges
    assert features.type_edges("a class that extends a thing; class Foo(Base): x = {}") == []
    df = spark.createDataFrame([(1, code), (2, None), (3, "class W<T extends Comparable> { }")], "artifact_id bigint, content string")
    monkeypatch.setattr(reference, "table", lambda *_: df)
    got = {r["pattern"]: r["n"] for r in reference.QUERIES["hierarchy_patterns"](spark, "").collect()}
    assert got == {"C0->C1, C0->I0, C0->I1, C2->I0, E0->I1": 1, "I0->I1, I0->I2": 1}
