import pytest
from pyspark.sql import functions as F

from millrace.functions import code, extract, text


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **cols):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
        return df.select(column).head(1)[0][0]

    return value


def test_normalisation(one):
    assert one(text.collapse(F.col("x")), x=" a \n b\t") == "a b"
    assert [one(text.label(F.col("x")), x=v) for v in (" Yes ", "yes", None)] == ["Yes", "Missing", "Missing"]
    assert [one(text.tier(F.col("x")), x=v) for v in ("c2", "Server  Compiler", "SHARED", "tier4", None)] == ["C2", "C2", "Shared", "Unknown", "Unknown"]
    assert one(text.percent(F.col("c"), F.col("n")), c=12125, n=100000) == 12.125 and one(text.percent(F.col("c"), F.col("n")), c=1, n=0) == 0.0
    assert one(text.percent_text(F.col("c"), F.col("n")), c=1, n=0) == "0.00%"
    assert one(text.duration_text(F.col("s")), s=90061) == "1d 01h 01m 01s"
    assert one(text.version_line(F.col("x")), x="\nPicked up X\n openjdk 17 \nmore") == "openjdk 17"
    assert [one(text.output_name(F.col("x")), x=v) for v in ("JDK-123_a.Main", "openj9-7.x", "OpenJ9-7 x", "JDK-1.", "seed.A")] == ["JDK-123_a", "openj9-7", "OpenJ9-7 x", "JDK-1.", "seed.A"]
    assert one(text.latex(F.col("x")), x="a_b & 5%") == r"a\_b \& 5\%"


def test_idempotence(one):
    for f in (text.collapse, text.dense, text.identifier, text.safe_name):
        x = one(f(F.col("x")), x=' a<b>:  "c" \t?..')
        assert one(f(F.col("x")), x=x) == x


def test_captured_output(one):
    mark = text.CUT_MARK
    assert one(text.first_lines(F.col("x"), 3), x="a\nb") == "a\nb"
    assert one(text.first_lines(F.col("x"), 2), x="a\nb\nc") == "a\nb" + mark
    assert one(text.first_lines(F.col("x"), 9), x="a\nb\nc [TRUNCATED]") == "a\nb" + mark
    assert one(text.first_lines(F.col("x"), 9), x=None) == ""
    noisy = "[warning] x\nkeep Foo@1a2b3c4d\nJVMDUMP03\nlast"
    assert one(text.captured(F.col("x"), F.lit(0), 9), x=noisy) == "keep Foo@ADDR\nlast"
    assert one(text.captured(F.col("x"), F.lit(-124), 1), x=noisy) == noisy
    assert one(text.clip(F.col("x"), 100), x="y" * 99) == "y" * 99 and "truncated" in one(text.clip(F.col("x"), 100), x="y" * 101) and one(text.clip(F.col("x"), 0), x="y") == ""
    assert one(text.summary_lines(F.col("x"), 2), x=" a\n\n b \nc") == "a / b"
    assert one(text.strip_reasoning(F.col("x")), x="<think>no</think>```json\n{}\n```") == "{}"


def test_fingerprints(one):
    log = "A.java:12: error: x\nB.java:3: Error\n(at line 7) y\nA.java:12: error"
    assert one(extract.error_lines(F.col("x")), x=log) == ["Line-12", "Line-3", "Line-7", "Line-12"]
    assert one(extract.canonical_lines(F.lit("COMPILER_UNREACHABLE_CODE"), F.array(F.lit("Line-1")))) == ["COMPILER_LAMBDA_MISSING_RETURN_VALUE"]
    reasons = {"error: cannot find symbol\n symbol: class Foo": "COMPILER_SYMBOL_NOT_FOUND", "Unreachable code": "COMPILER_UNREACHABLE_CODE", "missing return statement": "COMPILER_MISSING_RETURN", "bad return type in lambda expression missing return value": "COMPILER_LAMBDA_MISSING_RETURN_VALUE", "fine": "NONE"}
    for t, r in reasons.items():
        assert one(extract.failure_reason(F.col("x")), x=t) == r
    names = one(extract.issue_names(F.col("x")), x="Exception in thread main java.lang.RuntimeException: y\n at a.b.FooException.x(F.java)\n... more\nOutOfMemoryError and FooError.bar x.BarException.")
    assert names == ["java.lang.RuntimeException", "OutOfMemoryError"]
    assert one(extract.crashed(F.col("x"), F.lit(0)), x="core dump OutOfMemoryError") is False and one(extract.crashed(F.col("x"), F.lit(134)), x="") is True


def test_blocks_links_and_responses(one):
    t = "--- BEGIN SOURCE ---\nclass A {}\n--- END SOURCE ---\n```java\nclass B {}\n```\nhttps://github.com/user-attachments/files/1/A.java https://github.com/user-attachments/files/1/A.java"
    assert one(extract.source_blocks(F.col("x")), x=t) == ["class A {}"] and one(extract.fenced_blocks(F.col("x")), x=t) == ["class B {}"] and len(one(extract.attachment_urls(F.col("x")), x=t)) == 1
    assert one(extract.commit_link(F.col("u"), F.col("t")), u="https://git.openjdk.org/jdk/commit/abcdef1234", t="")["repository"] == "openjdk/jdk"
    assert one(extract.commit_link(F.col("u"), F.col("t")), u="", t="Commit openjdk/jdk17u/abcdef1")["sha"] == "abcdef1"
    assert one(extract.repository_of(F.col("u")), u="https://api.x/repos/a/b/issues/1") == "a/b"
    assert [one(extract.valid_patch(F.col("x")), x=v) for v in ("diff --git a b", "--- a\n+++ b\n", "--- a", '{"a": "diff --git "}', "", "[]")] == [True, True, False, False, False, False]
    assert one(extract.response_objects(F.col("x")), x='say {"results": [{"a": 1}, 2, {"b": 2}]} ok') == ['{"a":1}', '{"b":2}']
    assert one(extract.response_objects(F.col("x")), x='[{"a": 1}]') == ['{"a":1}'] and one(extract.response_objects(F.col("x")), x="no") is None
    u = one(extract.usage_counts(F.col("x")), x='{"total_tokens": 7, "prompt_tokens_details": {"cached_tokens": 3}}')
    assert (u["total_tokens"], u["cached_tokens"], u["prompt_tokens"]) == (7, 3, None)
    assert tuple(one(extract.loop_detail(F.col("x")), x="Depth: 2, Count: [11, 100]")) == (2, "[11, 100]")


def test_code_states(one):
    x = F.col("x")
    src = 'class A { // "x {\n String s = "a // b { \\" }"; char c = \'{\'; /* } \n */ }'
    blank = one(code.masked(x), x=src)
    assert blank == code.blank_out(src)
    assert len(blank) == len(src) and blank.count("\n") == src.count("\n") and blank.count("{") == 1 and blank.count("}") == 1
    bare = one(code.uncommented(x), x=src)
    assert '"a // b { \\" }"' in bare and '"x {' not in bare
    assert one(code.balanced_length(x), x=src[src.index("{") :]) == len(src) - src.index("{") and one(code.balanced_length(x), x="{ '}' ") is None
    texts = (None, " ", "<!DOCTYPE html><html>", "public class Abcdefghij {", src)
    assert [one(code.source_verdict(x), x=t) for t in texts] == ["empty", "empty", "html", "incomplete", "valid"]
    prose = "see below\nimport java.util.*;\n// note\npublic class Foo { void f() { } class In { int inner; } }\nand class Bar { int x; } too; class Open {"
    got = one(code.inline_code(x), x=prose)
    assert got[0].startswith("import java.util.*;") and got[1].endswith("{ int x; }") and len(got) == 2
    assert one(code.inline_code(x), x="") == [] and one(code.inline_code(x), x=None) is None
    # Long literals and comments are matched in a loop, not on the stack.
    for long in ('"' + "\\n" * 300_000 + '"', "/*" + "* " * 300_000 + "*/", '"""' + 'a"b\\"' * 100_000 + '"""'):
        assert one(code.source_verdict(x), x=f"class Long {{ String s = {long}; }} // end of it") == "valid"


def test_source_info(spark):
    df = spark.createDataFrame([("package a.b;\n// class X {\nclass C { }\npublic class D { public static void main(String[] a) { } }", "D.java")], "c string, f string")
    i = df.select(extract.source_info(code.masked(df.c), df.f).alias("i")).head(1)[0]["i"]
    assert (i["package"], i["types"], i["primary"], i["has_main"]) == ("a.b", ["C", "D"], "D", True)
