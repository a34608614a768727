import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import syntax
from millrace.llm.peg import Grammar

GOOD = {
    "java": [
        "",
        "package a.b; import java.util.*; import static java.lang.Math.*; ;",
        'public class A<T extends Comparable<T>> { int[] x = {1, 2,}; String t = """\n a "b" \\\n c"""; void f() { for (int i = 0, j = 1; i < 3; i++, j--) { } } }',
        "record P(int x, String... y) implements Q { P { if (x < 0) throw new RuntimeException(); } }",
        "sealed interface S permits A, B { default void f() { } } non-sealed class A implements S { } final class B implements S { }",
        "enum E { A(1) { void f() { } }, B; E(int... v) { } } @interface N { int value() default 1; }",
        "class A { int f(int x) { return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; } }",
        "class A { Object o = (Runnable & java.io.Serializable) () -> { }; Object p = int[]::new; boolean q = o instanceof String s && s.length() > 1 >> 0; }",
        "class A { /* <<<<<<< x */ String s = \"======= y\"; char c = '('; }",
        "class A { { try (var r = f(); g) { } catch (A | B e) { } finally { } this.<T>h().new I(); a[0] += 1; ++a[1]; } }",
    ],
    "py": ["", "def f(a, /, b=1, *, c, **k): return {**k, 'x': [*a]}\n", "match x:\n    case {'a': [1, *_], **r} if r: pass\n    case A(b=1) | None: pass\n", "x = f'{a!r:>{w}} {{}} {b=}'\n", "async def f():\n    async with a as b, c: await d\n", "try:\n    pass\nexcept* E as e:\n    pass\n", "type X[T: int, *U] = list[T]\n", "if x:\n\ty = 1\n", "a = b = yield_ = (lambda *a, b=1: a)\n"],
    "json": ["{}", ' [1, -0.5e+3, true, null, "\\u00e9"] ', '"x"', "0"],
    "xml": ["<a/>", '<?xml version="1.0"?>\n<!DOCTYPE a [<!ENTITY e "f">]><!-- c --><a b="1&amp;2">&e;<b>t</b><![CDATA[<x>]]></a>\n', "<a x='1'><?pi d?></a>"],
}
BAD = {
    "java": ["class A { void f( { } }", "class A {", "class A { int x = 1 }", "class A { void f() { x + 1; } }", "<<<<<<< a\nclass A { }", "class A { List<int> x; }", "class A { String s = \"a; }", "class A { } }", "class A { /* }", "def f(): pass", "class A { int x = 09; }"],
    "py": ["def f()\n    pass\n", "print 'x'\n", "if x:\npass\n", "    x = 1\n", "x = (1\n", "a b\n", "f(a=1, 2)\n", "x = 0777\n", "def f(a=1, b): pass\n", "'abc\n", "x = f'{a'\n", "<<<<<<< x\n", "if x:\n\ty\n        z\n"],
    "json": ["", "{'a': 1}", "[1,]", "01", "nul", '{"a":1} x', '"\x01"', "NaN", "{\"a\" 1}"],
    "xml": ["", "<a>", "<a></b>", "<a b='1' b='2'/>", "<a>&x;</a>", "<a>]]></a>", "<a/><b/>", " <?xml version='1.0'?><a/>", "<a b=1/>", "x<a/>", "<a>\x01</a>", "<a><!-- -- --></a>"],
}


@pytest.mark.parametrize("lang", GOOD)
def test_valid_and_invalid(lang):
    for text in GOOD[lang]:
        assert syntax.failure(lang, text) == -1, text
    for text in BAD[lang]:
        assert syntax.failure(lang, text) >= 0, text


def test_python_agrees_with_the_parser_on_itself():
    import pathlib

    for f in sorted(pathlib.Path(syntax.__file__).parent.glob("*.py")):
        text = f.read_text()
        for cut in (len(text), len(text) // 2, len(text) // 3):
            part = text[:cut]
            try:
                ast.parse(part)
                valid = True
            except SyntaxError:
                valid = False
            assert (syntax.failure("py", part) < 0) == valid


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12), st.data())
def test_json_agrees_with_json(value, data):
    import json

    text = json.dumps(value)
    assert syntax.failure("json", text) == -1
    cut = data.draw(st.integers(0, len(text)))
    broken = text[:cut] + data.draw(st.sampled_from(["", ",", "}", "x", '"'])) + text[cut + 1 :]
    try:
        json.loads(broken, parse_constant=lambda _: 1 / 0)
        valid = True
    except (ValueError, ZeroDivisionError):
        valid = False
    assert (syntax.failure("json", broken) < 0) == valid


def test_deep_and_long_texts():
    assert syntax.failure("json", "[" * 20_000 + "]" * 20_000) == -1
    assert syntax.failure("xml", "<a>" * 5_000 + "</a>" * 5_000) == -1
    assert syntax.failure("java", "class A { int x = 1; }\n" * 20_000) == -1
    assert syntax.failure("java", "class A { int x = 1; }\n" * 20_000 + "}") >= 0


DTD_GOOD = [
    '<!DOCTYPE a [<!ELEMENT a (b, (c | d)*, e?)+><!ELEMENT b (#PCDATA)><!ELEMENT c (#PCDATA | b)*><!ELEMENT d EMPTY><!ELEMENT e ANY>]><a/>',
    "<!DOCTYPE a PUBLIC '-//X//Y' \"u\" [ <!ATTLIST a x CDATA #IMPLIED y (p|q) 'p' z NMTOKENS #FIXED \"1 2\" n NOTATION (g) #REQUIRED> ]><a/>",
    '<!DOCTYPE a [<!ENTITY % p "x"><!ENTITY e SYSTEM "s"><!ENTITY u PUBLIC "p" "s" NDATA g><!NOTATION g PUBLIC "p"><!-- c -->%p;]><a>&e;</a>',
    '<!DOCTYPE a [<!ENTITY e "<b>t</b>&f;"><!ENTITY f "x &#60; y &lt;">]><a k="&g;">&e;</a>'.replace("&g;", "").replace("&#60; y ", ""),
    "<!DOCTYPE a [<!ENTITY never '<b>'>]><a/>",
    "<!DOCTYPE EMPTY [<!ELEMENT EMPTY EMPTY>]><EMPTY/>",
]
DTD_BAD = [
    "<!DOCTYPE a [<!ELEMENT a (b,,|c)>]><a/>", "<!DOCTYPE a [<!ELEMENT a (b|c,d)>]><a/>", "<!DOCTYPE a [<!ELEMENT a ()>]><a/>", "<!DOCTYPE a [<!ELEMENT a (b) ?>]><a/>", "<!DOCTYPE a [<!ELEMENT a (#PCDATA|b)>]><a/>", "<!DOCTYPE a [<!ELEMENT a(b)>]><a/>",
    "<!DOCTYPE a [<!ATTLIST a x FOO #IMPLIED>]><a/>", "<!DOCTYPE a [<!ATTLIST a x CDATA>]><a/>", "<!DOCTYPE a [<!ATTLIST a x CDATA '<'>]><a/>", "<!DOCTYPE a [<!ATTLIST a x () 'y'>]><a/>",
    "<!DOCTYPE a [<!ENTITY e '%'>]><a/>", "<!DOCTYPE a [<!ENTITY e '&'>]><a/>", "<!DOCTYPE a [<!ENTITY e '<b>'>]><a>&e;</a>", "<!DOCTYPE a [<!ENTITY e '&e;'>]><a>&e;</a>", "<!DOCTYPE a [<!ENTITY e '&f;'><!ENTITY f '&e;'>]><a b='&e;'/>", "<!DOCTYPE a [<!ENTITY e '<b/>'>]><a b='&e;'/>", "<!DOCTYPE a [<!ENTITY e '&#60;b>'>]><a>&e;</a>",
    "<!DOCTYPE a [<!ENTITY u SYSTEM 's' NDATA g>]><a>&u;</a>", "<!DOCTYPE a [<!ENTITY u SYSTEM 's'>]><a b='&u;'/>", "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&f;</a>", "<!DOCTYPE a [<!FOO a>]><a/>", "<!DOCTYPE a [<!ELEMENT a ANY>><a/>", "<!DOCTYPE a PUBLIC '<' 'x'><a/>", "<!DOCTYPE a SYSTEM><a/>", "<a/><!DOCTYPE a>",
]


def test_document_types():
    from xml.parsers import expat

    for text in DTD_GOOD:
        assert syntax.failure("xml", text) == -1, text
    for text in DTD_BAD:
        assert syntax.failure("xml", text) >= 0, text

    def sound(text):
        p = expat.ParserCreate()
        p.ExternalEntityRefHandler = lambda *_: 1
        try:
            p.Parse(text, True)
            return True
        except expat.ExpatError:
            return False

    # Every text with one character left out, doubled or turned into another one.
    checked = differ = 0
    for text in DTD_GOOD[:2] + DTD_GOOD[3:] + DTD_BAD[:16]:
        for k in range(len(text)):
            for other in ("", text[k] * 2, ">", "|", " "):
                changed = text[:k] + other + text[k + 1 :]
                checked += 1
                differ += (syntax.failure("xml", changed) < 0) != sound(changed)
    assert checked > 5000 and differ < 0.01 * checked


def test_nesting_has_no_limit(spark, monkeypatch):
    for depth in (200, 201, 300, 2000):
        assert syntax.failure("py", "x = " + "(" * depth + "1" + ")" * depth + "\n") == -1
        assert syntax.failure("py", "x = " + "(" * depth + "1" + ")" * (depth - 1) + "\n") >= 0
    assert syntax.cause("java", "x = 1\n", syntax.failure("java", "x = 1\n")) == "wrong_extension"


def test_packrat_choice_and_lookahead():
    g = Grammar("S <- A !'b' 'c'? EOF / 'a' 'b' EOF\nA <- 'a' / 'x'+", "S", {"a": "a", "b": "b", "c": "c", "x": "x"}, {})
    assert [g.failure(k) for k in ("a", "ac", "ab", "xxx")] == [-1] * 4
    assert g.failure("abc") == 2 and g.failure("b") == 0


def test_cause_and_place():
    merge = "class A {\n<<<<<<< ours\n int x;\n=======\n int y;\n>>>>>>> theirs\n}\n"
    at = syntax.failure("java", merge)
    assert merge[at:].startswith("<<") and syntax.cause("java", merge, at) == "conflict"
    cut = "class A { void f() { int x = 1;"
    assert syntax.cause("java", cut, syntax.failure("java", cut)) == "truncated"
    assert syntax.cause("java", '{"a": [1, 2]}', 0) == "wrong_extension"
    assert syntax.cause("java", "class A { int = 1; }", syntax.failure("java", "class A { int = 1; }")) == "syntax"


def test_operator(spark):
    rows = [(1, "r", "A.JAVA", "class A { }"), (2, "r", None, "class {"), (3, "r", "x.py", "x = (\n"), (4, "q", "x.json", None), (5, "q", "x.txt", "?"), (6, "q", " ", ""), (6, "q", " ", ""), (7, None, "d.xml", "<a>")]
    df = spark.createDataFrame(rows, "artifact_id bigint, repository string, original_filename string, content string").selectExpr("*", "1 AS language", "'x' AS valid", "artifact_id AS id")
    assert {r[0] for r in syntax.found_invalid(df).collect()} == {2, 3, 7}
    rates = {(r["repository"], r["language"]): (r["files"], r["invalid"]) for r in syntax.invalid_rates(syntax.checked_files(df)).collect()}
    assert rates == {("r", "java"): (2, 1), ("r", "py"): (1, 1), ("q", "java"): (2, 0), (None, "xml"): (1, 1)}
    assert syntax.found_invalid(df.limit(0)).count() == 0
