"""Language features of source files, found by words and tokens.

A typed syntax tree is not available here: every detector is a lexical stand-in over code whose comments and
literals are blanked out, and says so in ``approximate``. Occurrences come out as rows (case, seq, feature, line,
detail), the input of the feature statistics.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.code import blank_out

_PRIMITIVES = "byte|short|char|int|long|float|double|boolean"
_WRAPPERS = "Byte|Short|Character|Integer|Long|Float|Double|Boolean"
#: feature: pattern over blanked-out code. Names are the fixed vocabulary of the feature statistics.
PATTERNS: dict[str, str] = {
    "assignmentStmt": r"(?<![=!<>])(?:[+\-*/%&|^]|<<|>>>?)?=(?![=])",
    "ifStmt": r"\bif\s*\(",
    "invocationStmt": r"\b(?!if\b|for\b|while\b|switch\b|catch\b|synchronized\b|return\b|new\b)[A-Za-z_$][\w$]*\s*\([^(){};]*\)\s*;",
    "switchStmt": r"\bswitch\s*\(",
    "tryCatchStmt": r"\btry\s*[({]",
    "arithmeticOperator": r"(?<![+\-*/%])[+\-*/%](?![+\-=*/>])",
    "shiftOperator": r"<<|>>>?(?=\s*[\w(])(?<=[\w)\]]\s>>)|(?<=[\w)\]]\s)>>>",
    "compareOperator": r"[=!]=|(?<=\s)[<>]=?(?=\s)",
    "logicalOperator": r"&&|\|\|",
    "unaryOperator": r"\+\+|--|(?<=[=(,&|\s])[!~](?!=)",
    "instanceofOperator": r"\binstanceof\b",
    "booleanType": r"\bboolean\b",
    "byteType": r"\bbyte\b",
    "charType": r"\bchar\b",
    "integerType": r"\bint\b",
    "floatType": r"\bfloat\b",
    "doubleType": r"\bdouble\b",
    "longType": r"\blong\b",
    "shortType": r"\bshort\b",
    "primitiveType": rf"\b(?:{_PRIMITIVES})\b",
    "nullType": r"\bnull\b",
    "wrapperType": rf"\b(?:{_WRAPPERS})\b",
    "arrayType": r"\b[A-Za-z_$][\w$]*(?:<[^<>;{}]*>)?\s*(?:\[\s*\])+(?!\s*args\b)",
    "arrayAccess": r"\b[A-Za-z_$][\w$]*\s*\[\s*[^\]\s]",
    "genericType": r"\b(?:class|interface|record)\s+\w+\s*<",
    "parameterizedType": r"\b[A-Z][\w$]*\s*<\s*[A-Z?\w][^<>;{}()]*>",
    "typeParameter": r"\b(?:class|interface|record)\s+\w+\s*<|(?:\b(?:public|private|protected|static|final)\s+)+<\s*[A-Z]",
    "boundedTypeParameter": r"<\s*[A-Z]\w*\s+extends\b",
    "wildcardType": r"<\s*\?",
    "boundedWildcardType": r"\?\s*(?:extends|super)\b",
    "genericMethod": r"(?:\b(?:public|private|protected|static|final|default)\s+)+<[^<>]*(?:<[^<>]*>)?[^<>]*>\s*\w",
    "interfaceType": r"\binterface\s+\w",
    "abstractType": r"\babstract\s+(?:\w+\s+)*class\b",
    "enumType": r"\benum\s+\w",
    "lambda": r"->",
    "synchronizedAccess": r"\bsynchronized\b",
    "classLiteral": r"\.\s*class\b",
    "reflection": r"\b(?:getDeclaredMethods?|getMethods?|getDeclaredFields?|getFields?|getDeclaredConstructors?|getConstructors?|forName|newInstance|setAccessible)\s*\(|\bjava\s*\.\s*lang\s*\.\s*reflect\b",
    "reflectiveMethodInvocation": r"\.\s*invoke\s*\(",
    "methodHandle": r"\b(?:MethodHandles?|MethodType|VarHandle)\b|\binvoke(?:Exact|WithArguments)\s*\(",
    "customClassLoader": r"\bextends\s+(?:URL)?ClassLoader\b",
    "TypeCast": rf"\(\s*(?:{_PRIMITIVES}|[A-Z][\w$.]*(?:<[^<>()]*>)?)(?:\s*\[\s*\])*\s*\)\s*[\w(\"'!~]",
    "primitiveConversion": rf"\(\s*(?:{_PRIMITIVES})\s*\)\s*[\w(\"'!~+-]",
    "boxingUnboxing": rf"\b(?:{_WRAPPERS})\s*\.\s*valueOf\s*\(|\.\s*(?:byte|short|char|int|long|float|double|boolean)Value\s*\(",
}
#: Features that the reports show; the others only feed other statistics.
REPORTED = (
    "ifStmt switchStmt tryCatchStmt loop arithmeticOperator shiftOperator compareOperator primitiveType wrapperType arrayType genericType typeParameter "
    "wildcardType interfaceType abstractType nestedType hierarchy lambda reflection methodHandle TypeCast primitiveConversion"
).split()
FEATURES = [*PATTERNS, "loop", "nestedType", "hierarchy"]
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
_LOOP = re.compile(r"\b(for|while|do)\b")
_COUNTED = re.compile(r"\s*\(\s*(?:int|long|short|byte)\s+(\w+)\s*=\s*(-?\d+)\s*;\s*\1\s*(<=?|>=?|!=)\s*(-?\d+)\s*;\s*(?:\1(\+\+|--)|(\+\+|--)\1|\1\s*([+-]=)\s*(\d+))\s*\)")
_BRACES, _PARENTHESES, _BODY = re.compile(r"[{}]"), re.compile(r"[()]"), re.compile(r"\s*\{")
_TYPE = re.compile(r"\b(class|interface|enum|record)\s+(\w+)")
_SUPER = re.compile(r"\bclass\s+(\w+)(?:\s*<[^{]*?>)?\s*(?:extends\s+([\w.]+)(?:\s*<[^{]*?>)?)?\s*(?:implements\s+([^{]+))?\{")

_DECLARED = re.compile(r"(?<![\w$.@])(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)")
_HEADER, _CLAUSE, _NAMED = re.compile(r"[<>(){};]"), re.compile(r"\b(extends|implements|permits)\b"), re.compile(r"[\w$.]+")


def trip_bucket(start: int, op: str, limit: int, step: int) -> str:
    """Bucket of the trip count of a counted loop with literal bounds."""
    if not step or op == "!=" and (limit - start) % step:
        return "Unknown"
    if op in ("<", "<="):
        n = 0 if step < 0 else max(0, -(-(limit - start + (op == "<=")) // step))
    elif op in (">", ">="):
        n = 0 if step > 0 else max(0, -(-(start - limit + (op == ">=")) // -step))
    else:
        n = max(0, (limit - start) // step)
    return "[0, 10]" if n <= 10 else "[11, 100]" if n <= 100 else "[101, 10000]" if n <= 10_000 else "[10000, inf)"


def occurrences(text: str) -> list[tuple[str, int, str | None]]:
    """feature, line, detail in the order of the text."""
    code = blank_out(text)
    found: list[tuple[int, str, str | None]] = [(m.start(), k, None) for k, p in _COMPILED.items() for m in p.finditer(code)]
    # Depths: a loop's body is the braces after its head; loops whose body encloses a place count.
    stack: list[int] = []
    closes: dict[int, int] = {}
    for m in _BRACES.finditer(code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            closes[stack.pop()] = m.start()
    inside: list[int] = []  # ends of the loop bodies that are open
    do_ends: set[int] = set()
    for m in _LOOP.finditer(code):
        while inside and inside[-1] < m.start():
            inside.pop()
        if m[1] == "while":
            before = m.start() - 1
            while before >= 0 and code[before].isspace():
                before -= 1
            if before in do_ends:
                continue  # the end of a do loop
        at, deep = m.end(), 0
        if m[1] != "do":
            for k in _PARENTHESES.finditer(code, at):
                deep += 1 if k[0] == "(" else -1
                if deep <= 0:
                    at = k.end()
                    break
        body = (k.end() - 1) if (k := _BODY.match(code, at)) else -1
        depth = 1 + len(inside)
        if body >= 0:
            inside.append(closes.get(body, len(code)))
            if m[1] == "do":
                do_ends.add(closes.get(body, len(code)))
        bucket = "Unknown"
        if m[1] == "for" and (c := _COUNTED.match(code, m.end())):
            step = int(c[8]) if c[8] else 1
            bucket = trip_bucket(int(c[2]), c[3], int(c[4]), -step if "-" in (c[5] or c[6] or c[7]) else step)
        found.append((m.start(), "loop", f"Depth: {depth}, Count: {bucket}"))
    types = [(m.start(), m[1]) for m in _TYPE.finditer(code)]
    opened, closed = sorted(closes), sorted(closes.values())
    found += [(at, "nestedType", None) for at, _ in types if bisect_right(opened, at) > bisect_right(closed, at)]
    for m in _SUPER.finditer(code):
        for name in filter(None, [m[2], *[x.split("<")[0].strip() for x in (m[3] or "").split(",")]]):
            if name not in ("Object", "Enum", "Record"):
                found.append((m.start(), "hierarchy", f"{m[1]}->{name}"))
    lines = [k.start() for k in re.finditer("\n", code)]
    return [(f, bisect_right(lines, at) + 1, d) for at, f, d in sorted(found, key=lambda x: (x[0], x[1]))]


def feature_rows(files: DataFrame, case: str, text: str) -> DataFrame:
    """case, seq, feature, line, detail, approximate. Null texts give no row."""
    types = dict(files.dtypes)
    src = files.select(case, F.col(text).alias("__text")).filter("__text IS NOT NULL")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, *r, True) for k, t in zip(b[case], b["__text"], strict=True) for n, r in enumerate(occurrences(t))]
            if rows:
                yield pd.DataFrame(rows, columns=[case, "seq", "feature", "line", "detail", "approximate"])

    return src.mapInPandas(scan, f"{case} {types[case]}, seq int, feature string, line int, detail string, approximate boolean")


def type_edges(text: str) -> list[tuple[str, str, str, str]]:
    """src, src_type, dst, dst_type of every ``extends`` and ``implements`` of a type declaration; simple names. What
    stands in type parameters, arguments and record components is no edge."""
    code, found = blank_out(text), []
    for m in _DECLARED.finditer(code):
        head, deep, at = [], 0, m.end()
        for k in _HEADER.finditer(code, m.end()):
            if not deep:
                head.append(code[at : k.start()])
            at = k.end()
            if k[0] in "<(":
                deep += 1
            elif k[0] in ">)":
                deep -= 1
            elif not deep or k[0] == ";":
                break
        else:
            continue
        if k[0] != "{" or deep:
            continue
        parts = _CLAUSE.split(re.sub(r"\s*\.\s*", ".", re.sub(r"@\s*[\w$.]+", " ", " ".join(head))))
        clauses = [(c, [x.strip() for x in names.split(",")]) for c, names in zip(parts[1::2], parts[2::2], strict=True)]
        if parts[0].strip() or not all(_NAMED.fullmatch(x) for _, names in clauses for x in names):
            continue  # words of another language or of prose
        src_type = "CLASS" if m[1] == "record" else m[1].upper()
        for c, names in clauses:
            dst_type = "CLASS" if c == "extends" and m[1] == "class" else "INTERFACE"
            for x in names:
                if c != "permits" and x.removeprefix("java.lang.") not in ("Object", "Enum", "Record"):
                    found.append((m[2], src_type, x.rsplit(".", 1)[-1], dst_type))
    return found


def type_edge_rows(files: DataFrame, case: str, text: str) -> DataFrame:
    """case_id (string), src, src_type, dst, dst_type of each file. Null texts give no row."""
    src = files.select(F.col(case).cast("string").alias("case_id"), F.col(text).alias("__text")).filter("__text IS NOT NULL")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *e) for k, t in zip(b["case_id"], b["__text"], strict=True) for e in type_edges(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["case_id", "src", "src_type", "dst", "dst_type"])

    return src.mapInPandas(scan, "case_id string, src string, src_type string, dst string, dst_type string")
