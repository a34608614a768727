"""Source files that do not parse (problem 1).

A file is cut into tokens and its kinds are matched, as a whole, against the parsing-expression
grammar of its language (``java_grammar``, ``python_grammar``, ``data_grammars``): packrat within a
file, and for simple statements a content memo across the files of a worker. The furthest failing
position gives line and cause. One pass over the files, no shuffle; rates need one aggregation.

Languages: the extension of the name in any letter case; a null or blank name is Java; other
extensions have no grammar, their files are in no case and have a null ``valid``.

Defined results: null contents have a null ``valid`` and count in no rate; an empty content is a
valid Java unit and Python module, and no JSON value or XML document; rows repeated come out
repeated; nesting has no limit of its own: a file that exhausts the memory of the parser has a null
``valid`` and the cause ``not_parsed``, it is in no case and in no rate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONFLICT = re.compile(r"^(?:<<<<<<<|>>>>>>>|\|\|\|\|\|\|\|)(?: |$)|^=======$", re.MULTILINE)
LANGUAGES = ("java", "py", "json", "xml")


def language(name: Column) -> Column:
    """Language of a file name."""
    ext = F.lower(F.regexp_extract(F.trim(name), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(name.isNull() | (F.trim(name) == ""), "java").when(ext.isin(*LANGUAGES), ext)


def failure(lang: str, text: str) -> int:
    """-1 if the text follows the grammar of the language as a whole, else the furthest failing character."""
    from millrace.llm import data_grammars, java_grammar, python_grammar

    if lang == "json":
        return data_grammars.Json.failure(text)
    if lang == "xml":
        return data_grammars.Xml.failure(text)
    g = java_grammar if lang == "java" else python_grammar
    n = g.grammar.failure(g.kinds(text))
    return -1 if n < 0 else min(g.place(text, n), len(text))


def cause(lang: str, text: str, at: int) -> str:
    """conflict (a conflict marker stands at or just before the failure), wrong_extension (another grammar accepts
    the file), truncated (it fails at its end) or syntax."""
    begin = text.rfind("\n", 0, at) + 1
    before = text.rfind("\n", 0, max(begin - 1, 0)) + 1
    end = text.find("\n", at)
    if _CONFLICT.search(text[before : len(text) if end < 0 else end]):
        return "conflict"
    for other in LANGUAGES:
        if other != lang and text.strip() and failure(other, text) < 0:
            return "wrong_extension"
    return "truncated" if not text[at:].strip() else "syntax"


def checked_files(artifacts: DataFrame, keep: tuple[str, ...] = ("repository",)) -> DataFrame:
    """artifact_id, kept columns, language, valid, fail_at (character), fail_line, cause."""
    src = artifacts.select("artifact_id", *keep, language(F.col("original_filename")).alias("language"), F.col("content").alias("__text"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            valid, at, line, why = [], [], [], []
            for lang, text in zip(b["language"], b["__text"], strict=True):
                p, w = -1, None
                if lang is None or text is None:
                    valid.append(None)
                else:
                    try:
                        p = failure(lang, text)
                        w = cause(lang, text, p) if p >= 0 else None
                        valid.append(p < 0)
                    except (RecursionError, MemoryError):
                        p, w = -1, "not_parsed"
                        valid.append(None)
                at.append(None if p < 0 else p)
                line.append(None if p < 0 else text.count("\n", 0, p) + 1)
                why.append(w)
            yield b.drop(columns="__text").assign(valid=pd.Series(valid, b.index, "boolean"), fail_at=pd.Series(at, b.index, "Int64"), fail_line=pd.Series(line, b.index, "Int64"), cause=pd.Series(why, b.index, "object"))

    types = "".join(f"{k} {t}, " for k, t in src.dtypes if k != "__text")
    return src.mapInPandas(check, types + "valid boolean, fail_at bigint, fail_line bigint, cause string")


def found_invalid(artifacts: DataFrame) -> DataFrame:
    """artifact_id of every file that does not parse."""
    return checked_files(artifacts, ()).filter("NOT valid").select("artifact_id").distinct()


def invalid_rates(checked: DataFrame) -> DataFrame:
    """repository, language, files, invalid, share, and the number of invalid files by cause."""
    by = checked.filter("valid IS NOT NULL").groupBy("repository", "language")
    causes = [F.count_if(F.col("cause") == c).alias(c) for c in ("conflict", "truncated", "wrong_extension", "syntax")]
    return by.agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), *causes).withColumn("share", F.col("invalid") / F.col("files"))
