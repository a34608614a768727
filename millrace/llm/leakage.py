"""Evaluation texts leaking into training text (problem 8).

The 64-bit hashes of the test items' normalised runs of ``n`` words become a sorted array that is
broadcast, at most ``max_runs`` of them at a time: of more runs the array is made and the documents
are scanned once for each block of hashes, so there is no limit on the items. In a scan every
document is read once, whole, its word windows are hashed as arrays and looked up. Hits carry their
words and are verified by an equality join with the runs of the items, which also gives the items.
Only hits are shuffled. Leaked spans, or documents, can be removed.

Words are maximal runs of ASCII letters and digits without letter case. Tags, character entities
and escape sequences are cut out as white space; because text such as ``a < b`` or ``Map<K>`` can
look like markup, a document with markup signs is also read without cutting, and hits of both
readings count.

Defined results: null and blank documents and items with fewer than ``n`` words have no hits; rows
repeated under one doc_id give each (doc_id, item_id) once; equal items are all reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

WORD = re.compile(r"[A-Za-z0-9]+")
MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|<[!?][^<>]*>|&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});|\\u[0-9A-Fa-f]{4}|\\[nrtbf]|=[0-9A-F]{2}|=\r?\n|%[0-9A-F]{2}")
_MULT = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def readings(text: str) -> list[list[re.Match]]:
    """The words of a text, once or (with markup signs) in both readings; the matches give the places."""
    plain = list(WORD.finditer(text))
    if not MARKUP.search(text):
        return [plain]
    return [list(WORD.finditer(MARKUP.sub(lambda m: " " * len(m[0]), text))), plain]


def words(text: str) -> list[list[str]]:
    """As ``readings``, the words only, in lower case."""
    out = [WORD.findall(text.lower())] if text.isascii() else [[w.lower() for w in WORD.findall(text)]]
    if MARKUP.search(text):
        out.insert(0, [w.lower() for w in WORD.findall(MARKUP.sub(" ", text))])
    return out


def windows(ws: list[str], n: int) -> np.ndarray:
    """Hash of each run of n words."""
    m = len(ws) - n + 1
    if m < 1:
        return np.empty(0, np.uint64)
    t = np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))
    h = t[:m].copy()
    for k in range(1, n):
        h *= _MULT
        h ^= h >> np.uint64(29)
        h += t[k : k + m]
    return h


def item_runs(benchmark: DataFrame, n: int) -> DataFrame:
    """h, run, item_id: the distinct runs of n words of each item with their hash."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, text in zip(b["item_id"], b["text"], strict=True):
                held = {(h, " ".join(ws[at : at + n])) for ws in words(text) for at, h in enumerate(windows(ws, n).view(np.int64).tolist())}
                rows += [(h, run, item) for h, run in held]
            yield pd.DataFrame(rows, columns=["h", "run", "item_id"])

    return benchmark.select("item_id", "text").filter("text IS NOT NULL AND item_id IS NOT NULL").mapInPandas(cut, "h bigint, run string, item_id bigint").distinct()


class RunSet:
    """A sorted array of run hashes, with a table of their first bits that settles most look-ups."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.sort(hashes.view(np.uint64))
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.sorted >> np.uint64(44)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where an array of hashes holds one of the set."""
        if not len(h) or not len(self.sorted):
            return np.empty(0, np.int64)
        maybe = np.flatnonzero(self.mask[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
        return maybe[self.sorted[at] == h[maybe]]


#: Run hashes broadcast at a time (8 bytes each).
MOST_RUNS = 4_000_000


def hits(documents: DataFrame, runs: DataFrame, n: int, max_runs: int, spans: bool) -> DataFrame:
    """doc_id, run of every run of a document whose hash is that of an item's run; with spans also text_hash, begin and
    end. One scan of the documents for each block of at most about ``max_runs`` hashes."""
    sc = documents.sparkSession.sparkContext
    distinct = runs.select("h").distinct()
    blocks = -(-distinct.count() // max_runs)
    src = documents.select("doc_id", "text", *([F.xxhash64("text").alias("text_hash")] if spans else [])).filter("text IS NOT NULL" if spans else "text IS NOT NULL AND doc_id IS NOT NULL")
    kind = "doc_id bigint, text_hash bigint, begin bigint, end bigint, run string" if spans else "doc_id bigint, run string"
    out = documents.sparkSession.createDataFrame([], kind)
    for k in range(blocks):
        part = distinct.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == k).toPandas()["h"].to_numpy(np.int64)  # max_runs of them
        held = sc.broadcast(RunSet(part))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            tests = held.value
            for b in batches:
                rows = []
                for r in b.itertuples(index=False):
                    if spans:
                        for ms in readings(r.text):
                            ws = [m[0].lower() for m in ms]
                            rows += [(r.doc_id, r.text_hash, ms[at].start(), ms[at + n - 1].end(), " ".join(ws[at : at + n])) for at in tests.places(windows(ws, n)).tolist()]
                    else:
                        rows += [(r.doc_id, run) for run in {" ".join(ws[at : at + n]) for ws in words(r.text) for at in tests.places(windows(ws, n)).tolist()}]
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

        found = src.mapInPandas(scan, kind)
        out = found if k == 0 else out.unionByName(found)
    return out


def found_leaks(documents: DataFrame, benchmark: DataFrame, n: int = 12, max_runs: int = MOST_RUNS) -> DataFrame:
    """doc_id, item_id: each document with each item of which it holds n consecutive words."""
    runs = written(item_runs(benchmark, n), "runs")
    return hits(documents, runs, n, max_runs, False).join(runs, "run").select("doc_id", "item_id").distinct()


def leaked_items(found: DataFrame) -> DataFrame:
    """item_id with the number of documents that hold part of it."""
    return found.groupBy("item_id").agg(F.count("*").alias("documents"))


def cleaned(documents: DataFrame, benchmark: DataFrame, n: int = 12, max_share: float = 0.5, max_runs: int = MOST_RUNS) -> DataFrame:
    """doc_id, text, removed, dropped: leaked spans cut out; a document of which more than max_share is leaked has
    no text and is marked as dropped."""
    runs = written(item_runs(benchmark, n), "runs")
    found = hits(documents, runs, n, max_runs, True).join(runs.select("run").distinct(), "run", "left_semi")
    # A text is known by its hash here: rows repeated with the same text share their spans.
    spans = found.groupBy("text_hash").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(spans, "text_hash", "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, removed, dropped = [], [], []
            for text, found_ in zip(b["text"], b["spans"], strict=True):
                kept, at, gone = [], 0, 0
                for x in found_ if found_ is not None else ():
                    begin = max(at, x["begin"])
                    if x["end"] > begin:
                        kept.append(text[at:begin])
                        gone, at = gone + x["end"] - begin, x["end"]
                out = bool(gone and gone > max_share * len(text))
                texts.append(None if out else text if not gone else "".join(kept) + text[at:])
                removed.append(gone)
                dropped.append(out)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts, "removed": removed, "dropped": dropped})

    return rows.mapInPandas(cut, "doc_id bigint, text string, removed bigint, dropped boolean")
