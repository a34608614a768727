"""Token runs, MinHash signatures and the Bayesian pruning of pairs, shared by the near-duplicate operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.session import written

#: Code tokens: runs of ASCII letters, digits, _ and $; every other character that is not white space.
CODE_TOKENS = r"[A-Za-z0-9_$]+|[^\sA-Za-z0-9_$]"
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Similarity:
    """Parameters of a near-duplicate search: token pattern, words a run, threshold, bands x rows, pruning tolerance."""

    pattern: str = CODE_TOKENS
    width: int = 5
    threshold: float = 0.6
    bands: int = 64
    rows: int = 5
    tolerance: float = 1e-4
    hot: int = 500
    seed: int = 7

    def recall(self, j: float) -> float:
        """Chance that a pair of similarity j shares a band."""
        return 1 - (1 - j**self.rows) ** self.bands


class _Hashes(dict):
    """64-bit hashes of tokens, bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token)
        return h


_hashes = _Hashes()


@lru_cache(maxsize=8)
def _finder(pattern: str):
    return re.compile(pattern).findall


_SPACE, _WORD = 1, 2
#: Class of each character of the basic plane: white space, part of a run of CODE_TOKENS, or a token of its own.
_CLASSES = np.zeros(1 << 16, np.uint8)
_CLASSES[[k for k in range(1 << 16) if re.match(r"\s", chr(k))]] = _SPACE
_CLASSES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$"]] = _WORD
_BASE = 0x5851F42D4C957F2D


class _Powers:
    """Powers of an odd number modulo 2^64, as many as were needed so far."""

    def __init__(self) -> None:
        self.held = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            steps = np.full(max(n, 2 * len(self.held)), _BASE, np.uint64)
            steps[0] = 1
            self.held = np.multiply.accumulate(steps)
        return self.held


_powers = _Powers()


def code_token_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each token of CODE_TOKENS, in order: a polynomial over its characters, computed for all at once.

    Tokens that differ in one character have different hashes; others are equal by accident only.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASSES[np.minimum(c, 0xFFFF)]  # beyond the basic plane no character is white space or part of a word
    word = kind == _WORD
    begins = kind != _SPACE
    begins[1:] &= ~(word[1:] & word[:-1])
    inside = np.flatnonzero(kind != _SPACE)
    at = np.flatnonzero(begins[inside])
    if not len(at):
        return np.empty(0, np.uint64)
    lengths = np.diff(at, append=len(inside))
    offset = np.arange(len(inside)) - np.repeat(at, lengths)
    h = np.add.reduceat((c[inside].astype(np.uint64) + np.uint64(1)) * _powers.upto(int(lengths.max()))[offset], at)
    h ^= h >> np.uint64(32)
    h *= _MULT
    h ^= h >> np.uint64(29)
    return h


def shingle_hashes(text: str | None, sim: Similarity) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` tokens; empty if there are fewer tokens."""
    if sim.pattern == CODE_TOKENS:
        t = code_token_hashes(text or "")
    else:
        tokens = _finder(sim.pattern)(text or "")
        t = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = len(t) - sim.width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = t[:n].copy()
    for k in range(1, sim.width):
        h *= _MULT
        h ^= h >> np.uint64(29)
        h += t[k : k + n]
    h *= _MULT
    h ^= h >> np.uint64(32)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


@lru_cache(maxsize=8)
def _constants(bands: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    k = bands * rows
    xor = rng.integers(0, 2**32, k, np.uint32)
    mult = rng.integers(0, 2**31, k, np.uint32) * np.uint32(2) + np.uint32(1)
    mix = rng.integers(0, 2**63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 2**63, bands, np.uint64)
    return xor[:, None], mult[:, None], mix, salt


def minhash(shingles: np.ndarray, sim: Similarity) -> np.ndarray:
    """The least value of each of bands x rows hash functions over a non-empty set."""
    xor, mult, _, _ = _constants(sim.bands, sim.rows, sim.seed)
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):  # in pieces that stay in the cache, however long the text
        v = x[None, at : at + 1024] ^ xor
        v *= mult
        np.minimum(out, v.min(axis=1), out=out)
    return out


def band_keys(mins: np.ndarray, sim: Similarity) -> np.ndarray:
    """One 64-bit key for each band."""
    _, _, mix, salt = _constants(sim.bands, sim.rows, sim.seed)
    h = (mins.reshape(sim.bands, sim.rows).astype(np.uint64) * mix).sum(axis=1, dtype=np.uint64) ^ salt
    h *= _MULT
    h ^= h >> np.uint64(31)
    return h.view(np.int64)


def short_signature(mins: np.ndarray) -> bytes:
    """One byte of every second MinHash value, for pruning."""
    v = mins[::2]
    return ((v * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8).tobytes()


def signatures(df: DataFrame, id_col: str, text_col: str, sim: Similarity, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, cls (digest of the set of runs), n, bands, sig. Texts without a run are left out.

    Rows of one cls have equal sets: they are copies for every similarity threshold.
    """
    src = df.select(F.col(id_col).cast("bigint").alias("id"), *[F.col(k) for k in keep], F.col(text_col).alias("__text")).filter("__text IS NOT NULL AND id IS NOT NULL")
    kept = "".join(f"{k} {t}, " for k, t in src.dtypes if k in keep)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, cls, ns, bands, sigs = [], [], [], [], []
            for at, text in enumerate(b["__text"]):
                s = shingle_hashes(text, sim)
                if len(s):
                    m = minhash(s, sim)
                    rows.append(at)
                    cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                    ns.append(len(s))
                    bands.append(band_keys(m, sim))
                    sigs.append(short_signature(m))
            if not rows:  # an empty list has no type that Arrow could turn into arrays
                continue
            out = b.iloc[rows].drop(columns="__text")
            yield out.assign(cls=cls, n=ns, bands=bands, sig=sigs)

    return src.mapInPandas(sign, f"id bigint, {kept}cls binary, n int, bands array<bigint>, sig binary")


# Bayesian pruning


@lru_cache(maxsize=8)
def least_matches(n_hashes: int, threshold: float, tolerance: float, step: int = 16) -> tuple[tuple[int, int], ...]:
    """After each ``step`` bytes compared: the number of equal ones below which the posterior chance that the
    similarity reaches the threshold is under the tolerance. Prior: uniform; a byte of different values is
    equal by accident once in 256."""
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    out = []
    for n in range(step, n_hashes + 1, step):
        for m in range(n + 1):
            w = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(w - w.max())
            if w[j >= threshold].sum() / w.sum() >= tolerance:
                break
        out.append((n, m))
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, sim: Similarity) -> np.ndarray:
    """Which pairs of signatures stay; each step compares 16 more bytes of the pairs still left."""
    left = np.arange(len(a))
    got = np.zeros(len(a), np.int32)
    done = 0
    for n, least in least_matches(a.shape[1], sim.threshold, sim.tolerance):
        got[left] += (a[left, done:n] == b[left, done:n]).sum(axis=1, dtype=np.int32)
        left = left[got[left] >= least]
        done = n
    keep = np.zeros(len(a), bool)
    keep[left] = True
    return keep


def prune(pairs: DataFrame, sigs: DataFrame, sim: Similarity, sigs_b: DataFrame | None = None) -> DataFrame:
    """Of the candidate pairs (a, b), those the Bayesian test leaves; sigs: id, sig of a and b. With ``sigs_b`` (of b alone)
    both have a cls as well, and same tells whether it is equal."""
    side = lambda df, k: df.select(F.col("id").alias(k), F.col("sig").alias(f"sig_{k}"), *([F.col("cls").alias(f"cls_{k}")] if sigs_b is not None else []))
    joined = pairs.join(side(sigs, "a"), "a").join(side(sigs if sigs_b is None else sigs_b, "b"), "b")
    joined = joined.select("a", "b", "sig_a", "sig_b", *([F.expr("cls_a = cls_b").alias("same")] if sigs_b is not None else []))
    kept = ["a", "b"] if sigs_b is None else ["a", "b", "same"]

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            if len(t):
                x, y = (np.frombuffer(b"".join(t[c]), np.uint8).reshape(len(t), -1) for c in ("sig_a", "sig_b"))
                yield t.loc[survivors(x, y, sim), kept]

    return joined.mapInPandas(test, "a bigint, b bigint" + (", same boolean" if sigs_b is not None else ""))


def verify(pairs: DataFrame, texts: DataFrame, sim: Similarity, broadcast_rows: int = 1_000_000, texts_a: DataFrame | None = None) -> DataFrame:
    """Of the pairs (a, b), those whose sets of runs reach the threshold exactly; texts: id, text (of b alone, if those of a
    are given by themselves). Adds similarity.

    Texts that are in no pair are left out before the shuffle if the ids are few enough to broadcast (counted first).
    """
    pairs = written(pairs, "pairs")
    if 2 * pairs.count() <= broadcast_rows:
        texts = texts.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id", "left_semi")
    joined = (
        pairs.join((texts if texts_a is None else texts_a).select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}

        def runs(k: int, text: str) -> np.ndarray:
            if k not in held:
                if len(held) > 3000:
                    held.clear()
                held[k] = shingle_hashes(text, sim)
            return held[k]

        for t in batches:
            a, b, score = [], [], []
            for i, j, x, y in zip(t["a"], t["b"], t["text_a"], t["text_b"], strict=True):
                s, u = runs(i, x), runs(j, y)
                both = len(s) + len(u) - len(np.union1d(s, u)) if min(len(s), len(u)) >= sim.threshold * max(len(s), len(u)) else 0
                either = len(s) + len(u) - both
                if both and both >= sim.threshold * either - 1e-9:
                    a.append(i)
                    b.append(j)
                    score.append(both / either)
            yield pd.DataFrame({"a": a, "b": b, "similarity": score}).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    return joined.mapInPandas(check, "a bigint, b bigint, similarity double")


def bucket_pairs(rows: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) of ids that share a key and may reach the threshold by size; rows: key, n, id and, optionally, side.

    Without sides a < b. With sides (0: old, 1: new) pairs of two old rows do not come out, an old row is a, and old tells
    whether a is one.
    Rows are sorted by key within a task and streamed, so no bucket is held whole: one of more than
    ``sim.hot`` members gives rows (id, null) instead, for ``prefix_pairs``.
    """
    two = "side" in rows.columns
    side = F.col("side").cast("tinyint") if two else F.lit(0).cast("tinyint")
    # Sorted by the key alone, for which Spark has a radix sort; sizes and ids are put in order batch by batch.
    ordered = rows.select("key", "n", "id", side.alias("side")).repartition("key").sortWithinPartitions("key")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: tuple[np.ndarray, ...] | None = None
        hot_key = None

        def marked(ids: np.ndarray, sides: np.ndarray) -> pd.DataFrame:
            return framed(ids, np.full(len(ids), None), sides)

        def framed(a: np.ndarray, b: np.ndarray, sides: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"a": a, "b": b} | ({"old": sides == 0} if two else {})).astype({"b": "Int64"})

        def pairs(key: np.ndarray, n: np.ndarray, i: np.ndarray, s: np.ndarray) -> Iterator[pd.DataFrame]:
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            big = np.repeat(sizes > sim.hot, sizes)
            if big.any():
                yield marked(i[big], s[big])
            live = np.flatnonzero(~big & np.repeat(sizes > 1, sizes))
            step = 1
            while len(live := live[live + step < len(key)]) and len(live := live[key[live] == key[live + step]]):
                live = live[n[live] >= sim.threshold * n[live + step] - 1e-9]  # sizes rise within a key: one too large now stays so
                x = live[(s[live] | s[live + step]) != 0] if two else live
                y = x + step
                first = np.where(s[x] != s[y], s[x] < s[y], i[x] < i[y])
                yield framed(np.where(first, i[x], i[y]), np.where(first, i[y], i[x]), np.minimum(s[x], s[y]))
                step += 1

        for t in batches:
            cols = tuple(t[c].to_numpy() for c in ("key", "n", "id", "side"))
            if rest is not None:
                cols = tuple(np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True))
                rest = None
            if hot_key is not None and len(cols[0]):
                skip = int(np.searchsorted(cols[0], hot_key, side="right"))
                if skip:
                    yield marked(cols[2][:skip], cols[3][:skip])
                    cols = tuple(x[skip:] for x in cols)
            if not len(cols[0]):
                continue
            order = np.lexsort((cols[2], cols[1], cols[0]))
            cols = tuple(x[order] for x in cols)
            hot_key, cut = None, int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            if len(cols[0]) - cut > sim.hot:
                hot_key = cols[0][-1]
                yield marked(cols[2][cut:], cols[3][cut:])
            else:
                rest = tuple(x[cut:] for x in cols)
            if cut:
                yield from pairs(*(x[:cut] for x in cols))
        if rest is not None and len(rest[0]):
            yield from pairs(*rest)

    return ordered.mapInPandas(emit, "a bigint, b bigint" + (", old boolean" if two else ""))


def prefix_pairs(texts: DataFrame, sim: Similarity) -> DataFrame:
    """Every pair (a, b) of texts that can reach the threshold, without loss: two sets of similarity t share one of
    the n - ceil(t n) + 1 runs that are rarest among these texts. The exact way for members of hot buckets."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            held: list[tuple[int, np.ndarray]] = []
            size = 0
            for i, x in zip(t["id"], t["text"], strict=True):
                held.append((i, shingle_hashes(x, sim).view(np.int64)))
                size += len(held[-1][1])
                if size > 500_000:
                    yield framed(held)
                    held, size = [], 0
            if held:
                yield framed(held)

    def framed(held: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        lengths = [len(s) for _, s in held]
        return pd.DataFrame({"id": np.repeat([i for i, _ in held], lengths), "n": np.repeat(np.array(lengths, np.int32), lengths), "run": np.concatenate([s for _, s in held])})

    rows = written(texts.select("id", "text").mapInPandas(runs, "id bigint, n int, run bigint"), "runs")
    df = rows.groupBy("run").agg(F.count("*").alias("df"))
    ranked = rows.join(df.filter("df > 1"), "run").select("id", "n", "run", "df")
    # Runs found in one text only come first in the order and cannot be shared: count them off the prefix.
    alone = rows.groupBy("id").agg(F.first("n").alias("n_all"), F.count("*").alias("c")).select("id", "n_all")
    shared = ranked.groupBy("id").agg(F.count("*").alias("shared"))
    order = W.partitionBy("id").orderBy("df", "run")
    prefix = (
        ranked.withColumn("r", F.row_number().over(order))
        .join(alone.join(shared, "id"), "id")
        .withColumn("p", F.col("r") + F.col("n_all") - F.col("shared"))
        .filter(F.col("p") <= F.col("n_all") - F.ceil(F.lit(sim.threshold) * F.col("n_all") - 1e-9) + 1)
        .select("id", "n", "run", "p")
    )
    a, b = prefix.alias("a"), prefix.alias("b")
    fits = (F.col("a.n") >= sim.threshold * F.col("b.n") - 1e-9) & (F.col("b.n") >= sim.threshold * F.col("a.n") - 1e-9)
    # At the first run that two sets share, what can still be common is bounded by the shorter rest: too little of it is no pair.
    needed = F.ceil(F.lit(sim.threshold / (1 + sim.threshold)) * (F.col("a.n") + F.col("b.n")) - 1e-6)
    fits = fits & (F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p")) + 1 >= needed)
    return a.join(b, (F.col("a.run") == F.col("b.run")) & (F.col("a.id") < F.col("b.id")) & fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
