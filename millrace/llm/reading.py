"""Reading level of each document (problem 9).

Per document: lexical diversity, rarity of its words in this corpus, connectives, a proxy for the
depth of clauses, and lengths of words and sentences. A regularised ordinal regression (proportional
odds with an offset for each rater) is fitted on at most ``max_labels`` ratings (the rows with the
least hash) and gives every document a level between 1 and 5 that can be compared with ratings.

Corpus counts cover all documents. The word table that is broadcast holds the ``vocabulary`` most
frequent words, so its size has a bound; the counts of all others are joined to the documents that
hold them. Words met once in the corpus are those at the floor, at every size.

Defined results: null and blank texts and texts without a plain word get a null level; ratings
that are null or of unknown documents are not used; without ratings every level is null.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

_WORD = re.compile(r"(?<![\w$./:-])[A-Za-zÀ-ÿ]+(?:[-'’][A-Za-zÀ-ÿ]+)*(?![\w$(/:])")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n\s*\n|\n(?=\s*(?:[-*]|\d+\.)\s)")
_VOWELS = re.compile(r"[aeiouyäöüáéíóú]+")
#: Connectives by kind (English, with the commonest German and Spanish ones).
ADDING = frozenset("and but or so then also plus now und oder aber auch y o pero".split())
SUBORDINATE = frozenset("because although though since unless while whereas until when if before after once provided that which who whose whom where why how whether weil obwohl dass wenn während bevor nachdem porque aunque cuando si que mientras".split())
FORMAL = frozenset("however therefore thus hence thereby moreover furthermore nevertheless notwithstanding insofar consequently accordingly whereby wherein albeit nonetheless conversely namely subsequently jedoch daher folglich dennoch sin embargo además".split())
FEATURES = ("log_words", "word_len", "long8", "long11", "syllables", "many_syllables", "sentence", "sentence_90", "commas", "adding", "subordinate", "formal", "depth", "diversity", "hapax", "rarity", "rarity_75", "outside", "suffixes")
_SUFFIX = re.compile(r"(?:tion|sion|ment|ness|ity|ance|ence|ism|ization|isation|ally|ously|ively|able|ible|ious|ical)s?$")


def plain_words(text: str) -> list[str]:
    """Words that are not identifiers, in lower case."""
    return [w.lower() for w in _WORD.findall(text) if w[1:].islower() or len(w) == 1]


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n over all documents; counted within a batch before the shuffle."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter[str] = Counter()
            for t in b["text"]:
                c.update(plain_words(t))
            yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    return documents.filter("text IS NOT NULL").select("text").mapInPandas(tally, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class WordTable(dict):
    """Length, syllables, bits and kind of each word met (bounded); bits: -log2 of the share of each frequent word."""

    def __init__(self, bits: dict[str, float], floor: float) -> None:
        self.bits, self.floor = bits, floor

    def __missing__(self, w: str) -> tuple[int, int, float, bool, int]:
        if len(self) > 300_000:
            self.clear()
        n = len(_VOWELS.findall(w))
        kind = 1 if w in ADDING else 2 if w in SUBORDINATE else 3 if w in FORMAL else 0
        out = self[w] = len(w), max(1, n - (w.endswith("e") and not w.endswith("le") and n > 1)), self.bits.get(w, self.floor), len(w) > 5 and bool(_SUFFIX.search(w)), kind
        return out


def _quantile(xs: list, q: float) -> float:
    xs = sorted(xs)
    at = q * (len(xs) - 1)
    k = int(at)
    return xs[k] + (at - k) * (xs[min(k + 1, len(xs) - 1)] - xs[k])


def measured(text: str | None, table: WordTable) -> tuple[list[float], list[str], tuple[float, ...]] | None:
    """The features of one text, whole, with its words and their bits."""
    found = [_WORD.findall(s) for s in _SENTENCE.split(text or "")]
    ws = [w.lower() for s in found for w in s if w[1:].islower() or len(w) == 1]
    n = len(ws)
    if not n:
        return None
    sentences = [len(s) for s in found if s]
    k = len(sentences)
    lens, syl, rare, suffix, kind = zip(*map(table.__getitem__, ws), strict=True)
    add, sub, formal = kind.count(1), kind.count(2), kind.count(3)
    commas = text.count(",") + text.count(";")
    c = Counter(ws)
    distinct = sum(len(set(ws[a : a + 50])) for a in range(0, n, 50))  # blocks of 50 words, each by its length
    f = [
        math.log1p(n),
        sum(lens) / n,
        sum(x >= 8 for x in lens) / n,
        sum(x >= 11 for x in lens) / n,
        sum(syl) / n,
        sum(x >= 4 for x in syl) / n,
        math.log1p(n / k),
        math.log1p(_quantile(sentences, 0.9)),
        commas / k,
        add / k,
        sub / k,
        formal / k,
        (sub + formal + commas) / (k + add),
        distinct / n,
        list(c.values()).count(1) / n,
        sum(rare) / n,
        _quantile(rare, 0.75),
        sum(x >= table.floor for x in rare) / n,
        sum(suffix) / n,
    ]
    return f, ws, rare


def features_of(text: str | None, table: WordTable) -> list[float] | None:
    """The features of one text, whole."""
    m = measured(text, table)
    return m and m[0]


def document_features(documents: DataFrame, keep: tuple[str, ...] = (), vocabulary: int = 30_000) -> DataFrame:
    """doc_id, kept columns, f (array of the features, or null)."""
    counts = written(word_counts(documents), "words")
    total, size = counts.agg(F.sum("n"), F.count("*")).head(1)[0]
    total = total or 1
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    floor = math.log2(total)  # the bits of a word met once
    held = documents.sparkSession.sparkContext.broadcast({r["word"]: math.log2(total / r["n"]) for r in top})
    kept = documents.select("doc_id", *keep, "text")
    types = "".join(f"{k} {t}, " for k, t in kept.dtypes if k != "text")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordTable(held.value, floor)
        for b in batches:
            yield b.drop(columns="text").assign(f=[features_of(t, known) for t in b["text"]])

    if size <= vocabulary:
        return kept.mapInPandas(measure, types + "f array<double>")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordTable(held.value, floor)
        for b in batches:
            f, others, edge = [], [], []
            for m in (measured(t, known) for t in b["text"]):
                f.append(m and m[0])
                others.append(m and [w for w in m[1] if w not in known.bits])
                if m:  # words beyond the table are no more frequent than those in it: they are last in order
                    bits, k = sorted(m[2]), int(0.75 * (len(m[2]) - 1))
                    inside = bits[: len(bits) - len(others[-1])]
                    edge.append([float(len(bits)), sum(inside), bits[k], bits[min(k + 1, len(bits) - 1)], float(sum(x >= floor for x in inside))])
                else:
                    edge.append(None)
            yield b.drop(columns="text").assign(f=f, others=others, edge=edge)

    # Written: the number of a row must not change between its uses.
    parts = written(kept.withColumn("__row", F.monotonically_increasing_id()).mapInPandas(part, types + "__row bigint, f array<double>, others array<string>, edge array<double>"), "parts")
    met = parts.select("__row", F.explode("others").alias("word")).join(counts, "word")
    rest = met.groupBy("__row").agg(F.collect_list("n").alias("rest"))
    at_rarity, at_75, at_floor = (FEATURES.index(x) for x in ("rarity", "rarity_75", "outside"))

    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, edge, ns in zip(b["f"], b["edge"], b["rest"], strict=True):
                if f is not None and ns is not None:
                    f, bits, n = list(f), sorted(math.log2(total / x) for x in ns), int(edge[0])
                    at, known = 0.75 * (n - 1), n - len(bits)
                    k = int(at)
                    x, y = (v if j < known else bits[j - known] for j, v in ((k, edge[2]), (min(k + 1, n - 1), edge[3])))
                    f[at_rarity], f[at_75], f[at_floor] = (edge[1] + sum(bits)) / n, x + (at - k) * (y - x), (edge[4] + sum(x >= floor for x in bits)) / n
                out.append(f)
            yield b.drop(columns=["edge", "rest"]).assign(f=out)

    joined = parts.drop("others").join(rest, "__row", "left").drop("__row")
    return joined.select("doc_id", *keep, "f", "edge", "rest").mapInPandas(complete, types + "f array<double>")


class OrdinalModel:
    """Proportional odds: P(level > k) = sigmoid(x.w + rater - cut_k), ridge on w and raters."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> None:
        self.mean, self.scale, self.w, self.cuts = mean, scale, w, cuts

    def level(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.scale, -4, 4) @ self.w
        return 1 + (1 / (1 + np.exp(self.cuts[None, :] - z[:, None]))).sum(axis=1)


def fit(f: np.ndarray, level: np.ndarray, rater: np.ndarray, ridge: float = 1.0, steps: int = 1500, levels: int = 5) -> OrdinalModel:
    """Fit by gradient steps with momentum on the whole (bounded) sample."""
    mean, scale = f.mean(axis=0), f.std(axis=0) + 1e-9
    x = np.clip((f - mean) / scale, -4, 4)
    _, who = np.unique(rater.astype(str), return_inverse=True)
    raters = np.eye(who.max() + 1)[who]
    above = (level[:, None] > np.arange(1, levels)[None, :]).astype(float)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    p = np.concatenate([np.zeros(x.shape[1] + raters.shape[1]), [-np.log(share[0] / (1 - share[0]))], np.log(np.maximum(np.diff(-np.log(share / (1 - share))), 1e-2))])
    n, d, r = len(x), x.shape[1], raters.shape[1]
    both = np.hstack([x, raters])
    m = np.zeros_like(p)
    v = np.zeros_like(p)
    for step in range(1, steps + 1):
        w, first, gaps = p[: d + r], p[d + r], np.exp(p[d + r + 1 :])
        cuts = first + np.concatenate([[0], np.cumsum(gaps)])
        z = both @ w
        s = 1 / (1 + np.exp(np.clip(cuts[None, :] - z[:, None], -30, 30)))  # P(level > k)
        edge = np.hstack([np.ones((n, 1)), s, np.zeros((n, 1))])
        k = level - 1
        at = np.arange(n)
        prob = np.maximum(edge[at, k] - edge[at, k + 1], 1e-12)
        slope = np.hstack([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))])
        dz = (slope[at, k] - slope[at, k + 1]) / prob
        dcut = np.zeros((n, levels + 1))
        dcut[at, k] -= slope[at, k] / prob
        dcut[at, k + 1] += slope[at, k + 1] / prob
        dc = dcut[:, 1:levels].sum(axis=0)
        g = np.concatenate([-(both.T @ dz) + ridge * w, [-dc.sum()], [-dc[j + 1 :].sum() * gaps[j] for j in range(levels - 2)]]) / n
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        p -= 0.05 * (0.5 + 0.5 * math.cos(math.pi * step / steps)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w = p[: d + r]
    cuts = p[d + r] + np.concatenate([[0], np.cumsum(np.exp(p[d + r + 1 :]))])
    weight = raters.mean(axis=0)
    return OrdinalModel(mean, scale, w[:d], cuts - float(weight @ w[d:]))


def training_sample(feats: DataFrame, labels: DataFrame, max_labels: int = 20_000) -> pd.DataFrame:
    """f, level, rater of at most max_labels ratings: those with the least hash."""
    some = labels.filter("level BETWEEN 1 AND 5 AND doc_id IS NOT NULL").select("doc_id", "rater", "level").orderBy(F.xxhash64("doc_id", "rater"), "doc_id", "rater", "level").limit(max_labels)
    return some.join(feats.filter("f IS NOT NULL").select("doc_id", "f"), "doc_id").select("doc_id", "f", "level", F.coalesce("rater", F.lit("")).alias("rater")).orderBy("doc_id", "rater", "level").toPandas()


def reading_levels(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("kind", "source", "lang"), max_labels: int = 20_000) -> DataFrame:
    """doc_id, kept columns, level (1 to 5, with fractions), grade (the nearest whole level)."""
    feats = written(document_features(documents, keep), "features")
    sample = training_sample(feats, labels, max_labels)
    if len(sample) < 10 or sample["level"].nunique() < 2:
        level = F.lit(None).cast("double")
    else:
        model = fit(np.stack(sample["f"]), sample["level"].to_numpy(np.int64), sample["rater"].to_numpy(str))
        z = sum(F.least(F.greatest((F.col("f")[k] - float(model.mean[k])) / float(model.scale[k]), F.lit(-4.0)), F.lit(4.0)) * float(model.w[k]) for k in range(len(model.w)))
        level = F.when(F.col("f").isNotNull(), sum((1 / (1 + F.exp(F.lit(float(c)) - F.col("z"))) for c in model.cuts), F.lit(1.0)))
        feats = feats.withColumn("z", z)
    return feats.withColumn("level", level).select("doc_id", *keep, "level", F.round("level").cast("int").alias("grade"))


def profile(levels: DataFrame, by: tuple[str, ...] = ("kind", "source", "lang")) -> DataFrame:
    """Documents, mean level and number of documents of each grade, by the given columns."""
    return levels.groupBy(*by).agg(F.count("*").alias("documents"), F.avg("level").alias("mean_level"), *[F.count_if(F.col("grade") == g).alias(f"grade_{g}") for g in range(1, 6)])
