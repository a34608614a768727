import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import reading

PLAIN = ["the cat is on the mat", "we run the job now", "it stops and we try again", "i see a bug in the log"]
HARD = ["notwithstanding the hierarchical approximation, subsequent canonicalization presupposes irreducibility whereas verification compromises transparency", "a comprehensive formalization would necessitate distinguishing speculative obligations from architecturally constrained commitments, insofar as materialization permits"]


def text(rng, level):
    return ". ".join(rng.choice(HARD if rng.random() < (level - 1) / 4 else PLAIN).capitalize() for _ in range(14)) + "."


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(150):
        level = rng.randint(1, 5)
        docs.append((k, text(rng, level), "kind", "src", "en", level))
        labels.append((k, rng.choice(["a", "b", None]), level if rng.random() < 0.95 else None))
    docs += [(500, None, None, None, None, 0), (501, "", "k", "s", "l", 0), (502, " \n", "k", "s", "l", 0), (503, "123 $$$ {}", "k", "s", "l", 0), (504, "the words go on and on. " * 30_000, "k", "s", "l", 0), (505, docs[0][1], "k", "s", "l", 0), (505, docs[0][1], "k", "s", "l", 0)]
    labels += [(9999, "a", 3), (None, "a", 3), (1, "a", 9)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, kind string, source string, lang string, level int").selectExpr("*", "1 AS f", "2 AS grade", "3 AS word", "4 AS z")
    return d, spark.createDataFrame(labels, "doc_id bigint, rater string, level int"), {k: x[5] for k, *x in ((r[0], *r) for r in docs)}


def test_levels_follow_the_ratings(tables):
    d, labels, truth = tables
    got = reading.reading_levels(d, labels).toPandas().set_index("doc_id")["level"]
    known = [k for k in range(150)]
    assert np.corrcoef([got[k] for k in known], [truth[k] for k in known])[0, 1] > 0.85
    assert got.dropna().between(1, 5).all() and got[[500, 501, 502, 503]].isna().all() and got[504] < 3


def test_profile_no_ratings_and_empty(tables):
    d, labels, _ = tables
    p = reading.profile(reading.reading_levels(d, labels)).toPandas()
    assert p["documents"].sum() == d.count()
    assert reading.reading_levels(d, labels.limit(0)).filter("level IS NOT NULL").count() == 0
    assert reading.reading_levels(d.limit(0), labels).count() == 0


def test_diversity_counts_the_last_words():
    at = reading.FEATURES.index("diversity")
    table = reading.WordTable({}, 1.0)
    same, new = ("word " * 70).strip(), "word " * 50 + " ".join("x" + chr(97 + k) for k in range(20))
    assert reading.features_of(same, table)[at] == 2 / 70 and reading.features_of(new, table)[at] == 21 / 70


def test_rarity_does_not_depend_on_the_table(spark):
    texts = ["alpha beta beta gamma gamma gamma delta.", "gamma zeta eta alpha theta.", "", "once only words here", None, "gamma beta " * 20, "gamma"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0])], "doc_id bigint, text string")
    whole = sorted((tuple(r) for r in reading.document_features(d).collect()), key=str)
    for vocabulary in (1, 3, 6):
        got = sorted((tuple(r) for r in reading.document_features(d, vocabulary=vocabulary).collect()), key=str)
        assert [k for k, _ in got] == [k for k, _ in whole]
        assert all((f is None and g is None) or f == pytest.approx(g) for (_, f), (_, g) in zip(got, whole, strict=True))
    by = dict(whole)
    assert by[3][reading.FEATURES.index("outside")] == 1 and by[6][reading.FEATURES.index("outside")] == 0


def test_model_recovers_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    z = 2 * x[:, 0] - x[:, 1]
    level = 1 + (z[:, None] + rng.logistic(size=(1500, 1)) * 0.5 > np.array([-3, -1, 1, 3])[None, :]).sum(axis=1)
    m = reading.fit(x, level, np.full(1500, "r"))
    assert np.corrcoef(m.level(x), level)[0, 1] > 0.9 and (np.diff(m.cuts) > 0).all()



def test_agreement_with_ratings_held_out(spark):
    """Fitted on the ratings of three quarters of the rated documents of the test data, compared with those of the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "reading_labels"))
    held = labels.filter("level IS NOT NULL AND pmod(xxhash64(doc_id), 4) = 0")
    levels = reading.reading_levels(docs, labels.filter("pmod(xxhash64(doc_id), 4) <> 0"))
    got = held.join(levels.filter("level IS NOT NULL").select("doc_id", F.col("level").alias("estimate")), "doc_id").select("level", "estimate").toPandas()
    assert len(got) > 100
    rank = got.rank()
    assert rank["level"].corr(rank["estimate"]) > 0.85
    off = (got["estimate"] - got["level"]).abs()
    grade = (got["estimate"].round() - got["level"]).abs()
    print(f"held out: {len(got)} ratings, rank correlation {rank['level'].corr(rank['estimate']):.3f}, mean error {off.mean():.3f}, same grade {(grade == 0).mean():.3f}, within one {(grade <= 1).mean():.3f}")
    assert off.mean() < 0.45 and (grade <= 1).mean() > 0.95 and (grade == 0).mean() > 0.7
