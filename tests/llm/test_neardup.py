import random
from dataclasses import replace

import numpy as np
import pytest

from pyspark.sql import functions as F

from millrace.llm import history, neardup
from millrace.session import fresh_path
from millrace.llm.shingles import Similarity, bucket_pairs, least_matches, minhash, prefix_pairs, shingle_hashes, short_signature, survivors

SIM = Similarity()


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int, int, str | None]]:
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randint(0, 30))
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6 and rows[-1][2]:
            t = rng.choice(rows)[2].split()
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], [word()], [t[at], word()]])
        else:
            t = [word() for _ in range(rng.randint(30, 120))]
        rows.append((k, k // 12, "  ".join(t)))
    return rows


def brute(rows, t=0.6):
    sets = {i: set(shingle_hashes(x, SIM).tolist()) for i, _, x in rows if x}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def frame(spark, rows):
    return spark.createDataFrame(rows, "artifact_id bigint, batch_no int, content string").selectExpr("*", "'z' AS id", "1 AS a", "2 AS b", "3 AS n", "4 AS cls", "5 AS text", "6 AS rep", "7 AS key")


EDGES = [(900, 0, None), (901, 1, ""), (902, 1, " \n "), (903, 2, "a b c d"), (904, 3, "a b c d"), (905, None, "x y z w v u t")]


def test_pairs_match_brute_force(spark):
    rows = corpus()
    got = [tuple(r) for r in neardup.found_pairs(frame(spark, rows + EDGES + rows[:3])).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("hot", [1, 500])
def test_hot_buckets_lose_nothing(spark, hot):
    rows = corpus(2, 40)
    sim = replace(SIM, hot=hot)
    assert {tuple(r) for r in neardup.found_pairs(frame(spark, rows), sim).collect()} == brute(rows)
    bn = {i: b for i, b, _ in rows}
    best = {}
    for a, b in brute(rows):
        for x, y in ((a, b), (b, a)):
            if bn[x] < bn[y]:
                best[y] = min(best.get(y, x), x)
    assert {tuple(r) for r in history.found_earlier(frame(spark, rows + EDGES), sim).collect()} == {(x, y) for y, x in best.items()}


@pytest.mark.parametrize("part", [3, 2000])
def test_copies_and_classes(spark, monkeypatch, part):
    monkeypatch.setattr(neardup, "PART", part)
    t = " ".join(f"w{k}" for k in range(40))
    rows = [(k, k % 3, t if k < 30 else t + f" x{k}") for k in range(33)]
    assert {tuple(r) for r in neardup.found_pairs(frame(spark, rows)).collect()} == {(a, b) for a in range(33) for b in range(a + 1, 33)}
    c = {r["artifact_id"]: (r["class_id"], r["copies"], r["links"]) for r in neardup.found_classes(frame(spark, rows)).collect()}
    assert c[29] == (0, 30, 3) and c[32] == (32, 1, 3)


def test_empty_and_long(spark):
    empty = frame(spark, corpus()[:1]).limit(0)
    assert neardup.found_pairs(empty).count() == 0 and history.found_earlier(empty).count() == 0
    rng = random.Random(3)
    long = " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(120_000))
    got = neardup.found_pairs(frame(spark, [(1, 0, long), (2, 1, long + " end of it"), (3, 1, long[: len(long) // 3])])).collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def test_history_batch_by_batch(spark):
    """One batch a call gives what one call for all gives; tables grow, are opened again, and are joined or looked up."""
    rows = corpus(4)
    df = frame(spark, rows + EDGES + rows[:2])
    want = {tuple(r) for r in history.found_earlier(df).collect()}
    assert want
    for settings in ({"pushed": 0}, {"page_rows": 0, "pushed": 4096, "keys_a_bucket": 30}):
        path, got = fresh_path(spark, "h"), set()
        for number in sorted({b for _, b, _ in rows}):
            h = history.History(spark, path, SIM, **settings)  # opened again, it goes on where it was
            got |= {tuple(r) for r in h.check(df.filter(f"batch_no = {number}"), "artifact_id", "content", "batch_no").collect()}
        assert got == want, settings
        assert h.keys().count() == h.state["keys"] and h.records().select("id").distinct().count() * SIM.bands == h.state["keys"]
        assert any(t.name.startswith("millrace_keys") for t in spark.catalog.listTables())
        h.close()
        assert history.History(spark, path, SIM).keys().count() == h.state["keys"]
        assert (h.state["version"] > 0) == ("keys_a_bucket" in settings)


def test_ids_that_do_not_rise(spark):
    t = " ".join(f"w{k}" for k in range(40))
    h = history.History(spark, fresh_path(spark, "h"), SIM)
    for number, ids in ((0, [50]), (1, [20, 60]), (2, [70, 10])):
        df = spark.createDataFrame([(i, number, t) for i in ids], "artifact_id bigint, batch_no int, content string")
        found = {tuple(r) for r in h.check(df, "artifact_id", "content", "batch_no").collect()}
        assert found == {0: set(), 1: {(50, 20), (50, 60)}, 2: {(20, 70), (20, 10)}}[number]


def _read(df):
    """Rows that the scan of a plan gave to the rest of it."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.size()))


def test_a_small_batch_reads_little(spark, monkeypatch):
    """Of 100,000 keys and more a batch of one text reads the pages that can hold its keys; a large one is joined bucket by
    bucket, and the history is not shuffled."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(7000)]
    h = history.History(spark, fresh_path(spark, "h"), SIM)
    h.check(spark.createDataFrame([(k, 0, x) for k, x in enumerate(texts)], "artifact_id bigint, batch_no int, content string"), "artifact_id", "content", "batch_no")
    total = h.keys().count()
    assert total == 7000 * SIM.bands
    from millrace.llm.shingles import signatures

    one = spark.createDataFrame([(8000, texts[7])], "id bigint, text string")
    keys = [r[0] for r in signatures(one, "id", "text", SIM).selectExpr("explode(bands)").collect()]
    few = h.picked("keys", ["key", "n", "id"], spark.createDataFrame([(k,) for k in keys], "key bigint"))
    assert few.count() >= 64
    # The scans themselves: one for each group of buckets, with the keys that belong there.
    monkeypatch.setattr(history, "written", lambda df, name: df)
    assert _read(h.picked("keys", ["key", "n", "id"], spark.createDataFrame([(k,) for k in keys], "key bigint"))) <= 0.05 * total
    monkeypatch.undo()
    many = spark.createDataFrame([(k,) for k in range(100_000)] + [(k,) for k in keys], "key bigint")
    joined = h.picked("keys", ["key", "n", "id"], many)
    assert {r["id"] for r in joined.collect()} == {7}
    plan = joined._jdf.queryExecution().toString()
    side = plan[plan.index("Physical Plan") :].split("ShuffledHashJoin")[1]
    assert side.count("Exchange hashpartitioning(key") == 1 and "Bucketed: true" in plan, plan
    assert {tuple(r) for r in h.check(spark.createDataFrame([(8000, 1, texts[7])], "artifact_id bigint, batch_no int, content string"), "artifact_id", "content", "batch_no").collect()} == {(7, 8000)}


def test_token_hashes_follow_the_pattern():
    """One hash for each token of the pattern, equal for equal tokens and for no others."""
    import re

    from millrace.llm.shingles import CODE_TOKENS, code_token_hashes

    rng = random.Random(9)
    texts = ["", " \n\t", "a", "a b\u00a0c\u2003d", "caf\u00e9 \U0001f600\U0001f600x \ud800", "x" * 5000 + " y", "a_b$c1+=(x)--\u0000\x1f", "\ufffe\uffff z"]
    texts += ["".join(rng.choice("ab1_$ +(\n\u00e9\u4e2d\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    seen = {}
    for text in texts:
        tokens, hashes = re.findall(CODE_TOKENS, text), code_token_hashes(text).tolist()
        assert len(tokens) == len(hashes), text
        for t, h in zip(tokens, hashes, strict=True):
            assert seen.setdefault(t, h) == h
    assert len(set(seen.values())) == len(seen) > 300


def test_minhash_estimates_and_pruning():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 600, np.uint64)
    for shared in (200, 450, 560):
        other = np.unique(np.r_[base[:shared], rng.integers(0, 2**63, 600 - shared, np.uint64)])
        j = shared / (1200 - shared)
        a, b = minhash(np.unique(base), SIM), minhash(other, SIM)
        assert abs((a == b).mean() - j) < 0.1
        sig = [np.frombuffer(short_signature(x), np.uint8)[None, :] for x in (a, b)]
        assert survivors(*sig, SIM)[0] == (j > 0.5)
    bounds = least_matches(160, 0.6, 1e-4)
    assert [m for _, m in bounds] == sorted(m for _, m in bounds) and bounds[-1][1] < 0.6 * 160
    assert SIM.recall(0.6) > 0.99 and SIM.recall(0.8) > 0.99999


def test_bucket_stream_keeps_order_of_sides(spark):
    rows = spark.createDataFrame([(1, 10, 5, 0), (1, 10, 4, 1), (1, 10, 6, 0), (2, 10, 7, 0), (2, 30, 8, 1)], "key bigint, n int, id bigint, side int")
    assert {tuple(r) for r in bucket_pairs(rows, SIM).collect()} == {(5, 4, True), (6, 4, True)}
    more = rows.unionByName(spark.createDataFrame([(1, 10, 3, 1)], rows.schema))
    assert {tuple(r) for r in bucket_pairs(more, SIM).collect()} == {(5, 4, True), (6, 4, True), (5, 3, True), (6, 3, True), (3, 4, False)}


def test_prefix_filter_is_exact(spark):
    rows = corpus(6, 50)
    texts = spark.createDataFrame([(i, x) for i, _, x in rows], "id bigint, text string")
    assert brute(rows) <= {tuple(r) for r in prefix_pairs(texts, SIM).collect()}
