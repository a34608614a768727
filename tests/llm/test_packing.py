import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.sampled_from([100, 150, 400]), st.integers(1, 8))
def test_nothing_is_lost_and_nothing_overfull(sizes, capacity, block):
    windows = list(packing.pack(iter([(s, k) for k, s in enumerate(sizes)]), capacity, block))
    assert sorted(i[1] for w in windows for i in w) == list(range(len(sizes)))
    assert all(w and sum(i[0] for i in w) <= capacity for w in windows)


def test_differencing_is_balanced():
    rng = random.Random(1)
    sizes = [rng.randint(1, 200) for _ in range(300)]
    sets = packing.differencing(sizes, 10)
    sums = [sum(sizes[k] for k in s) for s in sets]
    assert sorted(k for s in sets for k in s) == list(range(300)) and max(sums) - min(sums) <= 3


def test_every_window_is_as_differencing_made_it(monkeypatch):
    made = set()
    plain = packing.differencing

    def recorded(sizes, m):
        sets = plain(sizes, m)
        made.update(tuple(sorted(sizes[k] for k in s)) for s in sets)
        return sets

    monkeypatch.setattr(packing, "differencing", recorded)
    rng = random.Random(4)
    items = [(min(512, max(1, int(rng.lognormvariate(5, 0.8)))), k) for k in range(3000)]
    counts = {}
    windows = list(packing.pack(iter(items), 512, counts=counts))
    assert all(tuple(sorted(i[0] for i in w)) in made for w in windows)
    assert sum(counts.values()) == len(windows) and counts["full"] > 0.9 * len(windows)
    assert len(windows) <= 1.01 * sum(s for s, _ in items) / 512 + 1


def test_items_that_never_fill_a_window():
    windows = list(packing.pack(iter([(300, k) for k in range(400)]), 512))
    assert len(windows) == 400
    assert list(packing.pack(iter([]), 512)) == []


def test_unused_room():
    rng = random.Random(2)
    sizes = [(min(8192, max(1, int(rng.lognormvariate(5, 1)))), k) for k in range(4000)]
    for capacity in (2048, 8192):
        fit = [s for s in sizes if s[0] <= capacity]
        windows = list(packing.pack(iter(fit), capacity))
        assert len(windows) <= -(-sum(s for s, _ in fit) // capacity) * 1.01 + 1


@pytest.fixture(scope="module")
def packed(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "x", "of", "compiler"]) for _ in range(rng.choice([1, 20, 200, 900])))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "  "), (503, "word " * 5000), (504, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS name", "2 AS tokens", "3 AS piece", "4 AS capacity")
    caps = spark.createDataFrame([("s", 64), ("l", 1000), (None, 5), ("zero", 0), ("none", None)], "name string, n_tokens int")
    out = packing.containers(docs, caps)
    return docs, caps, out.toPandas(), {r["doc_id"]: r["tokens"] for r in packing.token_counts(docs).collect()}


def test_assignment(packed):
    docs, _, out, counts = packed
    assert set(out["name"]) == {"s", "l"} and 500 not in counts and 501 not in counts and counts[502] > 0
    for name, capacity in (("s", 64), ("l", 1000)):
        mine = out[out["name"] == name]
        assert (mine.groupby("container_id")["n_tokens"].sum() <= capacity).all()
        assert mine.groupby("doc_id")["n_tokens"].sum().to_dict() == counts
        for doc, g in mine.groupby("doc_id"):
            g = g.sort_values("piece")
            assert len(g) == 1 if counts[doc] <= capacity else (g["n_tokens"].iloc[:-1] == capacity).all()
            assert list(g["first_token"]) == [k * capacity for k in range(len(g))]


def test_report_and_empty(spark, packed):
    docs, caps, _, _ = packed
    r = packing.fill_report(packing.containers(docs, caps), caps).collect()
    assert {x["name"] for x in r} == {"s", "l"} and all(0 <= x["unused"] < 0.2 for x in r)
    assert packing.containers(docs.limit(0), caps).count() == 0
    assert {tuple(x) for x in packing.audit(packing.containers(docs, caps), caps).collect()} == {("s", 123, 0, 0, 0), ("l", 123, 0, 0, 0)}


def test_many_sizes_and_bad_vocabulary(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")
    caps = spark.createDataFrame([(f"c{k}", 3 + k) for k in range(1001)], "name string, n_tokens int")
    assert packing.containers(docs, caps).select("name").distinct().count() == 1001
    big = tmp_path / "v"
    big.write_bytes(b"x" * 20)
    monkeypatch.setattr(packing, "MOST_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        packing.vocabulary_bytes(str(big))
