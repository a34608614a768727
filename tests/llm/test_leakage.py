from millrace.llm import leakage

ITEM = "Let blendSorrel9() return 82 for every long counter update that the stub generator sees this morning, and say why the result is wrong."
OTHER = "one two three four five six seven eight nine ten eleven twelve thirteen"


def frames(spark, docs):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS n")
    b = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, "too short"), (4, None), (5, OTHER), (None, OTHER)], "item_id bigint, text string").selectExpr("*", "7 AS doc_id")
    return d, b


def test_hits(spark):
    w = ITEM.split()
    docs = [
        (1, f"before {ITEM} after"),
        (2, "x " + " ".join(w[2:14]).upper() + " y"),  # 12 words (82 and the name count)
        (3, " ".join(w[:9]) + " but not more"),
        (4, "<p>" + "<br/>\n * ".join(w) + "</p>"),
        (5, "// " + "\n// > ".join(w)),
        (6, "&nbsp;".join(w)),
        (7, None), (8, ""), (9, "   "), (10, "z " * 50_000 + OTHER), (10, "z " * 50_000 + OTHER), (11, OTHER.replace("four", "4our")), (None, OTHER),
        (12, "List<String> a; " + ITEM.replace("long counter", "long <b>counter</b>")),
    ]
    d, b = frames(spark, docs)
    got = sorted(tuple(r) for r in leakage.found_leaks(d, b).collect())
    assert got == [(1, 1), (2, 1), (4, 1), (5, 1), (6, 1), (10, 2), (10, 5), (12, 1)]
    assert {tuple(r) for r in leakage.leaked_items(leakage.found_leaks(d, b)).collect()} == {(1, 6), (2, 1), (5, 1)}


def test_items_in_blocks(spark):
    """More runs than one block takes: several scans, the same result."""
    d, b = frames(spark, [(k, f"a {ITEM} b {OTHER}" if k % 3 else "nothing") for k in range(12)])
    want = sorted(tuple(r) for r in leakage.found_leaks(d, b).collect())
    assert len(want) == 24 and sorted(tuple(r) for r in leakage.found_leaks(d, b, max_runs=3).collect()) == want
    clean = sorted((r["doc_id"], r["text"]) for r in leakage.cleaned(d, b, max_share=1.0).collect())
    assert sorted((r["doc_id"], r["text"]) for r in leakage.cleaned(d, b, max_share=1.0, max_runs=3).collect()) == clean


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(leakage.RunSet, "places", lambda self, h: np.arange(len(h)))
    d, b = frames(spark, [(1, ITEM), (2, "other words than those of any item " * 5)])
    assert {tuple(r) for r in leakage.found_leaks(d, b).collect()} == {(1, 1)}


def test_cleaning(spark):
    d, b = frames(spark, [(1, f"Keep this part of the text, it is long enough to stay where it is for good. {ITEM} " + "and keep this as well. " * 20), (2, OTHER), (3, None), (4, "plain")])
    rows = {r["doc_id"]: r for r in leakage.cleaned(d, b).collect()}
    assert "blendSorrel9" not in rows[1]["text"] and "Keep this part" in rows[1]["text"] and rows[1]["removed"] > 100 and not rows[1]["dropped"]
    assert rows[2]["dropped"] and rows[2]["text"] is None and rows[3]["text"] is None and not rows[3]["dropped"] and rows[4]["text"] == "plain"


def test_empty(spark):
    d, b = frames(spark, [(1, ITEM)])
    assert leakage.found_leaks(d.limit(0), b).count() == 0 and leakage.found_leaks(d, b.limit(0)).count() == 0
