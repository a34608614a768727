from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import terms


def frame(spark, rows):
    return spark.createDataFrame(rows, "v string, t string").selectExpr("*", "1 AS field", "2 AS suffix", "3 AS n", "4 AS occ", "5 AS term")


def brute(texts, max_n):
    occ, recs = Counter(), Counter()
    for t in texts:
        ws = [w.lower() for w in terms._TERM.findall(t or "")]
        grams = [tuple(ws[k : k + n]) for n in range(1, max_n + 1) for k in range(len(ws) - n + 1)]
        occ.update(grams)
        recs.update(set(grams))
    return {g: (occ[g], recs[g]) for g in occ}


def test_ngrams_match_brute_force(spark):
    texts = ["a b a b a", "a a a a", None, "", "b A_1 b, a!", "x", "a b a b a"] + [f"w{k % 7} w{k % 3} w{k % 5}" for k in range(40)]
    got = {tuple(r["ngram"]): (r["occurrences"], r["records"]) for r in terms.ngram_counts(frame(spark, [(None, t) for t in texts]), (), ("t",), 3).collect()}
    assert got == brute(texts, 3)


def test_ngrams_of_every_length(spark):
    texts = ["a b c d e f g", "b c d e f g", "a b a b a b a b", None, "x", "a b c d e f g", " ".join(f"w{k % 9}" for k in range(30))]
    got = terms.ngram_counts(frame(spark, [(None, t) for t in texts]), (), ("t",)).collect()
    assert {tuple(r["ngram"]): (r["occurrences"], r["records"]) for r in got} == brute(texts, 30) and max(r["n"] for r in got) == 30


def test_query_counts_every_length(spark):
    from millrace.llm import registry

    sf = "/root/testdata/sf0.001"
    values = [r[0] for r in registry.table(spark, sf, "analyze_results").select("Type_Mechanism").collect()]
    want = brute(values, max(len(terms._TERM.findall(v or "")) for v in values))
    got = {(r["ngram"], r["n"]): (r["occurrences"], r["records"]) for r in registry.p4_ngrams(spark, sf).collect()}
    assert got == {(" ".join(g), len(g)): v for g, v in want.items()} and max(n for _, n in got) > 3


def test_report_and_marks(spark):
    rows = [(" C1 ", "the one"), ("c1", "the the"), ("C2", "the two"), (None, None), ("", " "), ("  ", "odd"), ("x", "the")] + [("c1", "the")] * 3
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in terms.term_report(frame(spark, rows), ("v",), ("t",)).collect()}
    assert got[("v", "c1")] == (5, 5, "common") and got[("v", "c2")] == (1, 1, "rare") and got[("t", "the")] == (8, 7, "common") and ("v", "") not in got
    # rare wins where both hold
    small = {(r["term"]): r["mark"] for r in terms.term_report(frame(spark, [("a", None), ("a", None)]), ("v",), ("t",)).collect()}
    assert small == {"a": "rare"}


def test_empty_and_long(spark):
    assert terms.term_report(frame(spark, [("a", "b")]).limit(0), ("v",), ("t",)).count() == 0
    long = " ".join(f"w{k % 1000}" for k in range(50_000))
    got = terms.ngram_counts(frame(spark, [(None, long)]), (), ("t",), 2).filter("n = 1").collect()
    assert len(got) == 1000 and all(r["occurrences"] == 50 and r["records"] == 1 for r in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.integers(1, 4))
def test_shared_prefixes_within_a_record(ws, n):
    """Each n-gram counts once for its record: suffixes that share less than n terms with the one before."""
    count = Counter()
    for s, shared in terms.record_suffixes(ws, n):
        for k in range(shared, len(s)):
            count[s[: k + 1]] += 1
    assert all(v == 1 for v in count.values()) and set(count) == {tuple(ws[k : k + m]) for m in range(1, n + 1) for k in range(len(ws) - m + 1)}
