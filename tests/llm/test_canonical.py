from pyspark.sql.functions import expr

from millrace.llm import canonical

TAX = [(0, "c", 0, "Barrier Coalescing"), (0, "c", 1, "Counted Loop Recognition"), (1, "d", 0, "Stack Placement of Objects"), (1, "d", 1, "Strip Mining")]
ALIAS = [("tiling", "Strip Mining"), ("ccp walk", "Counted Loop Recognition")]
MEANT = {
    "barrier coalescing": 0, "BarrierCoalescing": 0, "Coalescing of Barrier": 0, "Barier Coalescign": 0, "PhaseBarrierCoalescing": 0, '"Barrier Coalescing"': 0,
    "C2 barrier coalescing": 0, "Barrier_Coalescing": 0, "Barrier Coalesced": 0, "CLR": 1, "C.L.R.": 1, "Counted Loop Recog.": 1, "ccp_walk": 1, "the counted loop recognition (C2)": 1,
    "Recognition Loop Counted": 1, "PhaseStackPlacementofObjects": 2, "Placement of Objects of Stack": None, "stack placement of objectss": 2, "TILING": 3, "Strip Mine": 3, " Strip Mining\n": 3,
    "build script timeout": None, "misc": None, "?": None, "unknown": None, "loop tree printer typo": None,
}


def tables(spark, values, inter=None):
    rows = [(k, v, inter) for k, v in enumerate(values)]
    r = spark.createDataFrame(rows, "response_no bigint, Primary_Faulty_Optimization string, Interacting_Optimizations array<string>").selectExpr("*", "'x' AS pass", "1 AS value", "2 AS pos", "'f' AS field")
    return r, spark.createDataFrame(TAX, "category_ord int, category string, pass_ord int, pass string"), spark.createDataFrame(ALIAS, "alias string, pass string")


def test_meanings(spark):
    values = [v for v in MEANT if v != "Placement of Objects of Stack"]
    got = {r["value"]: r["pass"] for r in canonical.canonical_entries(*tables(spark, values)).collect()}
    assert got == {v: "UNMATCHED" if MEANT[v] is None else TAX[MEANT[v]][3] for v in values}


def test_cases_and_positions(spark):
    r, t, a = tables(spark, [None, "", " \t", "Unknown", "Strip Mining", "strip mining", "strip mining"], [None, "", "Barrier Coalescing", "tilling", "Unknown", "misc"])
    got = sorted((x["response_no"], x["field"], x["pos"], x["pass"]) for x in canonical.canonical_entries(r, t, a).collect())
    primary = [x for x in got if x[1].startswith("P")]
    assert primary == [(5, "Primary_Faulty_Optimization", 0, "Strip Mining"), (6, "Primary_Faulty_Optimization", 0, "Strip Mining")]
    assert [x[2:] for x in got if x[1].startswith("I") and x[0] == 3] == [(4, "Strip Mining"), (6, "UNMATCHED")]
    assert [tuple(x) for x in canonical.unmatched_report(r, t, a).collect()] == [("misc", 7)]


def test_empty_and_long(spark):
    r, t, a = tables(spark, ["x" * 100_000, "strip mining"])
    assert {x["pass"] for x in canonical.canonical_entries(r, t, a).collect()} == {"UNMATCHED", "Strip Mining"}
    assert {x["pass"] for x in canonical.canonical_entries(r, t.limit(0), a).collect()} == {"UNMATCHED"}
    assert canonical.canonical_entries(r.limit(0), t, a).count() == 0


def test_segments_find_every_pair_within_k(spark):
    """The equality join against brute force on random edits."""
    import random

    rng = random.Random(5)
    words, values = [x[3] for x in TAX], set()
    for w in words:
        for _ in range(60):
            s = list(w.lower())
            for _ in range(rng.randint(1, 5)):
                k = rng.randrange(len(s))
                op = rng.random()
                s[k : k + 1] = [] if op < 0.35 else [rng.choice("abcxyz")] if op < 0.7 else [s[k], rng.choice("abcxyz")]
            values.add("".join(s))
    r, t, a = tables(spark, sorted(values))
    entries = spark.createDataFrame([(v,) for v in sorted(values)], "value string")
    forms = spark.sql(canonical.FORMS, taxonomy=t, aliases=a)
    vals = spark.sql(canonical.VALUES, entries=entries)
    found = spark.sql(canonical.PROBES, forms=forms, vals=vals).alias("p").join(spark.sql(canonical.SEGMENTS, forms=forms).alias("s"), ["len", "i", "seg"]).selectExpr("p.value", "s.form").distinct()
    brute = vals.join(forms.selectExpr("form AS f", "k"), expr("levenshtein(form, f) <= k")).selectExpr("value", "f AS form").distinct()
    assert brute.count() > 100 and brute.exceptAll(found.join(brute, ["value", "form"])).count() == 0
