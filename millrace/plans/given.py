"""Queries over given rows, alone or beside a table, so that every branch of an operator is taken; the same rows stand in
their SQL. Sinks are written to the shared folder and read back, scans read a tree of files written there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import extract, text
from millrace.operators import compare, dedup, graph, rank, rules, stats, timeline
from millrace.plans.reference import ORACLES, QUERIES, beside, query, values_sql
from millrace.session import fresh_path, write_text
from millrace.sources import scans, sinks
from millrace.sources.tables import table

c = F.col


def given(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def session_query(sql: str | None = None):
    """Register a function of the session and the data folder."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# texts

_ANSWERS = [(1, "<think>no\nyes</think> {\"a\": 1} "), (2, "text ```json\n[1, 2]\n``` tail"), (3, "```\nplain\n```"), (4, None), (5, " x <THINK>a</THINK>y "), (6, "```JSON {}```")]
_VERSIONS = [(1, "\nPicked up JAVA_TOOL_OPTIONS: -X\n openjdk 17.0.1 \nmore"), (2, "   "), (3, "javac 21"), (4, None)]
_LATEX = [(1, "a_b & 50% #1 {x} $y\\z"), (2, ""), (3, None)]
_URLS = [(1, "https://api.github.com/repos/a/b/issues/1"), (2, "https://api.github.com/repos/c/d?x=1"), (3, "none"), (4, None)]
_LOGS = [(1, "run.log"), (2, "run.log.1"), (3, "run.log.12"), (4, "run.log.x")]
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_BARE = _TRIM.format("regexp_replace(coalesce(x, ''), '(?is)<think>.*?</think>', '', 'g')")


@session_query(rf"""WITH a(k, x) AS ({values_sql(_ANSWERS)}), b AS (SELECT k, {_BARE} AS x FROM a)
SELECT 'answer' AS kind, k, CASE WHEN regexp_matches(x, '(?is)```(?:json)?\s*(.*?)```') THEN {_TRIM.format("regexp_extract(x, '(?is)```(?:json)?\\s*(.*?)```', 1)")} ELSE x END AS y FROM b
UNION ALL SELECT 'version', k, list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '' AND NOT starts_with(l, 'Picked up '))[1] FROM ({values_sql(_VERSIONS)}) v(k, x)
UNION ALL SELECT 'latex', k, replace(replace(replace(replace(replace(replace(replace(replace(x, '\', '\textbackslash{{}}'), '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#'), '_', '\_'), '{{', '\{{'), '}}', '\}}') FROM ({values_sql(_LATEX)}) l(k, x)
UNION ALL SELECT 'repository', k, nullif(regexp_extract(x, '/repos/([^/]+/[^/?#]+)', 1), '') FROM ({values_sql(_URLS)}) u(k, x)
UNION ALL SELECT 'rolled', k, (row_number() OVER (ORDER BY coalesce(try_cast(nullif(regexp_extract(x, '\.(\d+)$', 1), '') AS BIGINT), 0) DESC, k))::VARCHAR FROM ({values_sql(_LOGS)}) r(k, x)""")
def small_texts(spark, sf):
    from pyspark.sql import Window as W

    make = lambda rows: given(spark, rows, "k int, x string")
    parts = {"answer": (_ANSWERS, text.strip_reasoning), "version": (_VERSIONS, text.version_line), "latex": (_LATEX, text.latex), "repository": (_URLS, extract.repository_of)}
    out = [make(rows).select(F.lit(kind).alias("kind"), "k", f(c("x")).alias("y")) for kind, (rows, f) in parts.items()]
    logs = make(_LOGS).select(F.lit("rolled").alias("kind"), "k", F.row_number().over(W.orderBy(rank.rolled_order(c("x")), "k")).cast("string").alias("y"))
    for p in out[1:]:
        out[0] = out[0].unionByName(p)
    return out[0].unionByName(logs)


_RESPONSES = [(1, 'say {"results": [{"a": 1}, 2, {"b": 2}]} ok'), (2, '[{"a": 1}]'), (3, "no"), (4, '```json\n{"results": []}\n```'), (5, '{"other": 1}'), (6, None), (7, '<think>{"results": [{"z": 0}]}</think>{"results": [{"ID": "x"}]}')]


@session_query(rf"""WITH a(k, x) AS ({values_sql(_RESPONSES)}), b AS (SELECT k, {_BARE} AS x FROM a),
s AS (SELECT k, CASE WHEN regexp_matches(x, '(?is)```(?:json)?\s*(.*?)```') THEN {_TRIM.format("regexp_extract(x, '(?is)```(?:json)?\\s*(.*?)```', 1)")} ELSE x END AS x FROM b),
v AS (SELECT k, CASE WHEN json_valid(x) THEN x WHEN json_valid(regexp_extract(x, '(?s)\{{.*\}}', 0)) THEN regexp_extract(x, '(?s)\{{.*\}}', 0) END AS j FROM s),
r AS (SELECT k, CASE WHEN json_type(j) = 'ARRAY' THEN j::JSON WHEN json_type(json_extract(j, '$.results')) = 'ARRAY' THEN json_extract(j, '$.results') END AS l FROM v)
SELECT k, CASE WHEN l IS NOT NULL THEN len(list_filter(CAST(l AS JSON[]), lambda o: json_type(o) = 'OBJECT')) END::INT AS objects, CASE WHEN l IS NOT NULL THEN array_to_string(list_filter(CAST(l AS JSON[]), lambda o: json_type(o) = 'OBJECT')::VARCHAR[], '|') END AS texts FROM r""")
def response_objects(spark, sf):
    x = given(spark, _RESPONSES, "k int, x string").select("k", extract.response_objects(c("x")).alias("o"))
    return x.select("k", F.when(c("o").isNotNull(), F.size("o")).alias("objects"), F.array_join("o", "|").alias("texts"))


@query("""WITH u AS (SELECT doc_id, lang, n_chars AS total, CASE WHEN n_chars > 500 THEN n_chars // 2 END AS cached, kind FROM documents)
SELECT lang, count(*) AS answers, sum(total)::BIGINT AS total, coalesce(sum(cached), 0)::BIGINT AS cached, count(*) FILTER (total IS NULL) AS without FROM u GROUP BY 1""")
def usage_totals(t):
    """Usage objects in JSON, made of the lengths of documents; the count of cached tokens is nested and sometimes absent."""
    n = c("n_chars").cast("string")
    raw = F.when(c("n_chars") > 500, F.concat(F.lit('{"total_tokens": '), n, F.lit(', "prompt_tokens_details": {"cached_tokens": '), F.floor(c("n_chars") / 2).cast("string"), F.lit("}}"))).otherwise(F.coalesce(F.concat(F.lit('{"total_tokens": '), n, F.lit("}")), F.lit("broken")))
    u = t("documents").select("lang", extract.usage_counts(raw).alias("u"))
    return u.groupBy("lang").agg(F.count("*").alias("answers"), F.sum("u.total_tokens").alias("total"), F.coalesce(F.sum("u.cached_tokens"), F.lit(0)).cast("bigint").alias("cached"), F.count_if(c("u.total_tokens").isNull()).alias("without"))


_LINKS = [
    ("JDK-1", '[{"outward":{"key":"JDK-2"},"inward":null,"type":{"outward":"relates to","inward":"x","name":"R"}},{"outward":null,"inward":{"key":" JDK-3 "},"type":{"outward":"","inward":"","name":"Duplicate"}},{"outward":{"key":"CODE-1"},"inward":null,"type":{"outward":"relates to","inward":"","name":""}}]'),
    ("JDK-2", '[{"outward":{"key":"JDK-9"},"inward":{"key":"JDK-8"},"type":{"outward":"blocks","inward":"is Duplicated by","name":"B"}}]'),
    ("JDK-4", "[]"),
    ("JDK-5", None),
]
_LINK_TYPE = '[{"outward":{"key":"VARCHAR"},"inward":{"key":"VARCHAR"},"type":{"outward":"VARCHAR","inward":"VARCHAR","name":"VARCHAR"}}]'


@session_query(f"""WITH g(k, j) AS ({values_sql(_LINKS)}), l AS (SELECT k AS src, unnest(from_json(j, '{_LINK_TYPE}')) AS l FROM g),
s AS (SELECT src, trim(l.outward.key) AS dst, trim(coalesce(nullif(l.type.outward, ''), l.type.name, '')) AS relation FROM l UNION ALL SELECT src, trim(l.inward.key), trim(coalesce(nullif(l.type.inward, ''), l.type.name, '')) FROM l)
SELECT * FROM s WHERE starts_with(dst, 'JDK-') AND (contains(lower(relation), 'relates to') OR contains(lower(relation), 'duplicate'))""")
def related_issues(spark, sf):
    schema = "array<struct<outward:struct<key:string>,inward:struct<key:string>,type:struct<outward:string,inward:string,name:string>>>"
    return extract.related_issues(given(spark, _LINKS, "k string, j string").select("k", F.from_json("j", schema).alias("links")), "k", "links", "JDK-")


_EVENTS = [
    ("i", 0, '{"source": {"issue": {"pull_request": {"u": 1}, "number": 5, "repository_url": "https://api/repos/a/b"}}}', "home/r"),
    ("i", 1, '{"commit_id": "abc", "commit_url": null}', "home/r"),
    ("i", 2, '{"subject": {"type": "PullRequest", "url": "https://api/repos/c/d/pulls/9"}}', "home/r"),
    ("j", 0, "broken", "home/s"),
    ("j", 1, '{"commit_id": "def", "commit_url": "https://api/repos/e/f/commits/def"}', "home/s"),
    ("j", 2, '{"subject": {"type": "Issue", "url": "https://api/repos/c/d/issues/4"}}', "home/s"),
]


@session_query(f"""WITH g(k, pos, e, home) AS ({values_sql(_EVENTS)}), v AS (SELECT k, pos, home, e::JSON AS e FROM g WHERE json_valid(e)),
r AS (SELECT k, pos, 'pull' AS kind, e->>'$.source.issue.repository_url' AS url, e->>'$.source.issue.number' AS ref, home FROM v WHERE json_extract(e, '$.source.issue.pull_request') IS NOT NULL
 UNION ALL SELECT k, pos, 'commit', e->>'$.commit_url', e->>'$.commit_id', home FROM v WHERE e->>'$.commit_id' <> ''
 UNION ALL SELECT k, pos, 'pull', e->>'$.subject.url', regexp_extract(e->>'$.subject.url', '([0-9]+)/*$', 1), home FROM v WHERE e->>'$.subject.type' = 'PullRequest')
SELECT k, pos, kind, coalesce(nullif(regexp_extract(url, '/repos/([^/]+/[^/?#]+)', 1), ''), home) AS repository, ref FROM r WHERE ref <> ''""")
def timeline_refs(spark, sf):
    return extract.timeline_refs(given(spark, _EVENTS, "k string, pos int, e string, home string"), "k", "e", "home")


_TITLES = [(1, "x", "Commit - jdk/Master"), (1, "y", "a backport"), (1, "z", None), (2, "w", "b"), (2, "v", "openjdk/jdk master branch")]


@session_query(f"""WITH g(k, sha, title) AS ({values_sql(_TITLES)}) SELECT k, sha, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN contains(lower(coalesce(title, '')), 'master') THEN 0 ELSE 1 END, coalesce(title, ''), sha) AS place FROM g""")
def fix_order(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("k").orderBy(*rank.fix_order(c("title")), "sha")
    return given(spark, _TITLES, "k int, sha string, title string").select("k", "sha", F.row_number().over(w).cast("bigint").alias("place"))


_BYTES = [(1, "616263"), (2, "EDA080"), (3, "EDA080EDB080"), (4, "F09F9880"), (5, "FF"), (6, "")]


@session_query(f"""WITH g(k, h) AS ({values_sql(_BYTES)}) SELECT k, CASE k WHEN 2 THEN false WHEN 3 THEN false WHEN 5 THEN false ELSE true END AS valid, octet_length(unhex(h))::INT AS bytes FROM g""")
def utf8_check(spark, sf):
    """Bytes of characters, of halves of surrogate pairs and of none; which of them are UTF-8 stands in the SQL."""
    b = F.unhex("h")
    return given(spark, _BYTES, "k int, h string").select("k", rules.valid_utf8(b).alias("valid"), F.octet_length(b).alias("bytes"))


# rules

_VERDICT = "CASE WHEN value > 140 THEN NULL WHEN value > 120 THEN 'ENVIRONMENT_ERROR' WHEN value > 100 THEN 'CRASH' WHEN value > 80 THEN 'MATCH_TIMEOUT' WHEN value > 60 THEN 'DIFFERENCE' WHEN value > 40 THEN 'DIFFERENCE_STDOUT' WHEN value > 20 THEN 'MATCH_FAILURE' ELSE 'MATCH_SUCCESS' END"


@query(f"""WITH v AS (SELECT event_id, {_VERDICT} AS v, event_type IN ('click', 'view') AS compiled, CASE WHEN event_type = 'error' THEN 'COMPILER_SYMBOL_NOT_FOUND' END AS reason FROM events)
SELECT event_id, CASE WHEN v IS NULL OR v = 'ENVIRONMENT_ERROR' THEN CASE WHEN compiled THEN 'COMPILE_FAILED' ELSE 'RAW_ENVIRONMENT_ERROR' END WHEN v IN ('DIFFERENCE', 'DIFFERENCE_STDOUT', 'CRASH') THEN 'RAW_DIFF_FAILURE' WHEN v = 'MATCH_TIMEOUT' THEN 'RAW_TIMEOUT' WHEN v = 'MATCH_FAILURE' AND compiled THEN 'COMPILE_FAILED' END AS rejected,
 v IN ('DIFFERENCE', 'DIFFERENCE_STDOUT', 'CRASH') AS bug, v IN ('MATCH_SUCCESS', 'DIFFERENCE', 'DIFFERENCE_STDOUT', 'CRASH') AS productive, compiled AND coalesce(v = 'MATCH_SUCCESS' AND reason IS DISTINCT FROM 'COMPILER_SYMBOL_NOT_FOUND', false) AS goes_on FROM v""")
def verdict_rules(t):
    """Rejection, bug, productive result and stage gate of verdicts made of event values."""
    x = t("events").select("event_id", F.expr(_VERDICT).alias("v"), c("event_type").isin("click", "view").alias("compiled"), F.when(c("event_type") == "error", "COMPILER_SYMBOL_NOT_FOUND").alias("reason"))
    return x.select("event_id", rules.rejection(c("v"), c("compiled")).alias("rejected"), rules.is_bug(c("v")).alias("bug"), rules.is_productive(c("v")).alias("productive"), rules.stage_gate(c("v"), c("reason"), c("compiled")).alias("goes_on"))


_EVIDENCE = [
    (-1, "Unknown", "NoTaxonomyMatch", "PhaseStringOpts::x", None), (-2, "Unknown", "NoTaxonomyMatch", "Unknown", "in loopPredicate.cpp"), (-3, "Unknown", "NoTaxonomyMatch", "UnswitchCandidate", ""),
    (-4, "Unknown", "NoTaxonomyMatch", "c1_ValueMap does a hoist", "x"), (-5, "Unknown", "NoTaxonomyMatch", "IfNode::fold_compares", None), (-6, "Unknown", "NoTaxonomyMatch", "VectorBox", None),
    (-7, "Unknown", "NoTaxonomyMatch", "macro-logic", None), (-8, "Unknown", "NoTaxonomyMatch", "", "IGVN"), (-9, "Unknown", "InsufficientEvidence", "IGVN", None), (-10, "Inlining", "NoTaxonomyMatch", "IGVN", None), (-11, "Unknown", "NoTaxonomyMatch", "Unknown", None),
]


@query(rf"""WITH a AS (SELECT response_no, coalesce(Primary_Faulty_Optimization, 'Unknown') AS p, Optimization_Unknown_Reason AS r, concat_ws(chr(10), CASE WHEN Faulty_Compiler_Component <> 'Unknown' THEN Faulty_Compiler_Component END, CASE WHEN Root_Cause_Summary <> 'Unknown' THEN Root_Cause_Summary END) AS x FROM (
 SELECT response_no, Primary_Faulty_Optimization, Optimization_Unknown_Reason, Faulty_Compiler_Component, Root_Cause_Summary FROM analyze_results UNION ALL {values_sql(_EVIDENCE)})),
f AS (SELECT *, CASE WHEN NOT coalesce(p = 'Unknown' AND r = 'NoTaxonomyMatch', false) THEN p
 WHEN regexp_matches(x, '(?i)\bPhaseStringOpts\b|\bOptimizeStringConcat\b|\bStringConcat::(?:build_candidate|validate_control_flow|replace_string_concat)\b') THEN 'String Concatenation Optimization'
 WHEN regexp_matches(x, '(?i)\bloop_predication(?:_impl)?\b|\bloopPredicate\.cpp\b|\bloop_predication_should_follow_branches\b') THEN 'Loop Predication'
 WHEN regexp_matches(x, '(?i)\bloopUnswitch\.cpp\b|\bUnswitchCandidate\b|\bloop[_ ]?unswitch(?:ing)?\b') THEN 'Loop Unswitching'
 WHEN regexp_matches(x, '(?i)\bC1 LICM\b|\bloop-invariant code motion\b|\bloop invariant code motion\b|\bc1_ValueMap\b.*\bhoist') THEN 'Loop Invariant Code Motion'
 WHEN regexp_matches(x, '(?i)\bPhaseIdealLoop::(?:do_split_if|split_up|split_thru_phi)\b|\bsplit_if_with_blocks(?:_pre)?\b|\bsplit_thru_phi\b|\bIfNode::fold_compares\b') THEN 'Control Flow Optimization'
 WHEN regexp_matches(x, '(?i)\bPhaseVector::(?:expand_vbox_node_helper|scalarize_vbox_node)\b|\bVectorBox\b|\bscalarize_vbox\b|\bvector-box scalarization\b|\bvector box expansion\b') THEN 'Vector API Optimization'
 WHEN regexp_matches(x, '(?i)\bCompile::compute_(?:logic_cone|truth_table)\b|\boptimize_logic_cones\b|\bMacroLogicV?\b|\bmacro[- ]logic\b') THEN 'Macro Logic Optimization'
 WHEN regexp_matches(x, '(?i)\bPhaseGVN\b|\bPhaseIterGVN\b|\bIGVN\b|\bGVN/IGVN\b') THEN 'Global Value Numbering' ELSE 'Unknown' END AS now FROM a)
SELECT response_no, now AS "primary", coalesce(p = 'Unknown' AND r = 'NoTaxonomyMatch', false) AND now <> 'Unknown' AS inferred, CASE WHEN now <> 'Unknown' THEN 'N/A' ELSE r END AS reason FROM f""")
def inferred_entries(t):
    names = ["response_no", "Primary_Faulty_Optimization", "Optimization_Unknown_Reason", "Faulty_Compiler_Component", "Root_Cause_Summary"]
    x = beside(t("analyze_results").select(*names), _EVIDENCE)
    e = rules.inferred_entry(F.coalesce("Primary_Faulty_Optimization", F.lit("Unknown")), c("Optimization_Unknown_Reason"), c("Faulty_Compiler_Component"), c("Root_Cause_Summary"))
    return x.select("response_no", e.alias("e")).select("response_no", "e.*")


_BATCH, _GOT = [("a",), ("b",), ("c",)], [("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), (None, 4, "n"), ("d", 5, "w")]


@session_query(f"""WITH b(ID) AS ({values_sql(_BATCH)}), r(ID, pos, answer) AS ({values_sql(_GOT)}), l AS (SELECT ID, arg_max(answer, pos) AS answer FROM r WHERE ID IS NOT NULL GROUP BY 1) SELECT b.ID, answer, answer IS NULL AS again FROM b LEFT JOIN l ON b.ID = l.ID""")
def matched_responses(spark, sf):
    ok, retry = rules.matched_responses(given(spark, _BATCH, "ID string"), given(spark, _GOT, "ID string, pos int, answer string"))
    return ok.select("ID", "response.answer", F.lit(False).alias("again")).unionByName(retry.select("ID", F.lit(None).cast("string").alias("answer"), F.lit(True).alias("again")))


@query("""SELECT e.artifact_id, e.issue_id, p.repository AS plan_repository, p.seq AS plan_seq FROM (SELECT artifact_id, issue_id FROM artifacts) e JOIN (SELECT issue_id, arg_min(repository, crawl_seq) AS repository, min(crawl_seq) AS seq FROM issues WHERE repository IS NOT NULL GROUP BY 1) p ON e.issue_id = p.issue_id""")
def planned_results(t):
    """Executions with the first plan of their id: here files and the first crawl of their issue."""
    plans = t("issues").filter("repository IS NOT NULL").select("issue_id", "crawl_seq", c("repository").alias("plan_repository"), c("crawl_seq").alias("plan_seq"))
    return compare.planned(t("artifacts").select("artifact_id", "issue_id"), plans, "crawl_seq", "issue_id")


@query("SELECT issue_id, repository FROM (SELECT DISTINCT issue_id, repository FROM issues) i WHERE NOT EXISTS (SELECT 1 FROM comments m WHERE m.issue_id = i.issue_id AND m.repository = i.repository)")
def uncovered_fixes(t):
    return rules.uncovered(t("issues").select("issue_id", "repository").distinct(), t("comments").select("issue_id", "repository"), ["issue_id", "repository"])


@query("SELECT count(*) AS items, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS average, floor(sum(n_chars) / 4)::BIGINT AS rough_tokens, round(count(*) / count(DISTINCT source), 6) AS per_batch FROM documents")
def size_report(t):
    x = stats.size_report(t("documents"), c("n_chars"), c("source"))
    return x.select("items", "chars", F.round("average", 6).alias("average"), "rough_tokens", F.round("per_batch", 6).alias("per_batch"))


@query("""SELECT status, kind, count(DISTINCT l.issue_id) AS cases FROM (SELECT DISTINCT issue_id, lower(trim(status, ' ')) AS status FROM issues) l JOIN (SELECT DISTINCT issue_id, extraction AS kind FROM artifacts) r ON l.issue_id = r.issue_id GROUP BY 1, 2""")
def crosstab(t):
    return stats.crosstab(t("issues").select("issue_id", F.lower(F.trim("status")).alias("status")), t("artifacts").select("issue_id", c("extraction").alias("kind")), "issue_id", "status", "kind")


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS r FROM d)
SELECT l_orderkey AS case_id, l_returnflag AS feature, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM r WHERE r <= 2 GROUP BY 1, 2""")
def feature_lines(t):
    """The first two lines of each feature of a case (a limit of the export, ten by default)."""
    occ = t("lineitem").select(c("l_orderkey").alias("case_id"), c("l_returnflag").alias("feature"), c("l_linenumber").alias("line"), c("l_partkey").alias("seq"))
    return stats.feature_lines(occ, most=2)


_COVER = [("t1", "SF:/src/hotspot/share/opto/a.cpp\nDA:1,0\nDA:2,5\nend_of_record\nSF:/src/lib/y.c\nDA:1,1\nend_of_record\nDA:9,9"), ("t2", "SF:/src/hotspot/share/opto/a.cpp\nDA:1,2\nDA:3,0\nend_of_record\nSF:/src/hotspot/cpu/b.cpp\nDA:7,0\nend_of_record")]


@session_query(f"""WITH f(file, x) AS ({values_sql(_COVER)}), l AS (SELECT file, unnest(string_split(x, chr(10))) AS t, unnest(range(0, len(string_split(x, chr(10))))) AS k FROM f),
p AS (SELECT *, last_value(CASE WHEN starts_with(t, 'SF:') THEN t[4:] WHEN t = 'end_of_record' THEN '' END IGNORE NULLS) OVER (PARTITION BY file ORDER BY k) AS path FROM l),
h AS (SELECT path, split_part(t[4:], ',', 1)::INT AS line, sum(split_part(t[4:], ',', 2)::INT) AS hits FROM p WHERE starts_with(t, 'DA:') AND contains(path, '/src/hotspot/') GROUP BY 1, 2)
SELECT regexp_extract(path, '/src/hotspot/([^/]+)/', 1) AS component, count(*) AS lines, count(*) FILTER (hits > 0) AS hit FROM h GROUP BY 1""")
def coverage_rollup(spark, sf):
    return scans.coverage(scans.coverage_lines(given(spark, _COVER, "file string, text string")), "/src/hotspot/", "/src/hotspot/([^/]+)/")


# time

_SAMPLES = [("a", k, v) for k, v in enumerate([0.99, 0.98, 0.99, 0.5, 0.98, -1.0, 0.99, 0.99, 0.99, 0.99])] + [("b", 0, 0.99), ("b", 1, 0.97)]


@session_query(f"""WITH g(host, k, cpu) AS ({values_sql(_SAMPLES)}), r AS (SELECT *, sum(CASE WHEN cpu < 0.98 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY k) AS run FROM g),
n AS (SELECT *, sum(CASE WHEN cpu >= 0.98 THEN 1 ELSE 0 END) OVER (PARTITION BY host, run ORDER BY k) AS n FROM r) SELECT host, k FROM n WHERE cpu >= 0.98 AND n % 2 = 0""")
def emergency_steps(spark, sf):
    return timeline.emergency_steps(given(spark, _SAMPLES, "host string, k int, cpu double"), "host", "k", "cpu").select("host", "k")


_SPANS = [("x", "1995-01-01", "1995-03-31"), ("y", "1995-03-31", "1995-03-31"), ("z", "1996-02-01", "1996-01-01")]


@query(f"""WITH w(name, a, b) AS ({values_sql(_SPANS)}) SELECT name, count(o_orderkey) AS n FROM w LEFT JOIN orders ON o_orderdate >= a::DATE AND o_orderdate < b::DATE + 1 GROUP BY 1""")
def query_windows(t):
    """Orders of inclusive date windows, each as a half-open range."""
    o = t("orders")
    out = [timeline.query_window(o.withColumns({"a": F.lit(a).cast("date"), "b": F.lit(b).cast("date"), "at": c("o_orderdate").cast("timestamp")}), "a", "b", "at").agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, a, b in _SPANS]
    return out[0].unionByName(out[1]).unionByName(out[2])


_DRAWS = [("s", "op1", 0.9, False), ("s", "op2", 0.8, True), ("s", "op3", 0.1, True), ("t", "op1", 0.2, True), ("u", "op1", 0.5, False)]


@session_query(f"WITH g(seed, op, draw, ok) AS ({values_sql(_DRAWS)}) SELECT seed, arg_max(op, (draw, op)) AS op, max(draw)::DOUBLE AS draw FROM g WHERE ok GROUP BY 1")
def applicable_draws(spark, sf):
    return rank.applicable_draws(given(spark, _DRAWS, "seed string, op string, draw double, ok boolean"), "seed", "draw", "ok", "op").select("seed", "op", "draw")


# graphs

_REFS = [("u", "A.java", "class A { B b; }", "A"), ("u", "B.java", "class B { CC c; }", "B"), ("u", "C.java", "class CC { }", "CC"), ("u", "D.java", "class D { A a; }", "D"), ("v", "B.java", "class B { A a; }", "B"), ("v", "A.java", "enum A { B }", "A")]


@session_query(f"""WITH RECURSIVE g(unit, file, code, type) AS ({values_sql(_REFS)}), w AS (SELECT unit, file, unnest(regexp_extract_all(code, '[A-Za-z_$][A-Za-z0-9_$]*')) AS word FROM g),
e AS (SELECT DISTINCT w.unit, w.file AS src, g.file AS dst FROM w JOIN g ON w.unit = g.unit AND w.word = g.type AND w.file <> g.file), c AS (SELECT unit, src, dst FROM e UNION SELECT c.unit, c.src, e.dst FROM c JOIN e ON c.unit = e.unit AND c.dst = e.src)
SELECT unit, src, dst FROM c WHERE src <> dst""")
def companion_files(spark, sf):
    """The files a file needs: edges by the names of declared types within a unit, closed over."""
    g = given(spark, _REFS, "unit string, file string, code string, type string").withColumn("types", F.array("type"))
    e = graph.reference_edges(g, "unit", "file", "code", "types")
    name = lambda k: F.concat_ws("/", "unit", k)
    x = graph.closure(e.select(name("src").alias("src"), name("dst").alias("dst")))
    part = lambda k, n: F.split_part(k, F.lit("/"), F.lit(n))
    return x.select(part("src", 1).alias("unit"), part("src", 2).alias("src"), part("dst", 2).alias("dst"))


_CRAWL = [("r", "a"), ("r", "b"), ("r", "c"), ("a", "d"), ("b", "d"), ("c", "e"), ("d", "f")]
_KNOWN = [("r", 0), ("a", 1), ("b", 1), ("c", 0), ("d", 1)]


@session_query(f"""SELECT * FROM (VALUES ('r', 0, NULL, true), ('a', 1, 'r', true), ('b', 1, 'r', false), ('c', 1, 'r', true), ('d', 2, 'a', false), ('e', 2, 'c', false)) v(node, depth, via, followed)""")
def budgeted_paths(spark, sf):
    """Links followed from one node with a budget of one node that is not known yet; the result stands in the SQL."""
    edges, cost = given(spark, _CRAWL, "src string, dst string"), given(spark, _KNOWN, "node string, cost int")
    x = graph.bounded_paths(given(spark, [("r",)], "node string"), edges, 5, expand=cost, budget=1)
    return x.select("node", "depth", "via", "followed")


# sources and sinks

_LABELLED = "SELECT repository, unnest(labels) AS l, crawl_seq FROM issues"


@query(f"""WITH one AS (SELECT min(repository) AS r FROM issues), two AS (SELECT min(l) AS l FROM ({_LABELLED}) x, one WHERE repository = r)
SELECT 'all' AS dataset, crawl_seq, 'Row-' || crawl_seq AS name FROM issues, one WHERE repository = r UNION ALL SELECT 'labelled', crawl_seq, 'Row-' || crawl_seq FROM issues, one, two WHERE repository = r AND list_contains(labels, l)""")
def dataset_issues(t):
    """The issues of two specifications: those of a repository, and those of them with a label."""
    from millrace.sources.datasets import DatasetSpec

    i = t("issues")
    repository = i.agg(F.min("repository")).head(1)[0][0]  # one value
    label = i.filter(c("repository") == repository).select(F.explode("labels").alias("l")).agg(F.min("l")).head(1)[0][0]
    specs = DatasetSpec("all", repository, prefix="Row"), DatasetSpec("labelled", repository, labels=(label,), prefix="Row")
    a, b = (s.issues(i).select("dataset", "crawl_seq", s.issue_id(c("crawl_seq")).alias("name")) for s in specs)
    return a.unionByName(b)

_TREE = {
    "A/A.java": "class A { public static void main(String[] a) { B b; } }", "A/B.java": "class B { }", "A/FuzzerUtils.java": "x", "A/A.json": '{"id": 1}', "A/Ax.json": "[1]", "A/.meta/hidden.java": "class H { }",
    "B/M1.java": "class M1 { public static void main(String[] a) { } }", "B/M2.java": "package p; class M2 { public static void main(String... a) { } }", "B/Bz.json": "{broken", "B/B_llm_type.json": "{}", "C/C.json": "{}", "D/D.java": "class D { }", ".hidden/X.java": "x", "testcases.txt": "# list\n\nA\nZ\n",
}


def _tree(spark: SparkSession) -> str:
    root = fresh_path(spark, "tree")
    for name, body in _TREE.items():
        write_text(spark, f"{root}/{name}", body)
    return root


@session_query("""SELECT * FROM (VALUES ('source', 'A', 'A.java'), ('source', 'A', 'B.java'), ('source', 'B', 'M1.java'), ('source', 'B', 'M2.java'), ('source', 'D', 'D.java'), ('main', 'A', 'A.java'), ('main', 'D', 'D.java'), ('rejected', 'B', NULL),
 ('metadata', 'A', 'A.json'), ('metadata', 'B', 'Bz.json'), ('metadata', 'C', 'C.json'), ('case', 'A', NULL), ('case', 'B', NULL), ('object', 'A', 'A.json'), ('object', 'B', 'B_llm_type.json'), ('object', 'C', 'C.json'),
 ('seed', 'A', 'A.java'), ('seed', 'B', 'M1.java'), ('seed', 'B', 'M2.java'), ('listed', 'A', 'A.java'), ('missing', NULL, 'Z')) v(kind, folder, file)""")
def case_scans(spark, sf):
    """A tree of cases: sources, main files, metadata, valid cases, JSON objects, seeds, and a list of classes; what is to be
    found stands in the SQL."""
    from millrace.functions import code

    files = scans.texts(spark, _tree(spark))
    src = scans.sources(files)
    info = src.withColumn("i", extract.source_info(code.masked(c("text")), c("file")))
    chosen, rejected = scans.main_file(info.withColumn("has_main", c("i.has_main")))
    meta = scans.canonical_metadata(files, r"_llm_")
    names = files.filter("file = 'testcases.txt'").select(F.explode(F.split("text", "\n")).alias("name"))
    found, missing = scans.listed(info.withColumn("types", c("i.types")), names)
    none = F.lit(None).cast("string")
    parts = [
        src.select(F.lit("source").alias("kind"), "folder", "file"), chosen.select(F.lit("main").alias("kind"), "folder", "file"), rejected.select(F.lit("rejected").alias("kind"), "folder", none.alias("file")), meta.select(F.lit("metadata").alias("kind"), "folder", "file"),
        scans.valid_cases(files, meta).select(F.lit("case").alias("kind"), "folder", none.alias("file")), scans.json_objects(files.filter("file LIKE '%.json'")).filter("object IS NOT NULL").select(F.lit("object").alias("kind"), "folder", "file"),
        scans.seeds(files).select(F.lit("seed").alias("kind"), "folder", "file"), found.select(F.lit("listed").alias("kind"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file")), missing.select(F.lit("missing").alias("kind"), none.alias("folder"), c("name").alias("file")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@session_query("SELECT * FROM (VALUES ('A', 'A.java', 56), ('A', 'B.java', 11), ('A', 'FuzzerUtils.java', 1), ('B', 'M1.java', 52), ('B', 'M2.java', 64), ('D', 'D.java', 11)) v(folder, file, bytes)")
def case_tree_files(spark, sf):
    """The same tree by the data source that lists and reads folders in tasks."""
    from millrace.sources import case_tree

    case_tree.register(spark)
    x = spark.read.format("case_tree").option("suffix", ".java").option("folders_per_task", 2).load(_tree(spark))
    return x.filter("error IS NULL").select("folder", "file", c("bytes").cast("int").alias("bytes"))


@session_query("SELECT * FROM (VALUES ('later', true), ('earlier', false), ('none', true)) v(output, stale)")
def stale_outputs(spark, sf):
    """Files by size and time only; outputs older and newer than the newest input."""
    st = scans.stamps(spark, _tree(spark), "*.java").withColumn("key", F.lit("k"))
    moved = lambda d: st.withColumn("modified", F.expr(f"modified + INTERVAL {d} DAY"))
    flag = lambda name, o: scans.stale(st, o, "key").agg(F.lit(name).alias("output"), (F.count("*") > 0).alias("stale"))
    return flag("later", moved(-1)).unionByName(flag("earlier", moved(1))).unionByName(flag("none", st.limit(0)))


@session_query("SELECT pass_ord, category, pass, replace(replace(pass, '&', '\\&'), '_', '\\_') AS tex, true AS marked FROM taxonomy")
def report_files(spark, sf):
    """A table through the quoted CSV sink, the CSV sink with a byte order mark and the LaTeX rows, read back."""
    t = table(spark, sf, "taxonomy").select("pass_ord", "category", "pass")
    a, b = fresh_path(spark, "csv"), fresh_path(spark, "csv")
    sinks.csv_report(t, a)
    sinks.csv_with_mark(t, b)
    back = spark.read.option("header", "true").option("escape", '"').schema("pass_ord int, category string, pass string").csv(a)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(b).agg(F.min(F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("marked"))
    tex = sinks.taxonomy_latex(t.withColumn("count", F.lit(0))).select(F.split("line", " & ").alias("l")).select(c("l")[F.size("l") - 2].alias("tex"))
    tex = tex.join(t.select("pass", text.latex(c("pass")).alias("tex")), "tex").select("pass", "tex").distinct()
    return back.join(tex, "pass").crossJoin(F.broadcast(raw)).select("pass_ord", "category", "pass", "tex", "marked")  # one row


@query("SELECT issue_id, crawl_seq, status, labels IS NULL AS bare FROM issues")
def json_files(t):
    """A table through the JSON sink, nulls kept, read back."""
    i = t("issues").select("issue_id", "crawl_seq", "status", "labels")
    path = fresh_path(i.sparkSession, "json")
    sinks.json_report(i, path)
    return i.sparkSession.read.schema(i.schema).json(path).select("issue_id", "crawl_seq", "status", c("labels").isNull().alias("bare"))


@query("""SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'never') AS never, count(*) AS total FROM events""")
def json_counters(t):
    x = sinks.counters(t("events"), "event_type", ("click", "view", "never"))
    return x.select(F.from_json("report", "click bigint, view bigint, never bigint, total bigint").alias("r")).select("r.*")


@query("""WITH b AS (SELECT 'type' AS block, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'size', CASE WHEN value > 100 THEN 'large' ELSE 'small' END, count(*) FROM events GROUP BY 2)
SELECT block, value, n FROM b""")
def summary_document(t):
    """All distributions as one JSON document, read apart again."""
    e = t("events")
    blocks = e.groupBy(F.lit("type").alias("block"), c("event_type").alias("value")).agg(F.count("*").alias("n")).unionByName(e.groupBy(F.lit("size").alias("block"), F.when(c("value") > 100, "large").otherwise("small").alias("value")).agg(F.count("*").alias("n")))
    doc = sinks.report_document(blocks).select(F.explode(F.from_json("report", "map<string,map<string,bigint>>")).alias("block", "values"))
    return doc.select("block", F.explode("values").alias("value", "n"))


_BEFORE = [("i", "Old.java", "o"), ("i", "Mine.java", "m"), ("j", "Keep.java", "k")]
_MANIFEST = [("i", "Old.java"), ("j", "Keep.java")]
_FRESH = [("i", 0, "mine.java", "1"), ("i", 1, "New", "2"), ("i", 2, "new.java", "3"), ("i", 3, "New_1.java", "4"), ("l", 0, "A.java", "5")]


@session_query("""SELECT * FROM (VALUES ('i', 'Mine.java', 'm', false), ('i', 'mine_1.java', '1', true), ('i', 'New.java', '2', true), ('i', 'new_1.java', '3', true), ('i', 'New_1_1.java', '4', true), ('j', 'Keep.java', 'k', true), ('l', 'A.java', '5', true)) v(issue_id, saved, content, listed)""")
def issue_bundles(spark, sf):
    """Issue folders saved again: only files of the previous manifest go, names stay free of collisions; the outcome stands in
    the SQL."""
    make = lambda rows, schema: given(spark, rows, schema)
    files, manifest = sinks.saved_bundle(make(_BEFORE, "issue_id string, saved string, content string"), make(_MANIFEST, "issue_id string, saved string"), make(_FRESH, "issue_id string, pos int, original string, content string"))
    return files.join(manifest.withColumn("listed", F.lit(True)), ["issue_id", "saved"], "left").select("issue_id", "saved", "content", F.coalesce("listed", F.lit(False)).alias("listed"))


_FIXES = [("i", 0, "openjdk/jdk", "abcdef1234567890", None, "diff --git a/x b/x\n+1"), ("i", 1, "openjdk/jdk", "abcdef1234567890", None, "diff --git a/y b/y\n"), ("i", 2, "openjdk/jdk", None, 17, "--- a\n+++ b\n"), ("i", 3, None, None, None, "diff --git a/z b/z\n"), ("i", 4, "a/b", "1", None, "<html>"), ("i", 5, "a/b", "2", None, None)]


@session_query("""SELECT * FROM (VALUES ('i', 0, 'fix_openjdk-jdk_abcdef123456.patch', NULL), ('i', 1, 'fix_openjdk-jdk_abcdef123456_1.patch', NULL), ('i', 2, 'fix_openjdk-jdk_pr17.patch', NULL), ('i', 3, 'fix_repo_3.patch', NULL), ('i', 4, NULL, 'invalid_content'), ('i', 5, NULL, NULL)) v(issue_id, pos, patch_file, patch_status)""")
def patch_files(spark, sf):
    return sinks.patch_manifest(given(spark, _FIXES, "issue_id string, pos int, repository string, sha string, pull_request int, patch_text string"))


_CASES = [("a", '{"Type_Related": " yes "}'), ("b", '{"Type_Related": "No"}'), ("c", None), ("d", "[1]"), ("e", "{broken"), ("f", '{"Type_Related": "maybe"}'), ("g", '{"Type_Related": "YES"}'), ("h", '{"x": 1}'), ("k", '{"Type_Related": "Unclear"}')]


@session_query("""SELECT * FROM (VALUES ('dry', 'a', 'selected'), ('dry', 'g', 'selected'), ('keep', 'a', 'skipped_existing'), ('keep', 'g', 'copied'), ('over', 'a', 'overwritten'), ('over', 'g', 'copied'),
 ('scan', 'case_dirs_seen', '9'), ('scan', 'yes', '2'), ('scan', 'no', '1'), ('scan', 'unclear', '1'), ('scan', 'missing_result', '1'), ('scan', 'invalid_json', '2'), ('scan', 'invalid_label', '2')) v(run, case_id, action)""")
def label_exports(spark, sf):
    """Cases of a label exported dry, beside what is there, and over it, with the counts of the scan; the outcome stands in
    the SQL."""
    cases, there = given(spark, _CASES, "case_id string, result string"), given(spark, [("a",)], "case_id string")
    plans = {run: sinks.label_export(cases, "Type_Related", "Yes", there, run == "over", run == "dry") for run in ("dry", "keep", "over")}
    out = plans["dry"][1].select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in plans["dry"][1].columns]), F.array(*[c(k).cast("string") for k in plans["dry"][1].columns]))).alias("case_id", "action")).select(F.lit("scan").alias("run"), "case_id", "action")
    for run, (plan, _) in plans.items():
        out = out.unionByName(plan.select(F.lit(run).alias("run"), "case_id", "action"))
    return out


_LOG = [("s", 0, "[INFO ] start"), ("s", 1, "[ctx-1] - begin"), ("s", 2, "plain"), ("s", 3, "[DEBUG] off"), ("s", 4, "stray"), ("s", 5, "[ctx-2] - BUG FOUND here"), ("s", 6, "more"), ("s", 7, "[ctx-1] - again")]


@session_query("""SELECT * FROM (VALUES ('all', '[INFO ] start'), ('all', '[DEBUG] off'), ('all', 'stray'), ('all', ''), ('all', '======================================================'), ('all', 'Group: ctx-1'), ('all', '======================================================'), ('all', '[ctx-1] - begin'), ('all', 'plain'), ('all', '[ctx-1] - again'),
 ('all', ''), ('all', '======================================================'), ('all', 'Group: ctx-2 [BUG]'), ('all', '======================================================'), ('all', '[ctx-2] - BUG FOUND here'), ('all', 'more'),
 ('bugs', ''), ('bugs', '======================================================'), ('bugs', 'Group: ctx-2 [BUG]'), ('bugs', '======================================================'), ('bugs', '[ctx-2] - BUG FOUND here'), ('bugs', 'more')) v(report, line)""")
def grouped_log_files(spark, sf):
    """Log lines written by context, all of them and those of bugs; the text stands in the SQL."""
    from millrace.streaming import logs

    g = logs.grouped_lines(given(spark, _LOG, "source string, line_no int, text string"))
    out = None
    for name, only in (("all", False), ("bugs", True)):
        path = fresh_path(spark, "log")
        sinks.log_text(g, path, only)
        part = spark.read.text(path).select(F.lit(name).alias("report"), c("value").alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


@session_query("SELECT * FROM (VALUES (1, 0, 'one'), (1, 4, 'two'), (2, 8, 'three'), (3, 0, 'new')) v(run, \"offset\", text)")
def tailed_logs(spark, sf):
    """A log that grows between runs of a stream, with a line that is not complete yet, and shrinks; the lines of each run
    stand in the SQL."""
    from millrace.sources import log_tail

    log_tail.register(spark)
    folder = fresh_path(spark, "tail")
    file, out = f"{folder}/a.log", None
    for run, body in enumerate(("one\ntwo\nthr", "one\ntwo\nthree\nfo", "new\n"), 1):
        write_text(spark, file, body)
        lines = spark.readStream.format("log_tail").option("bytes_per_task", 5).load(f"{folder}/*.log")
        q = lines.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/run={run}").trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.read.schema("source string, offset bigint, text string, run int").option("basePath", folder).parquet(*[f"{folder}/run={k}" for k in (1, 2, 3)])
    return out.select("run", c("offset").cast("int").alias("offset"), "text")


@query("SELECT issue_id, min(crawl_seq) AS crawl_seq FROM issues GROUP BY 1")
def first_of_signature(t):
    """First rows by signature (batch form of the stream filter)."""
    return dedup.distinct_capped(t("issues").select("issue_id", "crawl_seq"), "issue_id", [], "crawl_seq", 1).select("issue_id", "crawl_seq")
