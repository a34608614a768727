"""Queries over whole tables for the core's operators, each with the same in SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import extract, features, text
from millrace.operators import compare, dedup, graph, rank, rules, stats, timeline
from millrace.session import fresh_path
from millrace.sources.scans import HELPER_FILES
from millrace.sources.tables import streamed, table
from millrace.streaming import logs, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table reader ``t(name)`` under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf: f(lambda name: table(spark, sf, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def beside(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """The rows of a table and given ones, so that every branch of an operator is taken."""
    return df.unionByName(df.sparkSession.createDataFrame(rows, df.schema))


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def values_sql(rows: list[tuple]) -> str:
    """Given rows in SQL."""
    return "VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


c = F.col
_LABEL = r"CASE WHEN trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')) IN ('Yes', 'No', 'Unclear') THEN trim(regexp_replace({0}, '\s+', ' ', 'g')) ELSE 'Missing' END"
_TIER = r"CASE lower(trim(regexp_replace(coalesce(Compiler_Tier, ''), '\s+', ' ', 'g'))) WHEN 'c1' THEN 'C1' WHEN 'client compiler' THEN 'C1' WHEN 'c1 / client compiler' THEN 'C1' WHEN 'c2' THEN 'C2' WHEN 'server compiler' THEN 'C2' WHEN 'c2 / server compiler' THEN 'C2' WHEN 'shared' THEN 'Shared' ELSE 'Unknown' END"
_PASS = """named AS (
  SELECT r.*, coalesce(t.pass, a.pass, 'Unknown') AS pass FROM analyze_results r
  LEFT JOIN (SELECT lower(pass) AS k, min(pass) AS pass FROM taxonomy GROUP BY 1) t ON lower(trim(Primary_Faulty_Optimization, ' ')) = t.k
  LEFT JOIN (SELECT lower(alias) AS k, min(pass) AS pass FROM aliases GROUP BY 1) a ON lower(trim(Primary_Faulty_Optimization, ' ')) = a.k
)"""
_INVOLVED = f"""WITH {_PASS}, raw AS (
  SELECT response_no, case_id, pass AS name FROM named
  UNION ALL
  SELECT response_no, case_id, coalesce(t.pass, a.pass, 'Unknown') FROM (SELECT response_no, case_id, unnest(Interacting_Optimizations) AS x FROM named) i
  LEFT JOIN (SELECT lower(pass) AS k, min(pass) AS pass FROM taxonomy GROUP BY 1) t ON lower(trim(x, ' ')) = t.k
  LEFT JOIN (SELECT lower(alias) AS k, min(pass) AS pass FROM aliases GROUP BY 1) a ON lower(trim(x, ' ')) = a.k
), involved AS (SELECT DISTINCT response_no, case_id, name FROM raw WHERE name <> 'Unknown')
"""


def _named(t) -> DataFrame:
    return rules.canonical_name(t("analyze_results"), c("Primary_Faulty_Optimization"), t("taxonomy"), t("aliases"))


def _involved(t) -> DataFrame:
    """response_no, case_id, name: the primary and every interacting entry, once for each answer."""
    first = _named(t).select("response_no", "case_id", c("pass").alias("name"))
    others = rules.canonical_name(t("analyze_results").select("response_no", "case_id", F.explode("Interacting_Optimizations").alias("x")), c("x"), t("taxonomy"), t("aliases"), "name")
    return first.unionByName(others.select("response_no", "case_id", "name")).filter("name <> 'Unknown'").distinct()


# labels and distributions


@query(
    f"""WITH pairs AS (SELECT case_id, {_LABEL.format("arg_min(Type_Related, response_no)")} AS screen, {_LABEL.format("arg_max(Type_Related, response_no)")} AS "analyze" FROM (SELECT case_id, response_no, coalesce(Type_Related, '') AS Type_Related FROM analyze_results) GROUP BY case_id)
SELECT screen, "analyze", count(*) AS count, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM pairs), 3) AS percent FROM pairs GROUP BY 1, 2"""
)
def label_transition(t):
    x = t("analyze_results").withColumn("x", F.coalesce("Type_Related", F.lit("")))
    pairs = x.groupBy("case_id").agg(F.min_by("x", "response_no").alias("a"), F.max_by("x", "response_no").alias("b"))
    return stats.transitions(pairs, text.label(c("a")), text.label(c("b")))


@query(f"SELECT {_TIER} AS tier, count(*) AS count, min(response_no) AS first_seen, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM analyze_results), 3) AS percent FROM analyze_results GROUP BY 1")
def tier_distribution(t):
    return stats.distribution(t("analyze_results"), text.tier(c("Compiler_Tier")), "response_no", name="tier")


@query(f"WITH {_PASS} SELECT pass, count(*) AS count, min(response_no) AS first_seen, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM analyze_results), 3) AS percent FROM named GROUP BY 1")
def primary_distribution(t):
    return stats.distribution(_named(t), c("pass"), "response_no", name="pass")


@query(f"{_INVOLVED} SELECT name, count(*) AS count FROM involved GROUP BY 1")
def involved_distribution(t):
    return _involved(t).groupBy("name").agg(F.count("*").alias("count"))


@query(f"{_INVOLVED} SELECT d.category_ord, d.category, count(DISTINCT case_id) AS cases FROM (SELECT DISTINCT category_ord, category FROM taxonomy) d LEFT JOIN (SELECT category, case_id FROM involved JOIN taxonomy ON name = pass) f ON d.category = f.category GROUP BY 1, 2")
def category_zero_fill(t):
    dim = t("taxonomy").select("category_ord", "category").distinct()
    facts = _involved(t).join(t("taxonomy"), c("name") == c("pass")).select(c("category").alias("fact"), "case_id")
    return stats.zero_filled(dim, "category", facts, "fact", "case_id")


@query(f"{_INVOLVED} SELECT category, CASE WHEN grouping(name) = 0 THEN name END AS name, count(DISTINCT case_id) AS cases, grouping(name)::INT AS is_total FROM involved JOIN taxonomy ON name = pass GROUP BY GROUPING SETS ((category), (category, name))")
def two_level_totals(t):
    return stats.two_levels(_involved(t).join(t("taxonomy"), c("name") == c("pass")), "category", "name", "case_id").withColumn("is_total", c("is_total").cast("int"))


@query(
    f"WITH {_PASS} SELECT {_TIER} AS tier, count(*) AS n, count(*) FILTER (pass = 'Unknown') AS unknown, count(*) FILTER (pass = 'Unknown' AND Optimization_Unknown_Reason = 'NoTaxonomyMatch') AS no_match, count(*) FILTER (pass = 'Unknown' AND Optimization_Unknown_Reason = 'InsufficientEvidence') AS insufficient FROM named GROUP BY 1"
)
def sub_populations(t):
    unknown = c("pass") == "Unknown"
    named = _named(t).withColumn("tier", text.tier(c("Compiler_Tier")))
    return stats.conditional_counts(named, ["tier"], {"unknown": unknown, "no_match": unknown & (c("Optimization_Unknown_Reason") == "NoTaxonomyMatch"), "insufficient": unknown & (c("Optimization_Unknown_Reason") == "InsufficientEvidence")})


@query(f"WITH l AS (SELECT {_LABEL.format('Type_Related')} AS label FROM analyze_results) SELECT count(*) FILTER (label = 'Yes') AS yes, count(*) FILTER (label = 'No') AS no, count(*) FILTER (label = 'Unclear') AS unclear, count(*) FILTER (label = 'Missing') AS missing, count(*) FILTER (label IN ('Yes', 'Unclear')) AS selected FROM l")
def selected_population(t):
    x = text.label(c("Type_Related"))
    return t("analyze_results").agg(*[F.count_if(x == v).alias(v.lower()) for v in ("Yes", "No", "Unclear", "Missing")], F.count_if(x.isin("Yes", "Unclear")).alias("selected"))


@query(f"""WITH {_PASS}, blocks AS (SELECT 'tier' AS block, {_TIER} AS value FROM named UNION ALL SELECT 'primary', pass FROM named UNION ALL SELECT 'basis', coalesce(Optimization_Evidence_Basis, 'Unknown') FROM named)
SELECT block, value, count(*) AS n FROM blocks GROUP BY 1, 2""")
def summary_blocks(t):
    blocks = _named(t).select(F.inline(F.array(
        F.struct(F.lit("tier").alias("block"), text.tier(c("Compiler_Tier")).alias("value")),
        F.struct(F.lit("primary").alias("block"), c("pass").alias("value")),
        F.struct(F.lit("basis").alias("block"), F.coalesce("Optimization_Evidence_Basis", F.lit("Unknown")).alias("value")),
    )))
    return blocks.groupBy("block", "value").agg(F.count("*").alias("n"))


_VALID = (-1, "c", " c ", "Yes", "C2", "x", "r", "Patch", "High", "N/A", "Global Value Numbering", ["Inlining"], True, True)
_ANSWER = ("response_no", "case_id", "ID", "Type_Related", "Compiler_Tier", "Faulty_Compiler_Component", "Optimization_Mapping_Reason", "Optimization_Evidence_Basis", "Optimization_Confidence", "Optimization_Unknown_Reason", "Primary_Faulty_Optimization", "Interacting_Optimizations", "Java_Evidence", "Patch_Evidence")
#: A valid answer, and answers that break one rule each.
_ANSWERS = [_VALID] + [
    (-2 - k, *[v if name == changed else old for name, old in zip(_ANSWER[1:], _VALID[1:], strict=True)])
    for k, (changed, v) in enumerate([("ID", "d"), ("Type_Related", "Maybe"), ("Compiler_Tier", "C3"), ("Faulty_Compiler_Component", None), ("Optimization_Mapping_Reason", None), ("Optimization_Evidence_Basis", "Guess"), ("Optimization_Confidence", None), ("Optimization_Unknown_Reason", "x"), ("Primary_Faulty_Optimization", None), ("Interacting_Optimizations", None), ("Interacting_Optimizations", [None]), ("Java_Evidence", None), ("Patch_Evidence", None), ("Primary_Faulty_Optimization", "no such entry"), ("Optimization_Unknown_Reason", "NoTaxonomyMatch")])
]


@query(f"""WITH answers AS (SELECT {", ".join(_ANSWER[:-2])}, CASE WHEN Java_Evidence IS NOT NULL THEN true END AS Java_Evidence, CASE WHEN Patch_Evidence IS NOT NULL THEN true END AS Patch_Evidence FROM analyze_results UNION ALL {values_sql(_ANSWERS)}),
 {_PASS.replace("analyze_results", "answers")} SELECT response_no, CASE
 WHEN coalesce(trim(ID, ' ') = case_id, false) = false THEN 'wrong ID'
 WHEN coalesce(Type_Related IN ('Yes','No','Unclear'), false) = false THEN 'invalid Type_Related'
 WHEN coalesce(Compiler_Tier IN ('C1','C2','Shared','Unknown'), false) = false THEN 'invalid Compiler_Tier'
 WHEN Faulty_Compiler_Component IS NULL THEN 'Faulty_Compiler_Component must be string'
 WHEN Optimization_Mapping_Reason IS NULL THEN 'Optimization_Mapping_Reason must be string'
 WHEN coalesce(Optimization_Evidence_Basis IN ('Patch','Issue','Log','Testcase','Mixed','Unknown'), false) = false THEN 'invalid Optimization_Evidence_Basis'
 WHEN coalesce(Optimization_Confidence IN ('High','Medium','Low'), false) = false THEN 'invalid Optimization_Confidence'
 WHEN coalesce(Optimization_Unknown_Reason IN ('N/A','InsufficientEvidence','NoTaxonomyMatch'), false) = false THEN 'invalid Optimization_Unknown_Reason'
 WHEN Primary_Faulty_Optimization IS NULL THEN 'Primary_Faulty_Optimization must be string'
 WHEN Interacting_Optimizations IS NULL THEN 'Interacting_Optimizations must be list'
 WHEN len(list_filter(Interacting_Optimizations, lambda x: x IS NULL)) > 0 THEN 'Interacting_Optimizations entries must be strings'
 WHEN Java_Evidence IS NULL THEN 'Java_Evidence must be list' WHEN Patch_Evidence IS NULL THEN 'Patch_Evidence must be list'
 WHEN pass = 'Unknown' AND Optimization_Unknown_Reason = 'N/A' THEN 'Unknown primary requires Optimization_Unknown_Reason'
 WHEN pass <> 'Unknown' AND Optimization_Unknown_Reason <> 'N/A' THEN 'known primary requires Optimization_Unknown_Reason=N/A' ELSE 'ok' END AS verdict FROM named""")
def validate_answers(t):
    there = {k: F.when(c(k).isNotNull(), True).alias(k) for k in _ANSWER[-2:]}
    answers = beside(t("analyze_results").select(*[there.get(k, c(k)) for k in _ANSWER]), _ANSWERS)
    return rules.canonical_name(answers, c("Primary_Faulty_Optimization"), t("taxonomy"), t("aliases")).select("response_no", rules.answer_violation().alias("verdict"))




@query("""WITH a AS (SELECT response_no, Interacting_Optimizations AS i, list_transform(Java_Evidence, lambda e: repeat(e.snippet, 30)) AS j, list_transform(Patch_Evidence, lambda e: repeat(e.why_relevant, 40)) AS p FROM analyze_results)
SELECT response_no, len(i[1:4])::INT AS interactions, len(j[1:2])::INT AS java, len(p[1:2])::INT AS patch,
 list_max(list_transform(j[1:2], lambda x: CASE WHEN length(x) > 300 THEN 303 ELSE length(x) END))::INT AS longest, list_max(list_transform(p[1:2], lambda x: CASE WHEN length(x) > 600 THEN 603 ELSE length(x) END))::INT AS reasons FROM a""")
def capped_answers(t):
    """Answers cut to their limits; the texts are repeated first, so that some are beyond them."""
    java = F.transform("Java_Evidence", lambda e: F.when(e.isNotNull(), F.struct(e["file"].alias("file"), F.repeat(e["snippet"], F.lit(30)).alias("snippet"), e["why_relevant"].alias("why_relevant"))))
    patch = F.transform("Patch_Evidence", lambda e: F.when(e.isNotNull(), F.struct(e["file"].alias("file"), e["location_or_symbol"].alias("location_or_symbol"), F.repeat(e["why_relevant"], F.lit(40)).alias("why_relevant"))))
    x = rules.capped_answer(t("analyze_results").withColumns({"Java_Evidence": java, "Patch_Evidence": patch}))
    n = lambda k: F.when(c(k).isNotNull(), F.size(k))
    longest = lambda k, f: F.array_max(F.transform(k, lambda e: F.length(e[f])))
    return x.select("response_no", n("Interacting_Optimizations").alias("interactions"), n("Java_Evidence").alias("java"), n("Patch_Evidence").alias("patch"), longest("Java_Evidence", "snippet").alias("longest"), longest("Patch_Evidence", "why_relevant").alias("reasons"))




@query(f"WITH {_PASS} SELECT response_no, pass FROM named")
def alias_canonicalize(t):
    return _named(t).select("response_no", "pass")




# text


def _trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@query(rf"""WITH x AS (SELECT doc_id, {_trimmed("text")} AS x FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, x, string_split(x, chr(10)) AS ls FROM x),
k AS (SELECT doc_id, CASE WHEN x <> '' AND (len(ls) >= 20 OR contains(x, '[TRUNCATED]'))
 THEN {_trimmed("array_to_string(CASE WHEN len(ls) >= 20 THEN ls[1:20] WHEN len(ls) > 1 THEN ls[1:-2] ELSE ls END, chr(10))")} || chr(10) || '<... TRUNCATED BY NORMALIZER ...>' ELSE x END AS y FROM l)
SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split(y, chr(10)), lambda s: NOT (starts_with(s, '[warning]') OR {" OR ".join(f"contains(s, '{p}')" for p in text.NOISE_PARTS)})), chr(10)), '@[0-9a-fA-F]{{4,}}', '@ADDR', 'g') AS normalised FROM k""")
def normalize_output(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", text.captured(c("text"), F.lit(0), 20).alias("normalised"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 272) || chr(10) || '[... locally truncated ...]' || chr(10) || right(text, 97) END AS clipped FROM documents")
def clip_text(t):
    return t("documents").select("doc_id", text.clip(c("text"), 400).alias("clipped"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '')[1:10], ' / ') AS summary, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS collapsed FROM documents""")
def summary_lines(t):
    return t("documents").select("doc_id", text.summary_lines(c("text")).alias("summary"), text.collapse(c("text")).alias("collapsed"))


@query(r"""WITH x AS (SELECT artifact_id, original_filename, origin, left(regexp_replace(regexp_replace(coalesce(original_filename, ''), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 120) AS s FROM artifacts)
SELECT artifact_id, CASE WHEN s = '' THEN 'unnamed.java' ELSE s END AS safe, regexp_replace(origin, '[^A-Za-z0-9_$.-]', '_', 'g') AS ident FROM x""")
def safe_names(t):
    return t("artifacts").select("artifact_id", text.safe_name(c("original_filename")).alias("safe"), text.identifier(c("origin")).alias("ident"))


@query(r"""SELECT o_orderkey, printf('%.2f%%', 100.0 * floor(o_totalprice) / 599999) AS pct, printf('%dd %02dh %02dm %02ds', (round(o_totalprice)::BIGINT // 86400), (round(o_totalprice)::BIGINT % 86400) // 3600, (round(o_totalprice)::BIGINT % 3600) // 60, round(o_totalprice)::BIGINT % 60) AS dur,
 coalesce(nullif(regexp_extract(o_orderpriority || ' jdk-' || o_orderkey || '_x.Main', '(?i)^((JDK|OpenJ9)-\d+(_[a-z]+)?)\..+', 1), ''), o_orderpriority) AS priority,
 CASE WHEN o_orderstatus = 'F' THEN 'jdk-' || o_orderkey || '_x' WHEN o_orderstatus = 'O' THEN 'OpenJ9-' || o_orderkey ELSE 'JDK-' || o_orderkey || ' P' END AS name FROM orders""")
def text_formats(t):
    return t("orders").select("o_orderkey", text.percent_text(F.floor("o_totalprice"), F.lit(599999)).alias("pct"), text.duration_text(F.round("o_totalprice")).alias("dur"), text.output_name(c("o_orderpriority")).alias("priority"), text.output_name(F.concat(F.when(c("o_orderstatus") == "F", "jdk-").when(c("o_orderstatus") == "O", "OpenJ9-").otherwise("JDK-"), c("o_orderkey").cast("string"), F.when(c("o_orderstatus") == "F", "_x.Main").when(c("o_orderstatus") == "O", ".p.Main").otherwise(" P"))).alias("name"))


@query(r"SELECT artifact_id, sha256(regexp_replace(coalesce(content, ''), '\s+', '', 'g')) AS digest, coalesce(lower(sha256) = sha256(regexp_replace(coalesce(content, ''), '\s+', '', 'g')), false) AS as_stored FROM artifacts")
def content_hash(t):
    h = text.content_hash(c("content"))
    return t("artifacts").select("artifact_id", h.alias("digest"), F.coalesce(F.lower("sha256") == h, F.lit(False)).alias("as_stored"))


@query(r"""SELECT issue_id, 'v3.' || sha256(issue_id || chr(0) || array_to_string(list_sort(list(sha256(regexp_replace(coalesce(content, ''), '\s+', '', 'g')))), chr(0))) AS key FROM artifacts WHERE issue_id IS NOT NULL GROUP BY issue_id""")
def case_keys(t):
    return t("artifacts").filter("issue_id IS NOT NULL").groupBy("issue_id").agg(text.set_key(F.collect_list(text.content_hash(c("content"))), c("issue_id")).alias("key"))


@query(r"SELECT artifact_id, issue_id FROM (SELECT artifact_id, issue_id, row_number() OVER (PARTITION BY issue_id, sha256(regexp_replace(coalesce(content, ''), '\s+', '', 'g')) ORDER BY pos, artifact_id) AS r FROM artifacts) WHERE r = 1")
def dedup_first(t):
    return dedup.first_of_content(t("artifacts"), "content", "pos", "artifact_id", within=("issue_id",)).select("artifact_id", "issue_id")


@query(r"SELECT sha256(regexp_replace(content, '\s+', '', 'g')) AS content_sha256, count(DISTINCT issue_id) AS owners, min(issue_id) AS first_owner, count(*) AS copies FROM artifacts WHERE content IS NOT NULL GROUP BY 1 HAVING count(DISTINCT issue_id) > 1")
def cross_doc_duplicates(t):
    return dedup.shared_contents(t("artifacts"), "content", "issue_id")


@query(r"""WITH k AS (SELECT artifact_id, issue_id, sha256(regexp_replace(coalesce(content, ''), '\s+', '', 'g')) AS content_sha256 FROM artifacts), f AS (SELECT content_sha256, arg_min(issue_id, artifact_id) AS first_owner FROM k GROUP BY 1)
SELECT artifact_id, issue_id, k.content_sha256, first_owner FROM k JOIN f ON k.content_sha256 = f.content_sha256 WHERE first_owner <> issue_id""")
def prior_occurrences(t):
    return dedup.prior_occurrences(t("artifacts"), "content", "issue_id", "artifact_id")


# extraction


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '(?is)```(?:java)?[ \t]*\n(.*?)\n```', 1))::INT AS blocks, array_to_string(regexp_extract_all(text, '(?is)```(?:java)?[ \t]*\n(.*?)\n```', 1), '|') AS code FROM documents WHERE contains(text, '```')")
def fence_blocks(t):
    x = extract.fenced_blocks(c("text"))
    return t("documents").filter(c("text").contains("```")).select("doc_id", F.size(x).alias("blocks"), F.array_join(x, "|").alias("code"))


_SOURCES = [
    (-1, "--- BEGIN SOURCE ---\nclass A {}\n--- END SOURCE ---\nhttps://github.com/user-attachments/files/12/A.java and https://github.com/user-attachments/files/12/A.java?x=1"),
    (-2, "-begin source-\n a \n-END  SOURCE- mid --BEGIN SOURCE--b--end source-- https://github.com/user-attachments/files/7/B.java https://github.com/user-attachments/files/7/B.java"),
    (-3, "--- BEGIN SOURCE --- without end, https://github.com/user-attachments/files/7/B.txt"),
]


@query(rf"""WITH x AS (SELECT crawl_seq, coalesce(body, '') AS b FROM (SELECT crawl_seq, body FROM comments UNION ALL {values_sql(_SOURCES)})), y AS (SELECT crawl_seq, regexp_extract_all(b, '(?is)-+\s*BEGIN\s+SOURCE\s*-+\s*(.*?)\s*-+\s*END\s+SOURCE\s*-+', 1) AS s, regexp_extract_all(b, '(?i)https://github\.com/user-attachments/files/\d+/[^\s)>\]]+\.java(?:\?[^\s)>\]]+)?') AS u FROM x)
SELECT crawl_seq, len(s)::INT AS blocks, array_to_string(s, '|') AS code, array_to_string(list_filter(u, lambda v, i: list_position(u, v) = i), ' ') AS urls FROM y""")
def source_blocks(t):
    b = F.coalesce("body", F.lit(""))
    s = extract.source_blocks(b)
    return beside(t("comments").select("crawl_seq", "body"), _SOURCES).select("crawl_seq", F.size(s).alias("blocks"), F.array_join(s, "|").alias("code"), F.array_join(extract.attachment_urls(b), " ").alias("urls"))




@query(r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS l FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, unnest(regexp_extract_all(replace(l, 'Exception in thread', ' '), '\b((?:[a-z][a-z0-9_]*\.)*(?:[A-Z][a-zA-Z0-9_$]*)?(?:Exception|Error))\b\.?')) AS x FROM l WHERE NOT (starts_with(trim(l, ' '), 'at ') OR starts_with(trim(l, ' '), '...')))
SELECT x AS name, count(*) AS n, count(DISTINCT doc_id) AS documents FROM m WHERE NOT ends_with(x, '.') GROUP BY 1""")
def exception_counts(t):
    x = t("documents").filter("text IS NOT NULL").select("doc_id", F.explode(extract.issue_names(c("text"))).alias("name"))
    return x.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


_MESSAGES = [
    (-1, "A.java:3: error: cannot find symbol\n  symbol:   class Foo\n"), (-2, "A.java:4: error: local variables referenced from a lambda expression must be final or effectively final"),
    (-3, "(at line 7) Local variable x is required to be final or effectively final based on its usage"), (-4, "A.java:2: error: incompatible types: bad return type in lambda expression\n missing return value"),
    (-5, "A.java:9: error: unreachable code\nA.java:2: error: x"), (-6, "B.java:1: error: missing return statement"), (-7, "This method must return a result of type int (at line 2)"), (-8, "X.java:5: error: x\nX.java:5: Error: y (at line 12)"),
    (-9, "Segmentation fault (core dumped)"), (-10, "core dump OutOfMemoryError"), (-11, "# A fatal error has been detected by the Java Runtime"), (-12, "core dump"), (-13, "Error: Could not find or load main class A"), (-14, "java.lang.ClassNotFoundException: A"),
]


@query(rf"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL {values_sql(_MESSAGES)}), f AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '(?is)error:\s+cannot\s+find\s+symbol.*?\bsymbol:\s+class\s+\S+') THEN 'COMPILER_SYMBOL_NOT_FOUND'
 WHEN contains(lower(text), 'local variables referenced from a lambda expression must be final or effectively final') OR (contains(lower(text), 'local variable') AND contains(lower(text), 'is required to be final or effectively final based on its usage')) THEN 'COMPILER_LAMBDA_CAPTURE_EFFECTIVELY_FINAL'
 WHEN contains(lower(text), 'bad return type in lambda expression') AND contains(lower(text), 'missing return value') THEN 'COMPILER_LAMBDA_MISSING_RETURN_VALUE'
 WHEN contains(lower(text), 'unreachable code') THEN 'COMPILER_UNREACHABLE_CODE' WHEN contains(text, 'missing return statement') OR contains(text, 'method must return a result') THEN 'COMPILER_MISSING_RETURN' ELSE 'NONE' END AS reason,
 list_transform(list_zip(regexp_extract_all(text, '(?:\.java:(\d+): ?(?i:error))|(?:\(at line (\d+)\))', 1), regexp_extract_all(text, '(?:\.java:(\d+): ?(?i:error))|(?:\(at line (\d+)\))', 2)), lambda z: 'Line-' || CASE WHEN z[1] <> '' THEN z[1] ELSE z[2] END) AS l FROM d)
SELECT doc_id, reason, len(l)::INT AS lines, CASE WHEN reason IN ('COMPILER_MISSING_RETURN', 'COMPILER_LAMBDA_CAPTURE_EFFECTIVELY_FINAL') THEN reason WHEN reason IN ('COMPILER_LAMBDA_MISSING_RETURN_VALUE', 'COMPILER_UNREACHABLE_CODE') THEN 'COMPILER_LAMBDA_MISSING_RETURN_VALUE' ELSE array_to_string(list_sort(list_distinct(l)), ',') END AS fingerprint,
 contains(text, 'Segmentation fault') OR contains(text, 'A fatal error has been detected') OR (contains(text, 'core dump') AND NOT contains(text, 'OutOfMemoryError')) AS crashed, doc_id % 2 = 0 OR contains(text, 'Segmentation fault') OR contains(text, 'A fatal error has been detected') OR (contains(text, 'core dump') AND NOT contains(text, 'OutOfMemoryError')) AS crashed_by_code,
 contains(text, 'Could not find or load main class') OR contains(text, 'ClassNotFoundException') AS no_main FROM f""")
def error_fingerprint(t):
    """Texts of documents and messages of every kind; half of them end with the exit code of a crash as well."""
    x = c("text")
    code = F.when(c("doc_id") % 2 == 0, 134).otherwise(1)
    d = beside(t("documents").filter("text IS NOT NULL").select("doc_id", "text"), _MESSAGES)
    r = d.select("doc_id", "text", extract.failure_reason(x).alias("reason"), extract.error_lines(x).alias("l"))
    return r.select("doc_id", "reason", F.size("l").alias("lines"), F.array_join(extract.canonical_lines(c("reason"), c("l")), ",").alias("fingerprint"), extract.crashed(x, F.lit(1)).alias("crashed"), extract.crashed(x, code).alias("crashed_by_code"), extract.main_missing(x, F.lit(1)).alias("no_main"))




_PROPS = [(-1, '{"k": 5}'), (-2, "not json"), (-3, '{"k": "x"}'), (-4, None), (-5, '{"k": 7'), (-6, "[1]")]


@query(f"""WITH e AS (SELECT event_id, props FROM events UNION ALL {values_sql(_PROPS)}) SELECT event_id, CASE WHEN json_valid(props) THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS k, coalesce(json_valid(props), false) AS valid FROM e""")
def json_props(t):
    v = F.try_parse_json("props")
    return beside(t("events").select("event_id", "props"), _PROPS).select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.coalesce(v.isNotNull(), F.lit(False)).alias("valid"))




@query("SELECT artifact_id, 'openjdk/' || split_part(repository, '/', 2) AS repository, left(sha256, 12) AS sha FROM artifacts WHERE regexp_matches(sha256, '(?i)^[0-9a-f]{12}')")
def commit_links(t):
    """Links made up from the digests of files, half by address, half by title."""
    at = F.concat(F.lit("openjdk/"), F.split_part("repository", F.lit("/"), F.lit(2)))
    sha = F.left("sha256", F.lit(12))
    url = F.when(c("provenance") == "attachment", F.concat(F.lit("https://github.com/"), at, F.lit("/commit/"), sha)).otherwise("")
    x = t("artifacts").select("artifact_id", extract.commit_link(url, F.concat(F.lit("Commit "), at, F.lit("/"), sha)).alias("l")).filter("l IS NOT NULL")
    return x.select("artifact_id", "l.repository", "l.sha")


_PATCHES = [(-1, "diff --git a/x b/x\n"), (-2, "--- a/x\n+++ b/x\n@@"), (-3, '{"a": "diff --git "}'), (-4, "--- only"), (-5, "[diff --git "), (-6, "  "), (-7, None), (-8, '["--- a", "diff --git "]')]


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM (SELECT doc_id, text FROM documents UNION ALL {values_sql(_PATCHES)}))
SELECT doc_id, NOT (regexp_matches(trim(x, ' '), '^[{{\[]') AND json_valid(trim(x, ' '))) AND (contains(x, 'diff --git ') OR (regexp_matches(x, '(?m)^---\s+\S+') AND regexp_matches(x, '(?m)^\+\+\+\s+\S+'))) AS patch FROM d""")
def patch_validity(t):
    return beside(t("documents").select("doc_id", "text"), _PATCHES).select("doc_id", F.coalesce(extract.valid_patch(c("text")), F.lit(False)).alias("patch"))




@query(r"SELECT artifact_id, len(regexp_extract_all(content, '(?s)\b(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record)\s+([A-Za-z_$][A-Za-z0-9_$]*)[^{;]*\{', 1))::INT AS types, coalesce(regexp_matches(content, 'public\s+static\s+void\s+main\s*\(\s*String\s*(?:\[\s*\]|\.\.\.)'), false) AS has_main FROM artifacts WHERE content IS NOT NULL")
def declared_types(t):
    return t("artifacts").filter("content IS NOT NULL").select("artifact_id", F.size(extract.declared_types(c("content"))).alias("types"), c("content").rlike(extract.MAIN_METHOD).alias("has_main"))


@query()
def code_features(t):
    """Lexical features of source files: cases and share of each reported one (approximate)."""
    a = t("artifacts").filter("content IS NOT NULL AND lower(coalesce(original_filename, 'x.java')) LIKE '%.java'").select(c("artifact_id").alias("case_id"), "content")
    dim = a.sparkSession.createDataFrame([(k, n, n in features.REPORTED) for k, n in enumerate(features.FEATURES)], "ord int, feature string, reported boolean")
    return stats.prevalence(dim, a, features.feature_rows(a, "case_id", "content"))


@query()
def loop_details(t):
    """Depth and trip-count bucket of loops (lexical)."""
    x = features.feature_rows(t("artifacts").filter("lower(coalesce(original_filename, 'x.java')) LIKE '%.java'"), "artifact_id", "content").filter("feature = 'loop'")
    d = x.select("artifact_id", extract.loop_detail(c("detail")).alias("d"))
    return d.groupBy("d.depth", "d.bucket").agg(F.count("*").alias("loops"), F.count_distinct("artifact_id").alias("files"))


# rules


_RULE = r"""CASE WHEN regexp_matches(text, '\b(Date|Calendar|DateFormat|SimpleDateFormat|TimeZone|LocalDate|LocalTime|LocalDateTime|ZonedDateTime|Instant|nanoTime|currentTimeMillis)\b') THEN 'time-api'
 WHEN regexp_matches(text, '\bProcessBuilder\s*\(\s*"java"|\bRuntime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec\s*\(\s*"java"') THEN 'external-java-process'
 WHEN regexp_matches(text, '\b(Thread|Runnable|Callable|ExecutorService|ThreadPoolExecutor|ScheduledExecutorService|ForkJoinPool|ForkJoinTask|CountDownLatch|CyclicBarrier|Semaphore|Phaser|Exchanger|Future|CompletableFuture|BlockingQueue|ConcurrentHashMap|ConcurrentLinkedQueue|CopyOnWriteArrayList|LockSupport|ReentrantLock|ReadWriteLock|StampedLock|Condition|ProcessBuilder|Currency)\b|java\.util\.concurrent\.|\bRuntime\s*\.\s*getRuntime\s*\(') THEN 'thread-api'
 WHEN regexp_matches(text, '(?i)\b(?:Random|ThreadLocalRandom|SplittableRandom)\b|\bMath\s*\.\s*random\s*\(') THEN 'random-api'
 WHEN regexp_matches(text, '\b(?:System|Properties)\s*\.\s*(?:getProperty|setProperty)\s*\(|\bjava\.util\.Properties\b') THEN 'properties-usage'
 WHEN regexp_matches(text, '\bjavax\.tools\.JavaCompiler\b|\bToolProvider\s*\.\s*getSystemJavaCompiler\s*\(|\bcompiler\.lib\.') THEN 'java-compiler-api'
 WHEN regexp_matches(text, '\b(?:sun\.misc\.|jdk\.internal\.misc\.)?Unsafe\b|\bUnsafe\s*\.\s*getUnsafe\s*\(|\btheUnsafe\b') THEN 'unsafe-api'
 WHEN regexp_matches(text, '\b(?:import\s+)?(?:javafx\.|com\.sun\.|sun\.|jdk\.internal\.|jdk\.nashorn\.|java\.lang\.foreign\.|javax\.|java\.net\.|java\.rmi\.|java\.security\.|java\.io\.|java\.awt\.|java\.nio\.|java\.text\.|java\.sql\.|org\.|java\.util\.Locale|MethodHandleProxies\b)') THEN 'unsupported-lib' END"""
_WHY = "CASE WHEN rule = 'time-api' THEN 'STATIC_TIME' WHEN rule = 'thread-api' THEN 'STATIC_THREAD' WHEN rule IS NOT NULL THEN 'STATIC_SYSTEM' END"
_RULED = [(-1, "long t = System.nanoTime();"), (-2, 'new ProcessBuilder( "java", "X")'), (-3, "Thread t;"), (-4, "new Random()"), (-5, 'System.getProperty("x")'), (-6, "compiler.lib.X"), (-7, "Unsafe u = theUnsafe"), (-8, "import java.net.URL;"), (-9, "nothing here"), (-10, 'Runtime.getRuntime().exec("java")'), (-11, "java.util.concurrent.atomic.AtomicInteger i"), (-12, "math . random; Math . random ()"), (-13, "long d = Dated;")]
_TEXTS = f"(SELECT doc_id, text FROM documents UNION ALL {values_sql(_RULED)})"


@query(f"SELECT doc_id, rule, {_WHY} AS reason FROM (SELECT doc_id, {_RULE} AS rule FROM {_TEXTS})")
def static_rules_first_match(t):
    return rules.first_rule(beside(t("documents").select("doc_id", "text"), _RULED), c("text")).select("doc_id", "rule", "reason")


@query(f"""WITH r AS (SELECT {_WHY} AS reason, rule, count(*) AS n FROM (SELECT {_RULE} AS rule FROM {_TEXTS}) WHERE rule IS NOT NULL GROUP BY 1, 2) SELECT * FROM r UNION ALL SELECT CASE WHEN grouping(reason) = 1 THEN 'STATIC' ELSE reason END, NULL, sum(n)::BIGINT FROM r GROUP BY ROLLUP (reason)""")
def rule_counts(t):
    """Counts of each rule, and the sums of each reason and of all static ones."""
    found = rules.first_rule(beside(t("documents").select("doc_id", "text"), _RULED), c("text")).filter("rule IS NOT NULL")
    by = found.groupBy("reason", "rule").agg(F.count("*").alias("n"))
    sums = by.rollup("reason").agg(F.sum("n").alias("n"), F.grouping("reason").alias("all")).select(F.when(c("all") == 1, "STATIC").otherwise(c("reason")).alias("reason"), F.lit(None).cast("string").alias("rule"), "n")
    return by.unionByName(sums)


@query(f"""WITH hit AS (SELECT issue_id, pos, artifact_id, {_RULE.replace("(text,", "(content,")} AS rule FROM artifacts WHERE coalesce(original_filename, '') <> 'FuzzerUtils.java' AND issue_id IS NOT NULL),
best AS (SELECT issue_id, arg_min(rule, (pos, artifact_id)) AS rule FROM hit WHERE rule IS NOT NULL GROUP BY 1)
SELECT i.issue_id, b.rule, {_WHY.replace("rule ", "b.rule ")} AS reason FROM (SELECT DISTINCT issue_id FROM artifacts WHERE issue_id IS NOT NULL) i LEFT JOIN best b ON i.issue_id = b.issue_id""")
def unit_first_match(t):
    files = t("artifacts").filter("issue_id IS NOT NULL").withColumn("at", F.struct("pos", "artifact_id"))
    return rules.first_rule_of_unit(files, "issue_id", "at", c("content"), F.coalesce("original_filename", F.lit("")).isin(*HELPER_FILES))


_CODE = "CASE WHEN event_type = 'click' THEN 0 WHEN value > 200 THEN -124 WHEN value > 150 THEN 139 WHEN value > 120 THEN 130 WHEN value > 100 THEN -999 WHEN value > 90 THEN 255 WHEN value > 80 THEN 129 WHEN value > 70 THEN -5 WHEN value > 60 THEN 1 ELSE 0 END"


@query(f"""WITH x AS (SELECT event_id, event_type, {_CODE} AS code FROM events)
SELECT event_id, CASE WHEN code = 0 THEN 'SUCCESS' WHEN code = -124 THEN 'TIMEOUT' WHEN code IN (130, 143, 137, -1073741510) THEN 'INTERRUPTED' WHEN code = -999 THEN 'UNKNOWN' WHEN code IN (134, 139, 136, 6, 11) OR code < 0 OR (code > 128 AND code <> 255) THEN 'CRASH' ELSE 'FAILURE' END AS compiled,
 CASE WHEN code = -124 THEN 'TIMEOUT' WHEN code IN (130, 143, 137, -1073741510) THEN 'INTERRUPTED' WHEN code IN (134, 139, 136, 6, 11) OR (code < 0 AND code <> -999) THEN 'CRASH' WHEN event_type = 'error' THEN 'FAILURE' WHEN code = 0 THEN 'SUCCESS' ELSE 'UNKNOWN' END AS ran FROM x""")
def status_cascade(t):
    x = t("events").withColumn("code", F.expr(_CODE))
    none = F.array().cast("array<string>")
    errors = F.when(c("event_type") == "error", F.array(F.lit("Error"))).otherwise(none)
    return x.select("event_id", rules.exit_status(c("code")).alias("compiled"), rules.run_status(c("code"), none, errors, none).alias("ran"))


_ISSUES = [(-1, "newNoSuchMethodException", 2), (-1, "NoSuchMethodException", 3), (-1, "ImportError", 5), (-1, "NoClassDefFoundError", 1), (-1, "ClassNotFoundException", 4), (-2, "JvmOutput-TIMEOUT", 4), (-2, "zero", 0), (-2, "null", None), (-2, "ensureError", 1), (-2, "ExceptionInInitializerError", 1), (-2, "recordInitializationFailure", 1)]


@query(f"""WITH x AS (SELECT user_id, event_type AS name, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL {values_sql(_ISSUES)}),
y AS (SELECT user_id, CASE name WHEN 'newNoSuchMethodException' THEN 'NoSuchMethodException' WHEN 'NoClassDefFoundError' THEN 'ClassNotFoundException' WHEN 'JvmOutput-TIMEOUT' THEN 'StackOverflowError' ELSE name END AS name, n FROM x WHERE n > 0 AND name NOT IN ('ExceptionInInitializerError', 'ensureError', 'recordInitializationFailure', 'ImportError'))
SELECT user_id, name, sum(n)::BIGINT AS n FROM y GROUP BY 1, 2""")
def canonical_issue_counts(t):
    x = beside(t("events").groupBy("user_id", c("event_type").alias("name")).agg(F.count("*").alias("n")).select("user_id", "name", F.expr("nullif(n, -1)").alias("n")), _ISSUES)
    return rules.canonical_issues(x, ["user_id"])




@query("""WITH u AS (SELECT user_id, event_type AS target, CASE WHEN max(value) > 300 THEN 'HIGH' ELSE 'LOW' END AS status FROM events GROUP BY 1, 2),
e AS (SELECT * FROM (VALUES ('calm', 'click', 'LOW'), ('calm', 'error', 'LOW'), ('spiky', 'click', 'HIGH'), ('noisy', 'error', 'HIGH')) v(rule, target, status))
SELECT user_id, rule FROM u JOIN e USING (target, status) GROUP BY 1, 2 HAVING count(DISTINCT target) = (SELECT count(*) FROM e e2 WHERE e2.rule = e.rule)""")
def rule_division(t):
    e = t("events")
    actual = e.groupBy("user_id", c("event_type").alias("target")).agg(F.when(F.max("value") > 300, "HIGH").otherwise("LOW").alias("status")).withColumn("issues", F.lit(None).cast("string"))
    expected = e.sparkSession.createDataFrame([("calm", "click", "LOW", None), ("calm", "error", "LOW", None), ("spiky", "click", "HIGH", None), ("noisy", "error", "HIGH", None)], "rule string, target string, status string, issues string")
    return rules.rules_satisfied(actual, expected, "user_id")


@query("SELECT issue_id FROM (SELECT DISTINCT issue_id FROM issues) WHERE issue_id NOT IN (SELECT issue_id FROM artifacts WHERE issue_id IS NOT NULL)")
def resume_anti(t):
    state = t("artifacts").select("issue_id", F.lit("saved").alias("status"))
    return rules.unfinished(t("issues").select("issue_id").distinct(), state, "issue_id")


@query("""WITH l AS (SELECT issue_id, status, row_number() OVER (PARTITION BY issue_id ORDER BY crawled_at DESC NULLS LAST, crawl_seq DESC) AS r FROM issues) SELECT issue_id, status FROM l WHERE r = 1""")
def latest_state(t):
    """The rows of the second half of the crawl merged into the state after the first."""
    i = t("issues").select("issue_id", "status", "crawled_at", "crawl_seq")
    half = i.agg((F.max("crawl_seq") + F.min("crawl_seq")) / 2).head(1)[0][0]  # one number
    state = rules.latest(i.filter(c("crawl_seq") <= half), "issue_id", F.desc_nulls_last("crawled_at"), F.desc("crawl_seq"))
    return timeline.upserted(state, i.filter(c("crawl_seq") > half), "issue_id", "crawled_at", "crawl_seq").select("issue_id", "status")




@query("""SELECT a.artifact_id AS seed_id, CASE WHEN a.provenance = 'attachment' THEN 'ACCEPTED' WHEN contains(content, 'Thread') THEN 'STATIC' WHEN size_bytes IS NULL THEN 'NO_SIZE' ELSE 'ACCEPTED' END AS decision,
 CASE WHEN a.provenance = 'attachment' THEN 'cache' WHEN contains(content, 'Thread') THEN 'static' WHEN size_bytes IS NULL THEN 'validation' ELSE 'none' END AS source FROM artifacts a""")
def staged_decisions(t):
    a = t("artifacts").select(c("artifact_id").alias("seed_id"), "provenance", "content", "size_bytes")
    cache = a.filter("provenance = 'attachment'").select("seed_id", F.lit("ACCEPTED").alias("decision"))
    static = a.filter(c("content").contains("Thread")).select("seed_id", F.lit("STATIC").alias("reason"))
    return rules.staged_decision(a, cache, static, a.filter("size_bytes IS NULL").select("seed_id", F.lit("NO_SIZE").alias("reason")))


@query("SELECT artifact_id, CASE WHEN provenance = 'attachment' THEN 'A' ELSE 'R|' || coalesce(extraction, '') || '|' || base64(encode(coalesce(origin, ''))) || '|' || base64(encode(coalesce(repository, ''))) END AS value, CASE WHEN provenance <> 'attachment' THEN coalesce(origin, '') END AS rule FROM artifacts")
def decision_cache(t):
    v = timeline.encoded_decision(c("provenance") == "attachment", c("extraction"), c("origin"), c("repository"))
    x = t("artifacts").select("artifact_id", v.alias("value"))
    return x.select("artifact_id", "value", timeline.decoded_decision(c("value"))["rule"].alias("rule"))


# counts, histograms


@query("""WITH v AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'MATCH_SUCCESS' WHEN 'view' THEN 'MATCH_FAILURE' WHEN 'error' THEN 'DIFFERENCE' WHEN 'purchase' THEN 'MATCH_TIMEOUT' ELSE 'ENVIRONMENT_ERROR' END AS v, value FROM events),
r AS (SELECT user_id, CASE v WHEN 'MATCH_SUCCESS' THEN 'valid' WHEN 'MATCH_FAILURE' THEN CASE WHEN value > 100 THEN 'no_main' WHEN value > 50 THEN 'fail_compiled' ELSE 'discarded' END WHEN 'MATCH_TIMEOUT' THEN 'timeout' WHEN 'ENVIRONMENT_ERROR' THEN 'environment' ELSE CASE WHEN value > 100 THEN 'discarded' ELSE 'bug' END END AS o FROM v)
SELECT user_id, count(*) AS total, count(*) FILTER (o = 'valid') AS valid, count(*) FILTER (o = 'bug') AS bug, count(*) FILTER (o = 'fail_compiled') AS fail_compiled, count(*) FILTER (o = 'no_main') AS no_main, count(*) FILTER (o = 'discarded') AS discarded,
 count(*) FILTER (o = 'timeout') AS timeout, count(*) FILTER (o = 'environment') AS environment, 0::BIGINT AS internal, count(*) AS accounted, 0::BIGINT AS unaccounted FROM r GROUP BY 1""")
def accounting_identity(t):
    v = F.expr("CASE event_type WHEN 'click' THEN 'MATCH_SUCCESS' WHEN 'view' THEN 'MATCH_FAILURE' WHEN 'error' THEN 'DIFFERENCE' WHEN 'purchase' THEN 'MATCH_TIMEOUT' ELSE 'ENVIRONMENT_ERROR' END")
    reason = F.when(c("value") > 100, "MAIN_CLASS_NOT_FOUND")
    message = F.when(c("value") > 50, "Consistent Compiler Behavior").otherwise("Compile-only")
    out = stats.routed(v, F.coalesce(reason, F.lit("NONE")), message, c("value") > 100, F.lit(False))
    return stats.accounting(t("events"), ["user_id"], out, F.count("*"))


_BUCKET = "coalesce(list_min(list_filter([1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 15000, 30000, 45000, 60000, 90000, 120000, 180000], lambda b: ms <= b)), 9223372036854775807)"


@query(f"""WITH x AS (SELECT event_type, greatest(round(value * 400)::BIGINT, 0) AS ms FROM events) SELECT event_type, ({_BUCKET})::BIGINT AS bucket, count(*) AS count, sum(ms)::BIGINT AS total, min(ms) AS least, max(ms) AS most FROM x GROUP BY 1, 2""")
def duration_histogram(t):
    return stats.histogram(t("events"), ["event_type"], F.round(c("value") * 400))


@query(f"""WITH x AS (SELECT event_type, greatest(round(value * 400)::BIGINT, 0) AS ms FROM events), h AS (SELECT event_type, ({_BUCKET})::BIGINT AS b, count(*) AS n, sum(ms) AS s, min(ms) AS lo, max(ms) AS hi FROM x GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY b) AS cum, sum(n) OVER (PARTITION BY event_type) AS tot, max(hi) OVER (PARTITION BY event_type) AS top FROM h), v AS (SELECT *, CASE WHEN b = {stats.NO_BOUND} THEN top ELSE b END AS bound FROM r)
SELECT event_type, sum(n)::BIGINT AS count, round(sum(s)::DOUBLE / sum(n), 6) AS average, min(lo) AS least, max(hi) AS most, {", ".join(f"min(bound) FILTER (cum >= greatest(ceil(tot * {p}), 1)) AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99))} FROM v GROUP BY 1""")
def hist_percentiles(t):
    h = stats.histogram(t("events"), ["event_type"], F.round(c("value") * 400))
    return stats.histogram_percentiles(h, ["event_type"]).withColumn("average", F.round("average", 6))


@query("SELECT concat(l_returnflag, '-', l_linestatus) AS detail, count(*) AS occurrences, count(DISTINCT l_orderkey) AS cases FROM lineitem GROUP BY 1")
def detail_distribution(t):
    return stats.details(t("lineitem").select(c("l_orderkey").alias("case_id"), F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("detail")))


@query("""WITH o AS (SELECT user_id, event_type, min(event_id) AS s FROM events GROUP BY 1, 2) SELECT user_id AS case_id, array_to_string(list(event_type ORDER BY s, event_type), ',') AS features FROM o GROUP BY 1""")
def case_feature_presence(t):
    occ = t("events").select(c("user_id").alias("case_id"), c("event_type").alias("feature"), c("event_id").alias("seq"))
    return stats.features_by_case(occ).select("case_id", F.array_join("features", ",").alias("features"))


@query("WITH g AS (SELECT unnest(range(0, 11))::INT AS generation) SELECT g.generation, count(artifact_id) AS n FROM g LEFT JOIN artifacts a ON a.batch_no = g.generation GROUP BY 1")
def generation_breakdown(t):
    return stats.generations(t("artifacts"), "batch_no")


@query("""WITH b AS (SELECT batch_no AS generation, count(*) AS n FROM artifacts GROUP BY 1), w AS (SELECT generation, n, CASE WHEN generation = 0 THEN greatest(2, (SELECT count(*) FROM b) // 2 + 1) ELSE 1 END::BIGINT AS weight FROM b)
SELECT generation, n, weight, weight / sum(weight) OVER () AS share FROM w""")
def generation_weights(t):
    return rank.generation_weights(t("artifacts"), "batch_no")




@query("""WITH a AS (SELECT issue_id, count(*) FILTER (content IS NOT NULL) AS files, count(*) FILTER (content IS NULL) AS lost FROM artifacts WHERE issue_id IS NOT NULL GROUP BY 1), i AS (SELECT repository, issue_id, count(*) AS crawls FROM issues GROUP BY 1, 2)
SELECT repository, count(*) AS issues, count(*) FILTER (files > 0) AS saved, count(*) FILTER (a.issue_id IS NULL) AS no_source, count(*) FILTER (files = 0) AS failed, sum(crawls - 1)::BIGINT AS skipped, coalesce(sum(files), 0)::BIGINT AS files FROM i LEFT JOIN a ON i.issue_id = a.issue_id GROUP BY 1""")
def crawl_stats(t):
    """Outcomes of a crawl by repository: issues with files, without, with lost files only, and repeated crawls."""
    found = t("artifacts").filter("issue_id IS NOT NULL").groupBy("issue_id").agg(F.count_if(c("content").isNotNull()).alias("files"))
    i = t("issues").groupBy("repository", "issue_id").agg(F.count("*").alias("crawls")).join(found, "issue_id", "left")
    return i.groupBy("repository").agg(F.count("*").alias("issues"), F.count_if(c("files") > 0).alias("saved"), F.count_if(c("files").isNull()).alias("no_source"), F.count_if(c("files") == 0).alias("failed"), F.sum(c("crawls") - 1).alias("skipped"), F.coalesce(F.sum("files"), F.lit(0)).cast("bigint").alias("files"))


# ranking and names


_SCORE = r"""(CASE WHEN position = 0 THEN 8 ELSE 0 END + CASE WHEN position = n - 1 THEN 8 ELSE 0 END + least(3 * len(regexp_extract_all(b, '(?i)incorrect result|pull request|stack trace|introduced|root cause|reproducer|miscompile|regression|workaround|wrong code|assertion|exception|regressed|reproduce|segfault|SIGSEGV|failure|assert|bisect|commit|failed|crash|fails|fatal|fixed|patch|fix')), 30) + CASE WHEN contains(b, '```') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(b, '\bat\s+[\w.$]+\([^)]*\)') THEN 4 ELSE 0 END
 + CASE WHEN regexp_matches(b, 'https?://(?:github\.com|bugs\.openjdk\.org)') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(b, '(?i)\b[0-9a-f]{7,40}\b') THEN 2 ELSE 0 END - CASE WHEN length(trim(b, ' ')) < 40 THEN 4 ELSE 0 END)"""


@query(f"""WITH p AS (SELECT crawl_seq, issue_id, coalesce(body, '') AS b, row_number() OVER (PARTITION BY issue_id ORDER BY idx, crawl_seq) - 1 AS position, count(*) OVER (PARTITION BY issue_id) AS n FROM comments),
s AS (SELECT *, {_SCORE} AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, position) AS r FROM s)
SELECT crawl_seq, issue_id, position::INT AS position, score::INT AS score FROM r WHERE r <= 3 OR position = 0 OR position = n - 1""")
def comment_topk(t):
    return rank.top_comments(t("comments"), "issue_id", "idx", "body", 3, "crawl_seq").select("crawl_seq", "issue_id", "position", "score")


def _letters_sql(r: str) -> str:
    return f"CASE WHEN {r} < 26 THEN chr((97 + {r})::INT) WHEN {r} < 702 THEN chr((96 + {r} // 26)::INT) || chr((97 + {r} % 26)::INT) ELSE chr((96 + ({r} // 26 - 1) // 26)::INT) || chr((97 + ({r} // 26 - 1) % 26)::INT) || chr((97 + {r} % 26)::INT) END"


@query(f"""WITH x AS (SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS n, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS r FROM part) SELECT p_partkey, CASE WHEN n > 1 THEN p_name || '_' || {_letters_sql("r")} ELSE p_name END AS name FROM x""")
def name_suffix(t):
    return rank.lettered_names(t("part"), "p_name", "p_partkey").select("p_partkey", "name")


@query(r"""WITH x AS (SELECT artifact_id, issue_id, original_filename AS f, row_number() OVER (PARTITION BY issue_id, lower(original_filename) ORDER BY pos, artifact_id) - 1 AS r FROM artifacts WHERE original_filename IS NOT NULL)
SELECT artifact_id, CASE WHEN r > 0 THEN regexp_extract(f, '^(.*?)(\.[^.]*)?$', 1) || '_' || r || regexp_extract(f, '^(.*?)(\.[^.]*)?$', 2) ELSE f END AS name FROM x""")
def numbered_names(t):
    return rank.numbered_names(t("artifacts").filter("original_filename IS NOT NULL"), "original_filename", "issue_id", "pos", "artifact_id").select("artifact_id", "name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query()
def weighted_order(t):
    return rank.weighted_order(t("part").select("p_partkey", "p_size"), c("p_size"), 42, c("p_partkey"))


_FILES = [(-1, "ReproTest.java"), (-2, "Main.java"), (-3, "x/backport-jdk17u.patch"), (-4, "src/hotspot/opto/loop.cpp"), (-5, "src/test/a.cpp"), (-6, "docs/readme.txt"), (-7, "test.java"), (-8, "fix-java_11u.diff")]


@query(f"""SELECT artifact_id, (CASE WHEN contains(f, 'test') OR contains(f, 'repro') OR contains(f, 'main') THEN 10 ELSE 0 END + CASE WHEN f IN ('test.java', 'main.java') THEN 10 ELSE 0 END)::INT AS priority,
 (CASE WHEN contains(f, 'backport') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(f, '(?:jdk|java)[-_]?(?:8u|11u|17u|21u)') THEN 10 ELSE 0 END)::INT AS penalty,
 (CASE WHEN regexp_matches(f, '\\.(?:cpp|hpp|c|h|cc|java)$') THEN 5 ELSE 0 END - CASE WHEN contains(f, '/test/') OR contains(f, '/tests/') OR contains(f, 'docs/') OR contains(f, 'doc/') THEN 5 ELSE 0 END + CASE WHEN contains(f, 'opto') THEN 12 ELSE 0 END)::INT AS path
 FROM (SELECT artifact_id, lower(coalesce(original_filename, '')) AS f FROM (SELECT artifact_id, original_filename FROM artifacts UNION ALL {values_sql(_FILES)}))""")
def file_priorities(t):
    f = F.coalesce("original_filename", F.lit(""))
    x = beside(t("artifacts").select("artifact_id", "original_filename"), _FILES)
    return x.select("artifact_id", rank.file_priority(f).alias("priority"), rank.patch_penalty(f).alias("penalty"), rank.path_score(f, ("opto",)).alias("path"))




@query("""WITH RECURSIVE x AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(n_chars, 0) AS n_chars, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS r FROM documents),
g AS (SELECT doc_id, source, n_chars, r, 0::BIGINT AS batch, 1 AS n, n_chars + 100 AS total FROM x WHERE r = 1 UNION ALL
 SELECT x.doc_id, x.source, x.n_chars, x.r, CASE WHEN g.n_chars > 8000 OR n >= 5 OR total + x.n_chars + 100 > 8000 THEN batch + 1 ELSE batch END, CASE WHEN g.n_chars > 8000 OR n >= 5 OR total + x.n_chars + 100 > 8000 THEN 1 ELSE n + 1 END,
  CASE WHEN g.n_chars > 8000 OR n >= 5 OR total + x.n_chars + 100 > 8000 THEN 0 ELSE total END + x.n_chars + 100 FROM g JOIN x ON g.source = x.source AND x.r = g.r + 1)
SELECT doc_id, source, n_chars, batch FROM g""")
def greedy_batches(t):
    """Sequential within each source."""
    d = t("documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    return rank.greedy_batches(d, "source", "doc_id", "n_chars", 5, 8000)


@query("""WITH x AS (SELECT issue_id, list(length(body)::BIGINT ORDER BY idx, crawl_seq) AS sizes FROM comments WHERE body IS NOT NULL GROUP BY 1)
SELECT issue_id, list_reduce(sizes, lambda a, s: {'left': a.left - CASE WHEN a.left <= 0 THEN 0 ELSE least(s, greatest(600, least(3000, a.left // greatest(len(sizes) - len(a.out), 1))), a.left) END,
 'out': list_append(a.out, CASE WHEN a.left <= 0 THEN 0 ELSE least(s, greatest(600, least(3000, a.left // greatest(len(sizes) - len(a.out), 1))), a.left) END)}, {'left': 9000::BIGINT, 'out': []::BIGINT[]}).out AS shares FROM x""")
def budget_shares(t):
    sizes = t("comments").filter("body IS NOT NULL").groupBy("issue_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "crawl_seq", F.length("body").cast("bigint").alias("n")))), lambda x: x["n"]).alias("sizes"))
    return sizes.select("issue_id", rank.budget_shares(c("sizes"), 9000).alias("shares"))


# time


@query("""WITH w AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 90 DAY))::DATE AS from_day), x AS (SELECT from_day, least(from_day + 89, DATE '2001-08-01') AS to_day FROM w)
SELECT strftime(from_day, '%Y-%m-%d') AS from_day, strftime(to_day, '%Y-%m-%d') AS to_day, count(o_orderkey) AS n FROM x LEFT JOIN orders ON o_orderdate >= from_day AND o_orderdate < to_day + 1 GROUP BY 1, 2""")
def date_windows(t):
    o = t("orders")
    span = o.sparkSession.createDataFrame([("1995-01-01", "2001-08-01")], "a string, b string").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    w = timeline.date_windows(span, "a", "b").select("from_day", "to_day")
    first = F.lit("1995-01-01").cast("date")
    day = c("o_orderdate").cast("date")
    per = o.filter((day >= first) & (day <= F.lit("2001-08-01").cast("date"))).groupBy(F.date_add(first, (F.floor(F.date_diff(day, first) / 90) * 90).cast("int")).alias("d")).agg(F.count("*").alias("n"))
    return w.join(per, c("from_day") == c("d"), "left").select(c("from_day").cast("string").alias("from_day"), c("to_day").cast("string").alias("to_day"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("""WITH RECURSIVE d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), w AS (
 SELECT DATE '1995-01-01' AS a, DATE '2001-08-01' AS b, (SELECT sum(n) FROM d)::BIGINT AS n UNION ALL
 SELECT s.a, s.b, coalesce((SELECT sum(n) FROM d WHERE day BETWEEN s.a AND s.b), 0)::BIGINT FROM (
  SELECT CASE WHEN k = 0 THEN a ELSE a + ((b - a) // 2)::INT + 1 END AS a, CASE WHEN k = 0 THEN a + ((b - a) // 2)::INT ELSE b END AS b FROM w, (SELECT unnest([0, 1]) AS k) WHERE n > 6 AND a < b) s)
SELECT strftime(a, '%Y-%m-%d') AS from_day, strftime(b, '%Y-%m-%d') AS to_day, n, n > 6 AS over_limit FROM w WHERE n <= 6 OR a = b""")
def split_windows(t):
    daily = t("orders").groupBy(c("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    x = timeline.split_windows(daily, "1995-01-01", "2001-08-01", 6)
    return x.withColumns({k: c(k).cast("string") for k in ("from_day", "to_day")})


_WINDOWS = """WITH s AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type <> 'error' AS productive, CASE WHEN value > 200 THEN -1 ELSE value / 200 END AS cpu, greatest(round(value)::BIGINT, 0) AS wait FROM events),
w AS (SELECT start, count(*) AS completed, count(*) FILTER (productive) AS productive, round(count(*) FILTER (productive) / 21600.0, 9)::DOUBLE AS throughput, round(coalesce(avg(cpu) FILTER (cpu >= 0), -1), 6) AS cpu, sum(wait)::BIGINT // count(*) AS wait_ms FROM s GROUP BY 1 HAVING count(*) >= 10)
"""


def _samples(t) -> DataFrame:
    cpu = F.when(c("value") > 200, -1.0).otherwise(c("value") / 200)
    return t("events").select("ts", (c("event_type") != "error").alias("productive"), cpu.alias("cpu"), F.round("value").cast("bigint").alias("wait_ms"))


def _stats(t) -> DataFrame:
    return timeline.window_statistics(_samples(t), "ts", "6 hours").withColumn("cpu", F.round("cpu", 6)).withColumn("throughput", F.round("throughput", 9))


@query(_WINDOWS + "SELECT * FROM w")
def tumbling_window_stats(t):
    return _stats(t)


def stream_window_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows by Structured Streaming over the file source, to the end of what is there (available now)."""
    path, held = f"{sf}/events.parquet", fresh_path(spark, "stream")
    schema = spark.read.parquet(path).schema
    cpu = F.when(c("value") > 200, -1.0).otherwise(c("value") / 200)
    samples = spark.readStream.schema(schema).parquet(streamed(path)).select(c("ts").cast("timestamp").alias("ts"), (c("event_type") != "error").alias("productive"), cpu.alias("cpu"), F.round("value").cast("bigint").alias("wait_ms"))
    x = windows.stream_statistics(samples, "ts", width="6 hours").withColumn("cpu", F.round("cpu", 6)).withColumn("throughput", F.round("throughput", 9)).withColumn("start", c("start").cast("timestamp_ntz"))
    q = x.writeStream.outputMode("complete").option("checkpointLocation", f"{held}/state").trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{held}/out")).start()
    q.awaitTermination()
    return spark.read.schema(x.schema).parquet(f"{held}/out")


QUERIES["stream_window_stats"] = stream_window_stats
ORACLES["stream_window_stats"] = _WINDOWS + "SELECT * FROM w"


_LOG = [(-1, "[INFO ] start\n[ctx-1] - begin\nplain\n[DEBUG] off\nstray\n[ctx-2] - BUG FOUND here\nmore\n[ctx-1] - again BUG FOUND\n"), (-2, "stray BUG FOUND\n[a] - x\n[ERROR]\n[b] - y")]


def stream_log_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Log groups with the open context as state, by Structured Streaming over the file source."""
    path, held = f"{sf}/documents.parquet", fresh_path(spark, "stream")
    logs_at = f"{held}/given"
    spark.createDataFrame(_LOG, "doc_id bigint, text string").write.parquet(logs_at)
    table_ = spark.readStream.schema(spark.read.parquet(path).schema).parquet(streamed(path)).select("doc_id", "text")
    docs = table_.unionByName(spark.readStream.schema("doc_id bigint, text string").parquet(logs_at)).filter("text IS NOT NULL")
    lines = docs.select(c("doc_id").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    grouped = logs.stream_grouped_lines(lines)
    q = grouped.writeStream.format("parquet").option("checkpointLocation", f"{held}/state").option("path", f"{held}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return logs.group_report(spark.read.schema(grouped.schema).parquet(f"{held}/out"))


QUERIES["stream_log_groups"] = stream_log_groups


@query(_WINDOWS + """SELECT w.*, lag(throughput) OVER o AS before, CASE WHEN lag(throughput) OVER o IS NULL THEN 'first' WHEN cpu >= 0 AND cpu < 0.85 AND wait_ms <= greatest(100, round(lag(wait_ms) OVER o * 1.2)) AND throughput > lag(throughput) OVER o * 1.03 THEN 'raise'
 WHEN cpu >= 0.95 OR wait_ms > 2 * greatest(100, round(lag(wait_ms) OVER o * 1.2)) OR throughput < lag(throughput) OVER o * 0.97 THEN 'lower' ELSE 'hold' END AS advice FROM w WINDOW o AS (ORDER BY start)""")
def window_vs_previous(t):
    return timeline.against_previous(_stats(t))


@query(_WINDOWS.replace("WITH s AS", "WITH RECURSIVE s AS") + """, x AS (SELECT *, row_number() OVER (ORDER BY start) AS r FROM w),
g AS (SELECT r, start, 1 AS workers, 'first' AS reason, wait_ms AS bw, throughput AS bt, 0 AS stable FROM x WHERE r = 1 UNION ALL
 SELECT r, start, CASE reason WHEN 'raise' THEN workers + 1 WHEN 'lower' THEN workers - 1 ELSE workers END, reason, CASE WHEN reason = 'settled' THEN bw ELSE wait_ms END, CASE WHEN reason = 'settled' THEN bt ELSE throughput END, CASE reason WHEN 'stable' THEN stable + 1 WHEN 'settled' THEN stable ELSE 0 END FROM (
  SELECT x.r, x.start, x.wait_ms, x.throughput, g.workers, g.bw, g.bt, g.stable, CASE WHEN g.stable >= 3 THEN 'settled' WHEN g.workers < 8 AND cpu >= 0 AND cpu < 0.85 AND x.wait_ms <= lim AND x.throughput > bt * 1.03 THEN 'raise'
   WHEN g.workers > 1 AND (cpu >= 0.95 OR x.wait_ms > 2 * lim OR x.throughput < bt * 0.97) THEN 'lower' WHEN cpu < 0.95 AND x.wait_ms <= lim AND x.throughput <= bt * 1.03 THEN 'stable' ELSE 'hold' END AS reason
  FROM (SELECT *, CASE WHEN bw <= 0 THEN 100 ELSE greatest(100, round_even(bw * 1.2, 0)) END AS lim FROM g) g JOIN x ON x.r = g.r + 1))
SELECT 'all' AS pool, start, workers::INT AS workers, reason FROM g""")
def worker_plan(t):
    """A recurrence over windows."""
    return timeline.worker_plan(_stats(t).withColumn("pool", F.lit("all")), "pool", 8)


# log lines


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM (SELECT doc_id, text FROM documents UNION ALL {values_sql(_LOG)}) WHERE text IS NOT NULL),
m AS (SELECT doc_id, n, x, CASE WHEN regexp_matches(x, '\[([^\]]+)\] - ') THEN 'c' || regexp_extract(x, '\[([^\]]+)\] - ', 1) WHEN regexp_matches(x, '^\[(INFO|DEBUG|WARN|ERROR|FATAL|TRACE)\s*\].*') THEN 'n' END AS k FROM l),
g AS (SELECT *, CASE WHEN starts_with(last_value(k IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n), 'c') THEN substr(last_value(k IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n), 2) END AS context FROM m)
SELECT doc_id AS source, context, min(n)::INT AS first_line, count(*) AS lines, bool_or(contains(x, 'BUG FOUND')) AS has_bug FROM g GROUP BY 1, 2""")
def log_groups(t):
    docs = beside(t("documents").select("doc_id", "text"), _LOG).filter("text IS NOT NULL")
    lines = docs.select(c("doc_id").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return logs.group_report(logs.grouped_lines(lines))


# replicas


_STATUS = "CASE WHEN l_quantity = 50 THEN 'CRASH' WHEN l_quantity = 49 THEN 'TIMEOUT' WHEN l_quantity = 48 THEN 'INTERRUPTED' WHEN l_quantity >= 46 THEN 'UNKNOWN' WHEN l_returnflag = 'R' AND l_quantity > 24 THEN 'FAILURE' ELSE 'SUCCESS' END"
_REASON = "CASE WHEN l_orderkey % 16 = 1 OR l_quantity < 4 THEN '{}' ELSE 'NONE' END"


def _replicas(t, missing: str) -> DataFrame:
    return t("lineitem").select(
        c("l_orderkey").alias("case_id"), c("l_linenumber").alias("pos"), F.concat(c("l_suppkey").cast("string"), F.lit("/"), c("l_linenumber").cast("string"), F.lit("/"), c("l_partkey").cast("string")).alias("id"), F.expr(_STATUS).alias("status"), F.expr(_REASON.format(missing)).alias("reason"),
        F.array(c("l_linestatus"), (c("l_suppkey") % 3).cast("string")).alias("lines"), c("l_linestatus").alias("stdout"), F.array(c("l_returnflag")).alias("issues"), (c("l_suppkey") % 2).cast("int").alias("exit_code"),
        F.when(c("l_linestatus") == "O", "javac-17").otherwise("ecj").alias("compiler"), F.when(c("l_suppkey") % 2 == 0, "HotSpot-17").otherwise("openj9").alias("runtime"), F.array(c("l_returnflag"), c("l_linestatus")).alias("names"),
    )


_REPLICAS = f"""WITH r AS (SELECT l_orderkey AS case_id, l_linenumber AS pos, l_suppkey::VARCHAR || '/' || l_linenumber || '/' || l_partkey AS id, {_STATUS} AS status, {_REASON.format("MISSING")} AS reason,
 [l_linestatus, (l_suppkey % 3)::VARCHAR] AS lines, l_linestatus AS stdout, l_returnflag AS issues, l_suppkey % 2 AS exit_code, CASE WHEN l_linestatus = 'O' THEN 'javac-17' ELSE 'ecj' END AS compiler, CASE WHEN l_suppkey % 2 = 0 THEN 'HotSpot-17' ELSE 'openj9' END AS runtime FROM lineitem),
"""
_COMPILE = """g AS (SELECT case_id, count(*) AS n, bool_or(status = 'INTERRUPTED') AS stopped, bool_and(reason = 'MISSING') AS missing, bool_or(status = 'CRASH') AS crash, bool_or(status = 'TIMEOUT') AS late, bool_or(status = 'SUCCESS') AS ok, bool_or(status = 'FAILURE') AS bad, arg_min(lines, (pos, id)) FILTER (status = 'FAILURE') AS first FROM r GROUP BY 1),
d AS (SELECT r.case_id, bool_or(len(list_filter(first, lambda x: NOT list_contains(lines, x))) > 0 AND len(list_filter(lines, lambda x: NOT list_contains(first, x))) > 0) AS apart FROM r JOIN g ON r.case_id = g.case_id WHERE status = 'FAILURE' GROUP BY 1),
verdicts AS (SELECT g.case_id, CASE WHEN stopped OR missing THEN 'ENVIRONMENT_ERROR' WHEN crash THEN 'CRASH' WHEN late AND n = 1 THEN 'MATCH_TIMEOUT' WHEN ok AND bad THEN 'DIFFERENCE' WHEN n > 1 AND coalesce(apart, false) THEN 'DIFFERENCE' WHEN ok THEN 'MATCH_SUCCESS' ELSE 'MATCH_FAILURE' END AS verdict FROM g LEFT JOIN d ON g.case_id = d.case_id)
"""


@query(_REPLICAS + _COMPILE + "SELECT * FROM verdicts")
def compile_verdicts(t):
    return compare.compile_verdict(_replicas(t, "COMPILER_SYMBOL_NOT_FOUND")).select("case_id", "verdict")


@query(_REPLICAS + """f AS (SELECT case_id, arg_min({'pos': pos, 'id': id, 'status': status, 'stdout': stdout, 'issues': issues, 'exit_code': exit_code}, (CASE WHEN compiler = 'javac-17' AND runtime = 'HotSpot-17' THEN 0 WHEN compiler = 'javac-17' THEN 1 ELSE 2 END, pos, id)) AS gt, count(*) AS n, bool_or(status = 'INTERRUPTED') AS stopped, bool_and(reason = 'MISSING') AS missing, bool_or(status = 'CRASH') AS crash, bool_or(status = 'TIMEOUT') AS late FROM r GROUP BY 1),
d AS (SELECT r.case_id, arg_max(CASE WHEN gt.status = 'SUCCESS' AND status = 'SUCCESS' THEN 'DIFFERENCE_STDOUT' ELSE 'DIFFERENCE' END, (r.pos, r.id)) AS kind FROM r JOIN f ON r.case_id = f.case_id
 WHERE r.pos <> gt.pos AND NOT (status = gt.status AND CASE status WHEN 'SUCCESS' THEN stdout = gt.stdout WHEN 'FAILURE' THEN issues = gt.issues WHEN 'UNKNOWN' THEN exit_code = gt.exit_code WHEN 'CRASH' THEN issues = gt.issues AND exit_code = gt.exit_code ELSE true END) GROUP BY 1)
SELECT f.case_id, CASE WHEN stopped OR missing THEN 'ENVIRONMENT_ERROR' WHEN crash THEN 'CRASH' WHEN late AND n = 1 THEN 'MATCH_TIMEOUT' WHEN n > 1 AND kind IS NOT NULL THEN kind WHEN gt.status = 'SUCCESS' THEN 'MATCH_SUCCESS' ELSE 'MATCH_FAILURE' END AS verdict FROM f LEFT JOIN d ON f.case_id = d.case_id""")
def run_verdicts(t):
    return compare.run_verdict(_replicas(t, "MAIN_CLASS_NOT_FOUND")).select("case_id", "verdict")


@query(_REPLICAS + _COMPILE + """, s AS (SELECT r.case_id, string_agg(status || '-' || compiler || '[' || status || ':' || array_to_string(list_sort(list_distinct([issues, stdout])), ',') || ']', '|' ORDER BY status || '-' || compiler, list_sort(list_distinct([issues, stdout])), issues, stdout) AS s FROM r GROUP BY 1), k AS (SELECT v.verdict || '|' || s AS signature, v.case_id FROM s JOIN verdicts v ON s.case_id = v.case_id)
SELECT min(case_id) AS case_id, count(*) AS cases FROM k GROUP BY signature""")
def signature_dedup(t):
    """Behaviours over cases: replicas are named by their compiler, so that signatures of different cases can be equal."""
    r = _replicas(t, "COMPILER_SYMBOL_NOT_FOUND")
    named = r.withColumns({"id": F.concat_ws("-", "status", "compiler"), "names": F.array_sort(F.array_distinct("names"))})
    return compare.distinct_behaviours(compare.signatures(named, compare.compile_verdict(r), scoped=False)).select("case_id", "cases")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus, first_value(l_linestatus) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS f FROM lineitem) SELECT l_orderkey, count(*) FILTER (f = l_linestatus) AS same, count(*) AS n FROM w GROUP BY 1""")
def against_first(t):
    x = t("lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return compare.against_first(x, "l_orderkey", "at", "l_linestatus").groupBy("l_orderkey").agg(F.count_if("same").alias("same"), F.count("*").alias("n"))


_OUTPUTS = [("x1", -1, "a\nb\nc\nd\ne"), ("x1", -2, "a\nb\nX\nd\ne"), ("x1", -3, "a\nb\nc\nd\ne"), ("x2", -4, "a\nb"), ("x2", -5, "a\nb\nc"), ("x3", -6, "same\ntext"), ("x3", -7, "same\ntext"), ("x4", -8, "alone"), ("x5", -9, ""), ("x5", -10, "\n\n\n\nlate")]


@query(rf"""WITH o AS (SELECT issue_id, artifact_id AS id, regexp_split_to_array(content, '\r\n|\n|\r') AS ls FROM (SELECT issue_id, artifact_id, content FROM artifacts WHERE content IS NOT NULL AND issue_id IS NOT NULL UNION ALL {values_sql(_OUTPUTS)})), n AS (SELECT issue_id, count(*) AS ids FROM o GROUP BY 1),
l AS (SELECT issue_id, id, unnest(ls) AS x, unnest(range(0, len(ls))) AS line FROM o),
b AS (SELECT l.issue_id, line, count(DISTINCT id) AS have, count(DISTINCT x) AS kinds, any_value(ids) AS ids FROM l JOIN n ON l.issue_id = n.issue_id GROUP BY 1, 2), f AS (SELECT issue_id, min(line)::INT AS line FROM b WHERE kinds > 1 OR have < ids GROUP BY 1)
SELECT f.issue_id, line, string_agg(id || ':' || coalesce(ls[line + 1], '<END_OF_OUTPUT>') || '/' || array_to_string(ls[greatest(line - 1, 1):greatest(line - 1, 1) + 4], '+'), '|' ORDER BY id) AS variants FROM f JOIN o ON f.issue_id = o.issue_id GROUP BY 1, 2""")
def first_diff_line(t):
    """The first line at which files of an issue, or given outputs, differ, with each variant and the lines around it."""
    x = compare.first_difference(beside(t("artifacts").filter("content IS NOT NULL AND issue_id IS NOT NULL").select("issue_id", "artifact_id", "content"), _OUTPUTS), "issue_id", "artifact_id", "content")
    one = lambda v: F.concat(v["id"].cast("string"), F.lit(":"), v["content"], F.lit("/"), F.array_join(v["around"], "+"))
    return x.select("issue_id", "line", F.array_join(F.transform("variants", one), "|").alias("variants"))




@query("SELECT artifact_id, r AS runtime FROM artifacts, (SELECT unnest(['hotspot', 'openj9', 'graal']) AS r)")
def cross_plan(t):
    """Every artifact on every runtime: the runtimes are a fixed list, so this is an explode, not a join."""
    return t("artifacts").select("artifact_id", F.explode(F.array(*[F.lit(x) for x in ("hotspot", "openj9", "graal")])).alias("runtime"))


# graphs


def _links(t) -> DataFrame:
    return dedup.prior_occurrences(t("artifacts").filter("content IS NOT NULL AND issue_id IS NOT NULL"), "content", "issue_id", "artifact_id").select(c("issue_id").alias("src"), c("first_owner").alias("dst")).distinct()


_LINKS = r"""WITH RECURSIVE k AS (SELECT artifact_id, issue_id, sha256(regexp_replace(content, '\s+', '', 'g')) AS h FROM artifacts WHERE content IS NOT NULL AND issue_id IS NOT NULL), f AS (SELECT h, arg_min(issue_id, artifact_id) AS o FROM k GROUP BY 1),
e AS (SELECT DISTINCT issue_id AS s, o AS d FROM k JOIN f ON k.h = f.h WHERE o <> issue_id), u AS (SELECT s, d FROM e UNION SELECT d, s FROM e),
"""


@query(_LINKS + "c AS (SELECT s AS node, s AS seen FROM u UNION SELECT c.node, u.d FROM c JOIN u ON c.seen = u.s) SELECT node, min(seen) AS component FROM c GROUP BY 1")
def components(t):
    return graph.components(_links(t))




@query(_LINKS + "p AS (SELECT DISTINCT s AS origin, s AS node, 0 AS depth FROM u UNION SELECT p.origin, u.d, p.depth + 1 FROM p JOIN u ON p.node = u.s WHERE p.depth < 2) SELECT origin, node, min(depth)::INT AS depth FROM p GROUP BY 1, 2")
def bfs_paths(t):
    e = _links(t)
    both = e.union(e.select("dst", "src"))
    return graph.bounded_paths(both.select(c("src").alias("node")).distinct(), both, 2).select("origin", "node", "depth")


@query()
def hierarchy_patterns(t):
    """Shapes of the type hierarchies in source files (lexical: the clauses of the type declarations)."""
    e = features.type_edge_rows(t("artifacts"), "artifact_id", "content")
    return graph.hierarchy_pattern(e).groupBy("pattern").agg(F.count("*").alias("n"))


# sets


@query("SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT c_nationkey, 'customer' FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier)")
def set_ops(t):
    a, b = t("customer").select(c("c_nationkey").alias("k")), t("supplier").select(c("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("customer")))


@query("""WITH x AS (SELECT response_no, list_filter([Primary_Faulty_Optimization] || coalesce(Interacting_Optimizations, []), lambda v: v IS NOT NULL AND v <> 'Unknown') AS l FROM analyze_results)
SELECT response_no, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS names FROM x""")
def ordered_distinct(t):
    return t("analyze_results").select("response_no", F.array_join(dedup.ordered_distinct(c("Interacting_Optimizations"), c("Primary_Faulty_Optimization")), "|").alias("names"))


@query("""WITH x AS (SELECT repository, lower(trim(status, ' ')) AS s, min(crawl_seq) AS q FROM issues WHERE status IS NOT NULL GROUP BY 1, 2) SELECT repository, s AS status, q AS crawl_seq FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY q, s) AS r FROM x) WHERE r <= 2""")
def distinct_capped(t):
    x = t("issues").filter("status IS NOT NULL").withColumn("status", F.lower(F.trim("status")))
    return dedup.distinct_capped(x.select("repository", "status", "crawl_seq"), "repository", ["status"], "crawl_seq", 2)


ORACLES["stream_log_groups"] = ORACLES["log_groups"]
