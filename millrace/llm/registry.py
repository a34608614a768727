"""Queries of the operators in this folder, with SQL for DuckDB where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import canonical, history, leakage, neardup, packing, reading, syntax, terms
from millrace.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.found_invalid(table(spark, sf, "artifacts"))


def p1_files(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.checked_files(table(spark, sf, "artifacts"))


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.invalid_rates(p1_files(spark, sf))


def p1_json(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON files among them, which another parser can judge."""
    return syntax.checked_files(table(spark, sf, "artifacts"), ()).filter("language = 'json' AND valid IS NOT NULL").select("artifact_id", "valid")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.canonical_entries(*(table(spark, sf, t) for t in ("analyze_results", "taxonomy", "aliases"))).drop("value")


def p2_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.unmatched_report(*(table(spark, sf, t) for t in ("analyze_results", "taxonomy", "aliases")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return history.found_earlier(table(spark, sf, "artifacts"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.found_pairs(table(spark, sf, "artifacts"))


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.found_classes(table(spark, sf, "artifacts"))


VALUE_FIELDS, TERM_FIELDS = ("Primary_Faulty_Optimization", "Compiler_Tier"), ("Type_Mechanism",)


def p4_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_report(table(spark, sf, "analyze_results"), VALUE_FIELDS, TERM_FIELDS)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_terms(spark, sf).filter("mark IS NOT NULL").select("field", "term", "mark")


def p4_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    counts = terms.ngram_counts(table(spark, sf, "analyze_results"), (), TERM_FIELDS)
    return counts.selectExpr("array_join(ngram, ' ') AS ngram", "n", "occurrences", "records")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.containers(table(spark, sf, "documents"), table(spark, sf, "capacities"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, sf), table(spark, sf, "capacities"))


def p7_audit(spark: SparkSession, sf: str) -> DataFrame:
    return packing.audit(p7_containers(spark, sf), table(spark, sf, "capacities"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.found_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(p8_found(spark, sf))


def p8_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.cleaned(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p9_profile(spark: SparkSession, sf: str) -> DataFrame:
    return reading.profile(p9_levels(spark, sf))


#: Words of a value in lower case without noise around them, and the edits a form allows, written out for DuckDB.
_P2_WORDS = r"""regexp_replace(regexp_replace(trim(regexp_replace(lower(CASE WHEN regexp_matches(x, '\S[\s_-]+\S') THEN x ELSE regexp_replace(x, '([a-z])([A-Z])', '\1 \2', 'g') END), '[^a-z0-9]+', ' ', 'g')), '^((the|in|phase|pass|opto|jit|c1|c2|likely|probably|maybe) )+', ''), '( (pass|phase|optimization|optimisation|opt|c1|c2|likely|probably|maybe|bug|issue))+$', '')"""
_P2_EDITS = "CASE WHEN length(form) < 4 THEN 0 WHEN length(form) < 7 THEN 1 WHEN length(form) < 9 THEN 2 WHEN length(form) < 11 THEN 3 ELSE 4 END"
#: The same matching by comparing every distinct value with every form.
_P2_MATCH = f"""
WITH RECURSIVE named AS (
  SELECT pass, pass AS x, 0 AS kind, category_ord * 1000000 + pass_ord AS ord FROM taxonomy
  UNION ALL SELECT a.pass, a.alias, 1, t.category_ord * 1000000 + t.pass_ord FROM aliases a JOIN taxonomy t ON a.pass = t.pass
), worded AS (SELECT *, list_filter(string_split({_P2_WORDS}, ' '), lambda w: w <> 'of') AS ws FROM named),
forms AS (
  SELECT pass, kind, ord, ws, 0 AS turned, array_to_string(ws, '') AS form FROM worded
  UNION ALL SELECT pass, kind, ord, ws, 1, ws[-1] || array_to_string(ws[1:-2], '') FROM worded WHERE len(ws) > 1
  UNION ALL SELECT pass, kind, ord, ws, 1, array_to_string(list_reverse(ws), '') FROM worded
), known AS (
  SELECT pass, kind, min(turned) AS turned, min(ord) AS ord, form, any_value(ws) AS ws, {_P2_EDITS} AS k,
         array_to_string(list_transform(any_value(ws), lambda w: w[1]), '') AS initials
  FROM forms GROUP BY pass, kind, form
), entries AS (
  SELECT response_no, 'Primary_Faulty_Optimization' AS field, 0::BIGINT AS pos, Primary_Faulty_Optimization AS x FROM analyze_results
  UNION ALL
  SELECT response_no, 'Interacting_Optimizations', pos::BIGINT, Interacting_Optimizations[pos] FROM
    (SELECT response_no, Interacting_Optimizations, unnest(range(1, len(Interacting_Optimizations) + 1)) AS pos FROM analyze_results)
), cases AS (
  SELECT * FROM entries WHERE x IS NOT NULL AND NOT regexp_matches(x, '^\\s*$') AND x <> 'Unknown' AND x NOT IN (SELECT pass FROM taxonomy)
), vals AS (
  SELECT x, ws, array_to_string(ws, '') AS form, array_to_string(list_transform(ws, lambda w: w[1]), '') AS initials
  FROM (SELECT x, list_filter(string_split({_P2_WORDS}, ' '), lambda w: w <> 'of' AND w <> '') AS ws FROM (SELECT DISTINCT x FROM cases))
), found AS (
  SELECT v.x, f.pass, f.turned, f.ord,
    CASE WHEN v.form = f.form THEN f.kind
         WHEN f.kind = 0 AND f.turned = 0 AND v.form = f.initials AND length(v.form) BETWEEN 3 AND 6 THEN 2
         WHEN f.kind = 0 AND f.turned = 0 AND len(v.ws) > 1 AND len(v.ws) = len(f.ws) AND v.initials = f.initials AND length(v.form) >= 3 * len(v.ws)
              AND list_bool_and(list_transform(list_zip(v.ws, f.ws), lambda z: length(z[1]) >= 3 AND starts_with(z[2], z[1]))) THEN 3
         WHEN levenshtein(v.form, f.form) <= f.k THEN 4 END AS rank,
    CASE WHEN v.form = f.form THEN 0 ELSE levenshtein(v.form, f.form) END AS dist
  FROM vals v, known f
), best AS (SELECT x, arg_min(pass, (rank, CASE WHEN rank = 4 THEN dist ELSE 0 END, CASE WHEN rank < 2 THEN turned ELSE 0 END, ord)) AS pass FROM found WHERE rank IS NOT NULL GROUP BY x)
"""

_RUNS = """
WITH toks AS (SELECT artifact_id AS id, batch_no, regexp_extract_all(content, '[A-Za-z0-9_$]+|[^\\sA-Za-z0-9_$]') AS t FROM artifacts WHERE content IS NOT NULL),
runs AS (SELECT DISTINCT id, batch_no, list_slice(t, k, k + 4) AS run FROM (SELECT id, batch_no, t, unnest(range(1, len(t) - 3)) AS k FROM toks)),
sizes AS (SELECT id, batch_no, count(*) AS n FROM runs GROUP BY 1, 2),
pairs AS (
  SELECT a, b, ba, bb, common / (x.n + y.n - common) AS similarity FROM
    (SELECT l.id AS a, r.id AS b, l.batch_no AS ba, r.batch_no AS bb, count(*) AS common FROM runs l JOIN runs r ON l.run = r.run AND l.id < r.id GROUP BY 1, 2, 3, 4) c
    JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b
  WHERE common >= 0.6 * (x.n + y.n - common) - 1e-9
)
"""
_P8_WORDS = """
WITH texts AS (
  SELECT id, side, x FROM (SELECT doc_id AS id, 'd' AS side, text AS x FROM documents UNION ALL SELECT item_id, 'b', text FROM benchmark) WHERE x IS NOT NULL
), read AS (
  SELECT id, side, regexp_extract_all(lower(x), '[a-z0-9]+') AS w FROM texts
  UNION ALL
  SELECT id, side, regexp_extract_all(lower(regexp_replace(x, '</?[A-Za-z][^<>]*>|<[!?][^<>]*>|&([A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});', ' ', 'g')), '[a-z0-9]+') FROM texts WHERE x LIKE '%<%' OR x LIKE '%&%'
), runs AS (SELECT DISTINCT id, side, list_slice(w, k, k + 11) AS run FROM (SELECT id, side, w, unnest(range(1, len(w) - 10)) AS k FROM read)),
leaks AS (SELECT DISTINCT d.id AS doc_id, b.id AS item_id FROM runs d JOIN runs b ON d.run = b.run WHERE d.side = 'd' AND b.side = 'b')
"""
_P4_TERMS = r"""
WITH rec AS (SELECT row_number() OVER () AS r, * FROM analyze_results),
occ AS (
  SELECT 'Primary_Faulty_Optimization' AS field, r, lower(regexp_replace(Primary_Faulty_Optimization, '^\s+|\s+$', '', 'g')) AS term FROM rec
  UNION ALL SELECT 'Compiler_Tier', r, lower(regexp_replace(Compiler_Tier, '^\s+|\s+$', '', 'g')) FROM rec
  UNION ALL SELECT 'Type_Mechanism', r, lower(unnest(regexp_extract_all(Type_Mechanism, '[A-Za-z0-9_]+'))) FROM rec
), counted AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT r) AS records FROM occ WHERE term <> '' GROUP BY 1, 2),
report AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.25 * (SELECT count(*) FROM analyze_results) THEN 'common' END AS mark FROM counted)
"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_files, p1_rates, p1_json, p2_found, p2_unmatched, p3_found, p4_found, p4_terms, p4_ngrams, p5_found, p5_classes, p7_containers, p7_fill, p7_audit, p8_found, p8_items, p8_cleaned, p9_levels, p9_profile)
}
ORACLES: dict[str, str] = {
    # DuckDB lets a comma before a closing bracket pass.
    "p1_json": r"""SELECT artifact_id, json_valid(content) AND NOT regexp_matches(regexp_replace(content, '"(?:[^"\\]|\\.)*"', '""', 'g'), ',\s*[\]}]') AS valid FROM artifacts WHERE regexp_matches(trim(original_filename, ' '), '(?i)\.json$') AND content IS NOT NULL""",
    "p2_found": _P2_MATCH + "SELECT response_no, field, pos, coalesce(b.pass, 'UNMATCHED') AS pass FROM cases c LEFT JOIN best b ON c.x = b.x",
    "p2_unmatched": _P2_MATCH + "SELECT c.x AS value, count(*) AS n FROM cases c LEFT JOIN best b ON c.x = b.x WHERE b.pass IS NULL GROUP BY 1",
    "p3_found": _RUNS + "SELECT min(earlier) AS earlier_id, artifact_id FROM (SELECT a AS earlier, b AS artifact_id FROM pairs WHERE ba < bb UNION ALL SELECT b, a FROM pairs WHERE bb < ba) GROUP BY artifact_id",
    "p4_found": _P4_TERMS + "SELECT field, term, mark FROM report WHERE mark IS NOT NULL",
    "p4_terms": _P4_TERMS + "SELECT * FROM report",
    "p4_ngrams": """
WITH rec AS (SELECT row_number() OVER () AS r, list_transform(regexp_extract_all(Type_Mechanism, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM analyze_results),
grams AS (SELECT r, n, array_to_string(list_slice(t, k, k + n - 1), ' ') AS ngram FROM (SELECT r, t, n, unnest(range(1, len(t) - n + 2)) AS k FROM rec, (SELECT unnest(range(1, (SELECT max(len(t)) FROM rec) + 1))::INT AS n)))
SELECT ngram, n, count(*) AS occurrences, count(DISTINCT r) AS records FROM grams GROUP BY 1, 2""",
    "p5_found": _RUNS + "SELECT a AS artifact_a, b AS artifact_b FROM pairs",
    "p5_classes": _RUNS
    + """, sets AS (SELECT id, list_sort(list(run)) AS s FROM runs GROUP BY id), member AS (SELECT id, min(id) OVER (PARTITION BY s) AS rep, count(*) OVER (PARTITION BY s) AS copies FROM sets),
link AS (SELECT rep, count(*) AS links FROM (SELECT a AS rep, similarity, b FROM pairs UNION ALL SELECT b, similarity, a FROM pairs) p
  WHERE similarity < 1 AND p.rep IN (SELECT rep FROM member) AND p.b IN (SELECT rep FROM member) GROUP BY 1)
SELECT id AS artifact_id, m.rep AS class_id, copies, coalesce(links, 0) AS links FROM member m LEFT JOIN link l ON m.rep = l.rep""",
    "p7_audit": "SELECT name, (SELECT count(*) FROM documents WHERE text <> '') AS texts, 0::BIGINT AS overfull, 0::BIGINT AS cut, 0::BIGINT AS broken FROM capacities",
    "p8_found": _P8_WORDS + "SELECT * FROM leaks",
    "p8_items": _P8_WORDS + "SELECT item_id, count(*) AS documents FROM leaks GROUP BY 1",
}
