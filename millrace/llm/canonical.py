"""Free-entered values to a canonical list (problem 2), in SQL only.

Every form of a reference entry (its words in order, last word first, reversed; its other names)
is cut into k+1 segments, k growing with its length to ``MAX_EDITS``. By the pigeonhole
principle a value within k edits holds one segment unchanged, shifted by at most the number of
edits before it, so an equality join on (length, segment number, substring) finds every pair
within k edits; the built-in levenshtein verifies it. Exact forms, initials (``CLR``) and
abbreviated words (``Decomp.``) are further equality joins. Only distinct values are matched;
values without a match are reported through an anti join as ``UNMATCHED``.

Defined results: null and blank entries, exact entries of the list and ``Unknown`` are no cases;
of several matches the better kind (exact, other name, initials, abbreviation, edits) wins, then
fewer edits, then the order of the list; repeated rows come out as often as they are there;
an empty list leaves every value unmatched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.session import written

#: Parameters of the matching. A form of 11 characters or more allows so many edits, shorter ones fewer (``edits_sql``); a
#: value beyond them is unmatched and reported, none is dropped.
MAX_EDITS = 4
#: Lengths a value may have to be read as initials, and the least length of each word of an abbreviation: shorter ones
#: would fit many entries.
INITIALS, ABBREVIATED = (3, 6), 3
#: Words around a name that carry no meaning of their own in this domain, as alternatives of a pattern; for another domain
#: give others (or none).
NOISE_BEFORE = "the|in|phase|pass|opto|jit|c1|c2|likely|probably|maybe"
NOISE_AFTER = "pass|phase|optimization|optimisation|opt|c1|c2|likely|probably|maybe|bug|issue"


def words_sql(x: str) -> str:
    """Words of a value in lower case, joined by single blanks, without noise words around them."""
    split = f"CASE WHEN regexp_like({x}, '\\\\S[\\\\s_-]+\\\\S') THEN {x} ELSE regexp_replace({x}, '([a-z])([A-Z])', '$1 $2') END"
    plain = f"trim(regexp_replace(lower({split}), '[^a-z0-9]+', ' '))"
    before = f"regexp_replace({plain}, '^(({NOISE_BEFORE}) )+', '')"
    return f"regexp_replace({before}, '( ({NOISE_AFTER}))+$', '')"


def edits_sql(length: str) -> str:
    """Allowed edits of a reference form by its length."""
    return f"CASE WHEN {length} < 4 THEN 0 WHEN {length} < 7 THEN 1 WHEN {length} < 9 THEN 2 WHEN {length} < 11 THEN 3 ELSE {MAX_EDITS} END"


FORMS = f"""
WITH named AS (
  SELECT pass, pass AS name, 0 AS kind, category_ord * 1000000L + pass_ord AS ord FROM {{taxonomy}} WHERE pass IS NOT NULL
  UNION ALL
  SELECT a.pass, a.alias, 1, t.category_ord * 1000000L + t.pass_ord FROM {{aliases}} a JOIN {{taxonomy}} t ON a.pass = t.pass WHERE a.alias IS NOT NULL
), worded AS (
  SELECT *, filter(split({words_sql("name")}, ' '), w -> w <> 'of') AS ws FROM named
), orders AS (
  SELECT pass, kind, ord, ws, o.turned, o.form FROM worded LATERAL VIEW inline(array(
    struct(0 AS turned, array_join(ws, '') AS form),
    struct(1 AS turned, array_join(concat(slice(ws, -1, 1), slice(ws, 1, greatest(size(ws) - 1, 0))), '') AS form),
    struct(1 AS turned, array_join(reverse(ws), '') AS form))) o AS turned, form
)
SELECT pass, kind, min(turned) AS turned, min(ord) AS ord, form, length(form) AS len, first(ws) AS ws,
       array_join(transform(first(ws), w -> left(w, 1)), '') AS initials, {edits_sql("length(form)")} AS k
FROM orders WHERE form <> '' GROUP BY pass, kind, form
"""

VALUES = f"""
SELECT value, ws, array_join(ws, '') AS form, length(array_join(ws, '')) AS len,
       array_join(transform(ws, w -> left(w, 1)), '') AS initials
FROM (SELECT value, filter(split({words_sql("value")}, ' '), w -> w <> 'of' AND w <> '') AS ws FROM (SELECT DISTINCT value FROM {{entries}}))
"""

#: Segment i (from 0) of a form of length len begins at i * (len div (k+1)) + max(0, i - (k+1 - len % (k+1))).
SEGMENTS = """
SELECT f.form, f.pass, f.kind, f.ord, f.k, f.len, i.i, substring(f.form, i.at + 1, i.n) AS seg
FROM {forms} f LATERAL VIEW inline(transform(sequence(0, f.k), i -> struct(
    i AS i,
    CAST(i * (f.len div (f.k + 1)) + greatest(0, i - (f.k + 1 - f.len % (f.k + 1))) AS INT) AS at,
    CAST(f.len div (f.k + 1) + CASE WHEN i >= f.k + 1 - f.len % (f.k + 1) THEN 1 ELSE 0 END AS INT) AS n))) i AS i, at, n
"""

#: For each length a form may have, the substrings of the value that can hold segment i: its shift is at most
#: i edits before it, and, counted from the end, at most k - i after it.
PROBES = """
WITH lens AS (SELECT DISTINCT len, k FROM {forms}),
at AS (
  SELECT v.value, v.form, l.len, l.k, i.i,
    CAST(i.i * (l.len div (l.k + 1)) + greatest(0, i.i - (l.k + 1 - l.len % (l.k + 1))) AS INT) AS at,
    CAST(l.len div (l.k + 1) + CASE WHEN i.i >= l.k + 1 - l.len % (l.k + 1) THEN 1 ELSE 0 END AS INT) AS n,
    v.len - l.len AS delta
  FROM {vals} v JOIN (SELECT len, k, len + d AS vlen FROM lens LATERAL VIEW explode(sequence(-k, k)) d AS d) l ON v.len = l.vlen
  LATERAL VIEW explode(sequence(0, l.k)) i AS i
)
SELECT DISTINCT value, form, len, i, substring(form, at + s.s + 1, n) AS seg
FROM at LATERAL VIEW explode(sequence(-least(k, greatest(i, k - i + abs(delta))), least(k, greatest(i, k - i + abs(delta))))) s AS s
WHERE abs(s.s) <= i AND abs(s.s - delta) <= k - i AND at + s.s >= 0
"""

MATCHES = f"""
SELECT value, min_by(pass, struct(rank, dist, turned, ord)) AS pass FROM (
  SELECT v.value, f.pass, f.kind AS rank, 0 AS dist, f.turned, f.ord FROM {{vals}} v JOIN {{forms}} f ON v.form = f.form
  UNION ALL
  SELECT v.value, f.pass, 2, 0, 0, f.ord FROM {{vals}} v JOIN {{forms}} f ON v.form = f.initials
   WHERE f.kind = 0 AND f.turned = 0 AND v.len BETWEEN {INITIALS[0]} AND {INITIALS[1]}
  UNION ALL
  SELECT v.value, f.pass, 3, 0, 0, f.ord FROM {{vals}} v JOIN {{forms}} f ON v.initials = f.initials AND size(v.ws) = size(f.ws)
   WHERE f.kind = 0 AND f.turned = 0 AND size(v.ws) > 1 AND v.len >= size(v.ws) * {ABBREVIATED}
     AND forall(zip_with(v.ws, f.ws, (a, b) -> length(a) >= {ABBREVIATED} AND left(b, length(a)) = a), x -> x)
  UNION ALL
  SELECT value, pass, 4, dist, 0, ord FROM (
    SELECT DISTINCT p.value, p.form AS vform, s.form, s.pass, s.k, s.ord, levenshtein(p.form, s.form, s.k) AS dist
    FROM {{probes}} p JOIN {{segments}} s ON p.len = s.len AND p.i = s.i AND p.seg = s.seg
  ) WHERE dist >= 0
) GROUP BY value
"""


def match_values(entries: DataFrame, taxonomy: DataFrame, aliases: DataFrame) -> DataFrame:
    """value, pass for the distinct values of ``entries`` that mean an entry of the list."""
    spark = entries.sparkSession
    forms = written(spark.sql(FORMS, taxonomy=taxonomy, aliases=aliases), "forms")
    vals = written(spark.sql(VALUES, entries=entries), "values")
    segments = spark.sql(SEGMENTS, forms=forms)
    probes = spark.sql(PROBES, forms=forms, vals=vals)
    return spark.sql(MATCHES, vals=vals, forms=forms, probes=probes, segments=segments)


ENTRIES = """
SELECT response_no, field, pos, value FROM (
  SELECT response_no, inline(concat(
    array(struct('Primary_Faulty_Optimization' AS field, 0L AS pos, Primary_Faulty_Optimization AS value)),
    coalesce(transform(Interacting_Optimizations, (x, i) -> struct('Interacting_Optimizations' AS field, i + 1L AS pos, x AS value)), array())))
  FROM {results}
) WHERE value IS NOT NULL AND NOT regexp_like(value, '^(?U)\\\\s*$') AND value <> 'Unknown'
"""


def canonical_entries(results: DataFrame, taxonomy: DataFrame, aliases: DataFrame) -> DataFrame:
    """response_no, field, pos, value, pass of every free entry; pass is UNMATCHED where it means none."""
    spark = results.sparkSession
    raw = spark.sql(ENTRIES, results=results)
    entries = spark.sql("SELECT e.* FROM {e} e LEFT ANTI JOIN {t} t ON e.value = t.pass", e=raw, t=taxonomy)
    matched = written(match_values(entries, taxonomy, aliases), "matched")
    return spark.sql(
        """
        SELECT e.response_no, e.field, e.pos, e.value, m.pass FROM {e} e JOIN {m} m ON e.value = m.value
        UNION ALL
        SELECT e.response_no, e.field, e.pos, e.value, 'UNMATCHED' FROM {e} e LEFT ANTI JOIN {m} m ON e.value = m.value
        """,
        e=entries,
        m=matched,
    )


def unmatched_report(results: DataFrame, taxonomy: DataFrame, aliases: DataFrame) -> DataFrame:
    """Values that mean no entry, with their number of occurrences."""
    spark = results.sparkSession
    return spark.sql("SELECT value, count(*) AS n FROM {c} WHERE pass = 'UNMATCHED' GROUP BY value", c=canonical_entries(results, taxonomy, aliases))
