"""Queries over source code and evidence. Their SQL cuts a text into the same lexical pieces and folds over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import code, evidence, extract, features
from millrace.operators import rank, stats
from millrace.plans.reference import query

c = F.col


def _filled(text: str, **parts: str) -> str:
    """The SQL text with ``$name`` replaced, longest names first."""
    for k in sorted(parts, key=len, reverse=True):
        text = text.replace(f"${k}", parts[k])
    return text


_BLOCKS = r'(?s)"""(?:[^\\]|\\.)*?(?:"""|\z)|//[^\n\r]*|/\*.*?(?:\*/|\z)|'
_PARTS = {
    "LINE_PIECES": _BLOCKS + r'"(?:[^"\\\n]|\\.)*"?|\x27(?:[^\x27\\\n]|\\.)*\x27?|[{}]|[^"\x27/{}]+|.',
    "OPEN_PIECES": _BLOCKS + r'"(?:[^"\\]|\\.)*"?|\x27(?:[^\x27\\]|\\.)*\x27?|[{}]|[^"\x27/{}]+|.',
    "DECLARED": r"(?s)\b(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record)\s+[A-Za-z_$][A-Za-z0-9_$]*[^{;]*\{",
    "NAMED": r"(?s)\b(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record)\s+([A-Za-z_$][A-Za-z0-9_$]*)[^{;]*\{",
    "SPACE": r"^\s+|\s+$",
}
#: texts(id, x) -> extents(id, k, begin, done): each declaration, its begin (from 0) and the end of its closing brace.
_PARTS["EXTENTS"] = _filled(
    """heads AS (SELECT id, x, regexp_extract_all(x, '$DECLARED') AS hs, regexp_split_to_array(x, '$DECLARED') AS gs FROM texts),
spots AS (SELECT id, x, k, (list_sum(list_transform(gs[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hs[1:k - 1], lambda h: length(h))), 0))::BIGINT AS begin, length(hs[k]) AS head FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS k FROM heads)),
extents AS (SELECT id, x, k, begin, list_reduce(regexp_extract_all(x[(begin + head)::BIGINT:], '$OPEN_PIECES'), lambda s, p: {'deep': s.deep + CASE p WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END, 'used': s.used + length(p), 'done': coalesce(s.done, CASE WHEN p = '}' AND s.deep = 1 THEN s.used + length(p) END)}, {'deep': 0::BIGINT, 'used': (begin + head - 1)::BIGINT, 'done': NULL::BIGINT}).done AS done FROM spots)""",
    **_PARTS,
)
_LINE = "trim(translate(l, chr(9) || chr(13) || chr(12), '   '), ' ')"
#: How many characters at the end of the text b are lines that may stand before a declaration.
_PARTS["LEADING"] = f"list_reduce(string_split(b, chr(10))[1:-2], lambda n, l: CASE WHEN {_LINE} = '' OR " + " OR ".join(f"starts_with({_LINE}, '{w}')" for w in ("package ", "import ", "//", "/*", "*", "*/", "@")) + " THEN n + length(l) + 1 ELSE 0 END, 0::BIGINT)"


def _sql(text: str) -> str:
    return _filled(text, **_PARTS)


@query(
    _sql("""WITH m AS (SELECT artifact_id, coalesce(original_filename, '') AS f,
 array_to_string(list_transform(regexp_extract_all(content, '$LINE_PIECES'), lambda p: CASE WHEN p[1:2] IN ('//', '/*') OR p[1] IN ('"', chr(39)) THEN regexp_replace(p, '[^\\n\\r]', ' ', 'g') ELSE p END), '') AS m FROM artifacts WHERE content IS NOT NULL),
i AS (SELECT *, nullif(regexp_extract(m, '(?m)^\\s*package\\s+([A-Za-z0-9_.$]+)\\s*;', 1), '') AS package, regexp_extract_all(m, '$NAMED', 1) AS names FROM m),
j AS (SELECT *, coalesce(list_filter(names, lambda n: n || '.java' = f)[1], names[1]) AS first FROM i)
SELECT artifact_id, package, first AS "primary", regexp_matches(m, 'public\\s+static\\s+void\\s+main\\s*\\(\\s*String\\s*(?:\\[\\s*\\]|\\.\\.\\.)') AS has_main, concat_ws('.', package, first) AS main_class FROM j""")
)
def source_info(t):
    """Package, types and main method on code without comments and literals."""
    m = t("artifacts").filter("content IS NOT NULL").select("artifact_id", F.coalesce("original_filename", F.lit("")).alias("f"), code.masked(c("content")).alias("m"))
    x = m.select("artifact_id", extract.source_info(c("m"), c("f")).alias("i"))
    return x.select("artifact_id", "i.package", "i.primary", "i.has_main", extract.qualified_main(c("i")).alias("main_class"))


@query(
    _sql("""WITH texts AS (SELECT artifact_id AS id, content AS x FROM artifacts WHERE content IS NOT NULL), $EXTENTS, closed AS (SELECT DISTINCT id FROM extents WHERE done IS NOT NULL),
a AS (SELECT artifact_id, coalesce(regexp_replace(content, '$SPACE', '', 'g'), '') AS s, lower(left(regexp_replace(content, '^\\s+', ''), 500)) AS h, id IS NOT NULL AS closes FROM artifacts LEFT JOIN closed ON artifact_id = id)
SELECT artifact_id, CASE WHEN s = '' THEN 'empty' WHEN starts_with(h, '<!doctype') OR starts_with(h, '<html') OR contains(h, '<head>') THEN 'html' WHEN length(s) >= 20 AND closes THEN 'valid' ELSE 'incomplete' END AS verdict FROM a""")
)
def source_verdicts(t):
    return t("artifacts").select("artifact_id", code.source_verdict(c("content")).alias("verdict"))


@query(
    _sql("""WITH RECURSIVE texts AS (SELECT doc_id AS id, text AS x FROM documents WHERE text IS NOT NULL), $EXTENTS, own AS (SELECT id, k, begin, done, x, begin - length(string_split(x[1:begin], chr(10))[-1]) AS start FROM extents WHERE done IS NOT NULL),
pieces AS (SELECT id, k, begin, done, x[start - $LEADING + 1:done] AS source FROM (SELECT *, x[1:start] AS b FROM own)),
ready AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS k, begin, done, source, length(regexp_replace(source, '$SPACE', '', 'g')) >= 20 AS enough FROM pieces),
taken AS (SELECT id, 0::BIGINT AS k, 0::BIGINT AS until, ''::VARCHAR AS source, false AS yes FROM texts UNION ALL
 SELECT r.id, r.k, CASE WHEN r.begin >= p.until AND enough THEN r.done ELSE p.until END, r.source, r.begin >= p.until AND enough FROM taken p JOIN ready r ON r.id = p.id AND r.k = p.k + 1),
inline_ AS (SELECT id, list(source ORDER BY k) AS l FROM taken WHERE yes GROUP BY id),
blocks AS (SELECT texts.id, regexp_extract_all(x, '$SOURCE_BLOCK', 1) || regexp_extract_all(x, '$FENCED_BLOCK', 1) AS b, l FROM texts LEFT JOIN inline_ ON texts.id = inline_.id),
one AS (SELECT id AS doc_id, unnest(range(0, len(b || coalesce(l, []))))::INT AS pos, unnest(b || coalesce(l, [])) AS source, len(b) AS n FROM blocks),
cut AS (SELECT *, list_transform(range(1, len(regexp_extract_all(source, '$DECLARED')) + 1), lambda k: source[(list_sum(list_transform(regexp_split_to_array(source, '$DECLARED')[1:k], lambda g: length(g))) + list_sum(list_transform(regexp_extract_all(source, '$DECLARED')[1:k], lambda h: length(h))))::BIGINT:]) AS bodies FROM one WHERE pos < n)
SELECT doc_id, pos, sha256(source) AS digest FROM one WHERE pos >= n
UNION ALL
SELECT doc_id, pos, sha256(source) FROM cut WHERE length(regexp_replace(source, '$SPACE', '', 'g')) >= 20 AND NOT regexp_matches(lower(left(regexp_replace(source, '^\\s+', ''), 500)), '^<!doctype|^<html|<head>')
 AND len(list_filter(bodies, lambda y: list_reduce(regexp_extract_all(y, '$OPEN_PIECES'), lambda s, p: {'deep': s.deep + CASE p WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END, 'done': s.done OR (p = '}' AND s.deep = 1)}, {'deep': 0::BIGINT, 'done': false}).done)) > 0""".replace("$SOURCE_BLOCK", extract.SOURCE_BLOCK).replace("$FENCED_BLOCK", extract.FENCED_BLOCK))
)
def inline_sources(t):
    """Declarations within running text, after source blocks and fenced blocks."""
    x = t("documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.concat(extract.source_blocks(c("text")), extract.fenced_blocks(c("text")), code.inline_code(c("text")))).alias("pos", "source"))
    return x.filter(code.source_verdict(c("source")) == "valid").select("doc_id", "pos", F.sha2("source", 256).alias("digest"))


#: Detectors whose patterns RE2 can say as well, with these patterns.
_DETECTED = (
    ("ifStmt", r"\bif\s*\("), ("switchStmt", r"\bswitch\s*\("), ("tryCatchStmt", r"\btry\s*[({]"), ("logicalOperator", r"&&|\|\|"), ("instanceofOperator", r"\binstanceof\b"), ("booleanType", r"\bboolean\b"), ("integerType", r"\bint\b"),
    ("longType", r"\blong\b"), ("primitiveType", r"\b(?:byte|short|char|int|long|float|double|boolean)\b"), ("nullType", r"\bnull\b"), ("wrapperType", r"\b(?:Byte|Short|Character|Integer|Long|Float|Double|Boolean)\b"), ("genericType", r"\b(?:class|interface|record)\s+\w+\s*<"),
    ("boundedTypeParameter", r"<\s*[A-Z]\w*\s+extends\b"), ("wildcardType", r"<\s*\?"), ("interfaceType", r"\binterface\s+\w"), ("enumType", r"\benum\s+\w"), ("lambda", r"->"), ("synchronizedAccess", r"\bsynchronized\b"), ("classLiteral", r"\.\s*class\b"), ("reflectiveMethodInvocation", r"\.\s*invoke\s*\("),
)
_DETECTORS = _sql("""WITH f AS (SELECT * FROM (VALUES $ROWS) v(ord, feature, p)), m AS (SELECT artifact_id, array_to_string(list_transform(regexp_extract_all(content, '$LINE_PIECES'), lambda p: CASE WHEN p[1:2] IN ('//', '/*') OR p[1] IN ('"', chr(39)) THEN regexp_replace(p, '[^\\n\\r]', ' ', 'g') ELSE p END), '') AS m
 FROM artifacts WHERE content IS NOT NULL AND lower(coalesce(original_filename, 'x.java')) LIKE '%.java')
""").replace("$ROWS", ", ".join(f"({k}, '{n}', '{p}')" for k, (n, p) in enumerate(_DETECTED)))


def _found(t) -> tuple[DataFrame, DataFrame]:
    """Java files, and the occurrences in them of the detectors above."""
    a = t("artifacts").filter("content IS NOT NULL AND lower(coalesce(original_filename, 'x.java')) LIKE '%.java'").select(c("artifact_id").alias("case_id"), "content")
    return a, features.feature_rows(a, "case_id", "content").filter(c("feature").isin(*[n for n, _ in _DETECTED]))


@query(_DETECTORS + "SELECT ord, feature, count(artifact_id) AS cases, printf('%.2f%%', 100.0 * count(artifact_id) / (SELECT count(*) FROM m)) AS share FROM f LEFT JOIN m ON regexp_matches(m, p) GROUP BY 1, 2")
def feature_prevalence(t):
    """Files that hold a feature, of those detectors that SQL can repeat."""
    a, found = _found(t)
    dim = a.sparkSession.createDataFrame([(k, n, True) for k, (n, _) in enumerate(_DETECTED)], "ord int, feature string, reported boolean")
    return stats.prevalence(dim, a, found)


@query(_DETECTORS + "SELECT feature, sum(len(regexp_extract_all(m, p)))::BIGINT AS occurrences, count(*) FILTER (regexp_matches(m, p)) AS files FROM f, m WHERE regexp_matches(m, p) GROUP BY 1")
def feature_occurrences(t):
    _, found = _found(t)
    return found.groupBy("feature").agg(F.count("*").alias("occurrences"), F.count_distinct("case_id").alias("files"))


def _cut(n: str, budget: str, mark: int) -> str:
    """Length of a text of n characters cut to a budget with a mark of so many."""
    return f"CASE WHEN {n} <= {budget} THEN {n} ELSE greatest({budget} * 68 // 100, 1) + 2 + {mark} + greatest({budget} - greatest({budget} * 68 // 100, 1) - {mark} - 4, 1) END"


def _kept(lines: str) -> str:
    """Length of the text of kept lines (numbers, in order) with a mark of 40 characters and a line end in every gap."""
    return f"(list_sum(list_transform({lines}, lambda i: lens[i])) + 41 * (len(list_filter({lines}, lambda i: NOT list_contains({lines}, i - 1))) - 1) - 1)"


_BASE = "list_sort(list_distinct(range(1, least(16, lines) + 1) || range(greatest(1, lines - 7), lines + 1)))"
_MORE = "list_sort(list_distinct(kept || range(greatest(1, spot.k - spot.a), least(lines, spot.k + spot.a) + 1)))"


@query(rf"""WITH RECURSIVE f AS (SELECT issue_id, artifact_id, coalesce(original_filename, '') AS name, length(content) AS n, regexp_split_to_array(regexp_replace(content, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') AS ls FROM artifacts WHERE content IS NOT NULL AND issue_id IS NOT NULL),
w AS (SELECT issue_id, name, n, list_transform(ls, lambda l: length(l) + 1) AS lens, len(ls) AS lines, list_sort(list_filter(list_transform(ls, lambda l, k: CASE
  WHEN regexp_matches(l, '(?i)\binstanceof\b|\b(?:MethodHandle|MethodType|invokeExact|invokeWithArguments)\b|\(\s*(?:byte|short|char|int|long|float|double|boolean)\s*\)|\b(?:Byte|Short|Character|Integer|Long|Float|Double|Boolean)\s*\.\s*valueOf\s*\(|\.(?:byteValue|shortValue|charValue|intValue|longValue|floatValue|doubleValue|booleanValue)\s*\(') THEN {{'o': -4, 'k': k, 'a': 2}}
  WHEN regexp_matches(l, '(?i)\bmain\s*\(|@Test\b|\btest\w*\s*\(') THEN {{'o': -5, 'k': k, 'a': 4}}
  WHEN regexp_matches(l, '(?i)(^\s*(?:package|import)\s+|\b(?:class|interface|enum|record)\s+\w+|\bstatic\s+void\s+main\s*\(|@Test\b|\b(?:test|run|main)\w*\s*\(|\bassert\b|\bthrow\s+new\b|CompileCommand|TestFramework|WhiteBox)') THEN {{'o': -2, 'k': k, 'a': 1}} END), lambda x: x IS NOT NULL)) AS spots,
 row_number() OVER (PARTITION BY issue_id ORDER BY -(CASE WHEN contains(lower(name), 'test') OR contains(lower(name), 'repro') OR contains(lower(name), 'main') THEN 10 ELSE 0 END + CASE WHEN lower(name) IN ('test.java', 'main.java') THEN 10 ELSE 0 END), name, artifact_id) AS r FROM f),
g AS (SELECT issue_id, count(*) AS files, sum(n)::BIGINT AS original, sum(n + length(name) + 17)::BIGINT AS packed FROM w GROUP BY 1),
steps AS (SELECT issue_id, files, 0::BIGINT AS k, 5200::BIGINT AS room, 0::BIGINT AS blocks, 0::BIGINT AS packed FROM g WHERE original > 6000 UNION ALL
 SELECT issue_id, files, k + 1, CASE WHEN room <= 300 THEN room ELSE room - block END, CASE WHEN room <= 300 THEN blocks ELSE blocks + 1 END, CASE WHEN room <= 300 THEN packed ELSE packed + block END FROM (
  SELECT *, {_cut("(33 + length(name) + length(n::VARCHAR) + length(small::VARCHAR) + small)", "room", 27)} AS block FROM (
   SELECT *, (CASE WHEN n <= share THEN n WHEN {_kept(_BASE)} > share THEN {_cut(_kept(_BASE), "share", 47)}
     ELSE list_transform([list_reduce(spots, lambda kept, spot: CASE WHEN {_kept(_MORE)} <= share THEN {_MORE} ELSE kept END, {_BASE})], lambda done: {_kept("done")})[1] END)::BIGINT AS small FROM (
    SELECT s.*, w.name, w.n, w.lens, w.lines, w.spots, least(8000, room, greatest(1600, room // greatest(files - k, 1))) AS share FROM steps s JOIN w ON w.issue_id = s.issue_id AND w.r = s.k + 1))))
SELECT issue_id, files, original, files AS blocks, packed FROM g WHERE original <= 6000 UNION ALL SELECT s.issue_id, s.files, g.original, s.blocks, s.packed FROM steps s JOIN g ON s.issue_id = g.issue_id WHERE k = s.files""".replace("\\\\", "\\"))
def packed_evidence(t):
    """The sources of each issue within 6000 characters: files, characters, blocks and characters supplied."""
    blocks = evidence.source_blocks(t("artifacts"), "issue_id", "original_filename", "content", "artifact_id", 6000)
    return blocks.groupBy("issue_id").agg(F.max("files").alias("files"), F.max("original").alias("original"), F.count("*").alias("blocks"), F.sum(F.length("block")).alias("packed"))


def _diffs(t) -> DataFrame:
    """Diffs made of the files: a section for each 60 lines, a hunk for each 20; lines with a semicolon are added ones, and
    those with a return removed ones."""
    lines = t("artifacts").filter("content IS NOT NULL").select("artifact_id", "issue_id", F.posexplode(F.split(F.regexp_replace("content", "\r", " "), "\n", -1)).alias("k", "l"))
    path = F.concat(F.lit("src/f"), c("artifact_id").cast("string"), F.lit("_"), F.floor(c("k") / 60).cast("string"), F.when(F.floor(c("k") / 60) % 2 == 1, ".cpp").otherwise(".txt"))
    mark = F.when(c("l").contains(";"), "+ ").when(c("l").contains("return"), "- ").otherwise("  ")
    head = F.when(c("k") % 60 == 0, F.concat(F.lit("diff --git a/old b/"), path, F.lit("\n--- a/old\n+++ b/"), path, F.lit("\n"))).otherwise("")
    hunk = F.when(c("k") % 20 == 0, F.concat(F.lit("@@ -"), c("k").cast("string"), F.lit(" +1 @@\n"))).otherwise("")
    line = lines.select("artifact_id", "issue_id", F.struct("k", F.concat(head, hunk, mark, "l").alias("l")).alias("x"))
    return line.groupBy("artifact_id", "issue_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n").alias("diff"))


_HUNKS = """WITH l AS (SELECT artifact_id, issue_id, unnest(string_split(content, chr(10))) AS l, unnest(range(0, len(string_split(content, chr(10))))) AS k FROM artifacts WHERE content IS NOT NULL),
x AS (SELECT artifact_id, issue_id, k, k // 60 + 1 AS section, k % 60 // 20 + 1 AS hunk, replace(l, chr(13), ' ') AS l, contains(l, ';') OR contains(l, 'return') AS change FROM l)
"""


@query(_HUNKS + """SELECT artifact_id, section, 'src/f' || artifact_id || '_' || (section - 1) || CASE WHEN section % 2 = 0 THEN '.cpp' ELSE '.txt' END AS path, hunk, count(*) FILTER (change) AS changed,
 (least(count(*) FILTER (change), 20) + CASE WHEN bool_or(change AND contains(lower(l), 'int')) THEN 10 ELSE 0 END + CASE WHEN min(k) = 40 THEN 15 ELSE 0 END)::BIGINT AS score FROM x GROUP BY 1, 2, hunk""")
def diff_hunks(t):
    """The hunks of made-up diffs, with the score for the terms ``int`` and ``-40 ``."""
    return rank.diff_hunks(_diffs(t), "artifact_id", "diff", ("int", "-40 ")).select("artifact_id", "section", "path", "hunk", "changed", c("score").cast("bigint").alias("score"))


@query(_HUNKS + """, near AS (SELECT *, max(change::INT) OVER (PARTITION BY artifact_id, section, hunk ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS near FROM x), kept AS (SELECT *, lag(k) OVER (PARTITION BY artifact_id, section, hunk ORDER BY k) AS before FROM near WHERE near),
h AS (SELECT artifact_id, section, hunk, count(*) AS lines, sum(length(l) + 3)::BIGINT AS chars, count(*) FILTER (before < k - 1) AS gaps FROM kept GROUP BY 1, 2, 3)
SELECT artifact_id, section, sum(lines)::BIGINT AS kept, sum(gaps)::BIGINT AS gaps FROM h GROUP BY 1, 2""")
def patch_sections(t):
    """Kept lines and gaps of each section of made-up diffs with a change."""
    s = evidence.patch_sections(_diffs(t), "artifact_id", "diff")
    lines = F.split("body", "\n", -1)
    gaps = F.size(F.filter(lines, lambda x: x == evidence.CONTEXT_GAP))
    kept = F.size(F.filter(lines, lambda x: F.left(x, F.lit(2)).isin("+ ", "- ", "  ")))
    return s.select("artifact_id", "section", kept.cast("bigint").alias("kept"), gaps.cast("bigint").alias("gaps")).filter("kept > 0")


@query()
def packed_patches(t):
    """Made-up diffs of each issue within 9000 characters; invariants and brute force in the tests."""
    blocks = evidence.patch_blocks(_diffs(t).withColumn("name", F.concat(F.lit("fix-"), c("artifact_id").cast("string"))), "issue_id", "name", "diff", "artifact_id", 9000, (".cpp",), ("return",))
    return blocks.groupBy("issue_id").agg(F.max("files").alias("files"), F.max("original").alias("original"), F.count("*").alias("blocks"), F.sum(F.length("block")).alias("packed"))
