"""Text normalisation as column expressions: all of it stays in the JVM and in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines and marks of captured program output.
NOISE_PREFIX = "[warning]"
NOISE_PARTS = (
    "Picked up JAVA_TOOL_OPTIONS",
    "java.lang.Class.throwException",
    "java.lang.J9VMInternals.ensureError",
    "ConvertHandle.throwWrongMethodTypeException",
    "InliningHandle.throwException",
    "JVMDUMP",
    "JVMPORT",
    "JFR: ",
)
CUT_SHORT = "[TRUNCATED]"
CUT_MARK = "\n<... TRUNCATED BY NORMALIZER ...>"
CLIP_MARK = "[... locally truncated ...]"
TIMEOUT_CODE = -124


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, ends trimmed; null to the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def label(c: Column) -> Column:
    """One of Yes, No, Unclear; everything else is Missing."""
    x = collapse(c)
    return F.when(x.isin("Yes", "No", "Unclear"), x).otherwise("Missing")


def tier(c: Column) -> Column:
    """C1, C2, Shared or Unknown from the usual spellings."""
    x = F.lower(collapse(c))
    return F.when(x.isin("c1", "client compiler", "c1 / client compiler"), "C1").when(x.isin("c2", "server compiler", "c2 / server compiler"), "C2").when(x == "shared", "Shared").otherwise("Unknown")


def first_lines(c: Column, n: int) -> Column:
    """The trimmed text if it has fewer than n lines; else n lines and a mark. A text that was cut off at its source
    also loses its last, partial line."""
    # Trimming takes off every character up to the blank, as the captured streams' reader does.
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    lines = F.split(x, "\n", -1)
    cut = x.contains(CUT_SHORT)
    many = F.size(lines) >= n
    kept = F.when(many, F.slice(lines, 1, n)).when(F.size(lines) > 1, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    short = F.regexp_replace(F.array_join(kept, "\n"), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.when((x != "") & (many | cut), F.concat(short, F.lit(CUT_MARK))).when((x == "") & (n <= 0), F.lit(CUT_MARK)).otherwise(x)


def without_noise(c: Column) -> Column:
    """Drop noise lines and mask object addresses."""
    keep = lambda l: ~(l.startswith(NOISE_PREFIX) | _any(l, NOISE_PARTS))  # noqa: E731, E741
    return F.regexp_replace(F.array_join(F.filter(F.split(c, "\n", -1), keep), "\n"), r"@[0-9a-fA-F]{4,}", "@ADDR")


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    out = c.contains(parts[0])
    for p in parts[1:]:
        out = out | c.contains(p)
    return out


def captured(c: Column, exit_code: Column, n: int = 1000) -> Column:
    """A captured stream ready for comparison; one that ended by time-out stays as it is."""
    return F.when(exit_code == TIMEOUT_CODE, c).otherwise(without_noise(first_lines(c, n)))


def clip(c: Column, budget: int, mark: str = CLIP_MARK) -> Column:
    """Head (68 %) and tail of a text that is longer than the budget."""
    if budget <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    head = max(int(budget * 0.68), 1)
    tail = max(budget - head - len(mark) - 4, 1)
    return F.when(F.length(c) <= budget, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit(f"\n{mark}\n"), F.right(c, F.lit(tail))))


def summary_lines(c: Column, n: int = 10) -> Column:
    """The first n lines that are not blank, joined by `` / ``."""
    return F.array_join(F.slice(F.filter(F.transform(F.split(c, "\n"), lambda l: F.trim(l)), lambda l: l != ""), 1, n), " / ")


def dense(c: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")


def content_hash(c: Column) -> Column:
    """SHA-256 of the text without white space."""
    return F.sha2(dense(c), 256)


def set_key(items: Column, scope: Column, version: str = "v3") -> Column:
    """Key of a bag of texts (or of their digests) within a scope, whatever their order."""
    return F.concat(F.lit(f"{version}."), F.sha2(F.concat_ws("\0", scope, F.array_sort(items)), 256))


def seed_key(scope: Column, targets: Column, ids: Column, files: Column, version: str = "v3") -> Column:
    """Composite key: scope; targets (array of struct of name and version), sorted; ids in their order; files (array of
    struct of name and digest of the bytes), sorted by name. Nulls count as empty texts."""
    part = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    pairs = lambda a: F.flatten(F.transform(F.array_sort(a), lambda x: F.array(part(x["name"]), part(x["value"]))))
    fields = F.concat(F.array(part(scope)), pairs(targets), F.transform(ids, part), pairs(files))
    return F.concat(F.lit(f"{version}."), F.sha2(F.array_join(fields, "\0"), 256))


def safe_name(c: Column) -> Column:
    """A name that is safe on every file system, 120 characters at most."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_")
    x = F.substring(F.regexp_replace(x, r"^[ .]+|[ .]+$", ""), 1, 120)
    return F.when(x == "", "unnamed.java").otherwise(x)


def identifier(c: Column) -> Column:
    """Every character that an identifier or version cannot hold to ``_``."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_$.-]", "_")


def strip_reasoning(c: Column) -> Column:
    """A response without reasoning tags and outside its code fence."""
    strip = lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")
    x = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<think>.*?</think>", ""))
    fence = r"(?is)```(?:json)?\s*(.*?)```"
    return F.when(x.rlike(fence), strip(F.regexp_extract(x, fence, 1))).otherwise(x)


def latex(c: Column) -> Column:
    """Characters that are special in LaTeX, escaped."""
    x = F.replace(c, F.lit("\\"), F.lit(r"\textbackslash{}"))
    for ch in "&%$#_{}":
        x = F.replace(x, F.lit(ch), F.lit("\\" + ch))
    return x


def percent(count: Column, total: Column) -> Column:
    """Share in percent, three decimals, halves to even; 0 where there is no total."""
    return F.coalesce(F.bround(F.lit(100.0) * count / F.nullif(total.cast("double"), F.lit(0.0)), 3), F.lit(0.0))


def percent_text(count: Column, total: Column) -> Column:
    """Share as text with two decimals."""
    return F.format_string("%.2f%%", F.coalesce(F.lit(100.0) * count / F.nullif(total.cast("double"), F.lit(0.0)), F.lit(0.0)))


def duration_text(seconds: Column) -> Column:
    """``Dd HHh MMm SSs``."""
    s = seconds.cast("bigint")
    return F.format_string("%dd %02dh %02dm %02ds", F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)


def version_line(c: Column) -> Column:
    """The first line that says something: not blank, not a note on picked-up options."""
    return F.get(F.filter(F.transform(F.split(c, r"\R"), lambda l: F.trim(l)), lambda l: (l != "") & ~l.startswith("Picked up ")), F.lit(0))


def output_name(c: Column) -> Column:
    """The issue key at the begin of an id (without letter case, with its suffix, before a dot), or the whole id."""
    m = F.regexp_extract(c, r"(?i)^((?:JDK|OpenJ9)-\d+(?:_[a-z]+)?)\..", 1)
    return F.when(m != "", m).otherwise(c)
