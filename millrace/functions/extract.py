"""Extraction of names, blocks, links and fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of compiler messages, code blocks and links.
ERROR_LINE = r"(?:\.java:(\d+): ?(?i:error))|(?:\(at line (\d+)\))"
MISSING_CLASS = r"(?is)error:\s+cannot\s+find\s+symbol.*?\bsymbol:\s+class\s+\S+"
ISSUE_NAME = r"\b((?:[a-z][a-z0-9_]*\.)*(?:[A-Z][a-zA-Z0-9_$]*)?(?:Exception|Error))\b"
SOURCE_BLOCK = r"(?is)-+\s*BEGIN\s+SOURCE\s*-+\s*(.*?)\s*-+\s*END\s+SOURCE\s*-+"
FENCED_BLOCK = r"(?is)```(?:java)?[ \t]*\n(.*?)\n```"
ATTACHMENT_URL = r"(?i)https://github\.com/user-attachments/files/\d+/[^\s)>\]]+\.java(?:\?[^\s)>\]]+)?"
TYPE_DECLARATION = r"\b(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record)\s+([A-Za-z_$][A-Za-z0-9_$]*)[^{;]*\{"
MAIN_METHOD = r"public\s+static\s+void\s+main\s*\(\s*String\s*(?:\[\s*\]|\.\.\.)"


def streams(stdout: Column, stderr: Column) -> Column:
    """Both streams as one text."""
    return F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))


def error_lines(text: Column) -> Column:
    """``Line-n`` for each compiler message, in the order of the text."""
    both = lambda k: F.regexp_extract_all(text, F.lit(ERROR_LINE), F.lit(k))
    return F.zip_with(both(1), both(2), lambda a, b: F.concat(F.lit("Line-"), F.when(a != "", a).otherwise(b)))


def failure_reason(text: Column) -> Column:
    """The first reason that fits, of five; else NONE."""
    low = F.lower(text)
    return (
        F.when(text.rlike(MISSING_CLASS), "COMPILER_SYMBOL_NOT_FOUND")
        .when(
            low.contains("local variables referenced from a lambda expression must be final or effectively final")
            | (low.contains("local variable") & low.contains("is required to be final or effectively final based on its usage")),
            "COMPILER_LAMBDA_CAPTURE_EFFECTIVELY_FINAL",
        )
        .when(low.contains("bad return type in lambda expression") & low.contains("missing return value"), "COMPILER_LAMBDA_MISSING_RETURN_VALUE")
        .when(low.contains("unreachable code"), "COMPILER_UNREACHABLE_CODE")
        .when(text.contains("missing return statement") | text.contains("method must return a result"), "COMPILER_MISSING_RETURN")
        .otherwise("NONE")
    )


def canonical_lines(reason: Column, lines: Column) -> Column:
    """The fingerprint of a failure: for reasons that compilers word differently the reason itself stands for it."""
    same = F.when(reason.isin("COMPILER_MISSING_RETURN", "COMPILER_LAMBDA_CAPTURE_EFFECTIVELY_FINAL"), reason).when(
        reason.isin("COMPILER_LAMBDA_MISSING_RETURN_VALUE", "COMPILER_UNREACHABLE_CODE"), F.lit("COMPILER_LAMBDA_MISSING_RETURN_VALUE")
    )
    return F.when(same.isNotNull(), F.array(same)).otherwise(F.array_sort(F.array_distinct(lines)))


def issue_names(text: Column) -> Column:
    """Names of exceptions and errors, once for each time they occur outside stack frames; a name followed by a dot
    (a call or a class inside it) does not count."""
    frame = lambda l: F.trim(l).startswith("at ") | F.trim(l).startswith("...")
    found = F.transform(
        F.filter(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda l: ~frame(l)),
        lambda l: F.regexp_extract_all(F.regexp_replace(l, r"Exception in thread", " "), F.lit(ISSUE_NAME + r"(?!\.)"), F.lit(1)),
    )
    return F.flatten(found)


def crashed(text: Column, exit_code: Column) -> Column:
    """Marks of a crash; a core dump counts only without memory exhaustion."""
    return (
        text.contains("Segmentation fault")
        | text.contains("A fatal error has been detected")
        | exit_code.isin(134, 139)
        | (text.contains("core dump") & ~text.contains("OutOfMemoryError"))
    )


def main_missing(text: Column, exit_code: Column) -> Column:
    return (exit_code != 0) & (text.contains("Could not find or load main class") | text.contains("ClassNotFoundException"))


def source_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SOURCE_BLOCK), F.lit(1))


def fenced_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FENCED_BLOCK), F.lit(1))


def attachment_urls(text: Column) -> Column:
    """Distinct links, in the order of the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ATTACHMENT_URL), F.lit(0)))


def declared_types(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit("(?s)" + TYPE_DECLARATION), F.lit(1))


def source_info(masked: Column, file: Column) -> Column:
    """Package, all types, the type the file is named after (else the first) and whether there is a main method;
    ``masked``: code with comments and literals blanked out."""
    names = declared_types(masked)
    named = F.filter(names, lambda n: F.concat(n, F.lit(".java")) == file)
    package = F.nullif(F.regexp_extract(masked, r"(?m)^\s*package\s+([A-Za-z0-9_.$]+)\s*;", 1), F.lit(""))
    return F.struct(package.alias("package"), names.alias("types"), F.coalesce(F.get(named, F.lit(0)), F.get(names, F.lit(0))).alias("primary"), masked.rlike(MAIN_METHOD).alias("has_main"))


def qualified_main(info: Column) -> Column:
    return F.concat_ws(".", info["package"], info["primary"])


# Addresses and titles of commits.
COMMIT_URLS = (
    r"(?i)https?://git\.openjdk\.org/([^/]+)/commit/([0-9a-f]{7,40})",
    r"(?i)https?://github\.com/openjdk/([^/]+)/commit/([0-9a-f]{7,40})",
    r"(?i)https?://git\.openjdk\.java\.net/([^/]+)/commit/([0-9a-f]{7,40})",
)
COMMIT_TITLE = r"(?i)\bopenjdk/([A-Za-z0-9_.-]+)/([0-9a-f]{7,40})\b"


def commit_link(url: Column, title: Column) -> Column:
    """repository and sha of a commit link, from its address, else from its title; null if neither has them."""
    from_ = lambda c, p: F.when(c.rlike(p), F.struct(F.concat(F.lit("openjdk/"), F.regexp_extract(c, p, 1)).alias("repository"), F.regexp_extract(c, p, 2).alias("sha")))
    return F.coalesce(*[from_(url, p) for p in COMMIT_URLS], from_(title, COMMIT_TITLE))


def repository_of(api_url: Column) -> Column:
    return F.nullif(F.regexp_extract(api_url, r"/repos/([^/]+/[^/?#]+)", 1), F.lit(""))


def valid_patch(text: Column) -> Column:
    """Text of a patch: a git diff or both headers of a unified diff, and no JSON payload."""
    s = F.trim(F.coalesce(text, F.lit("")))
    payload = (s.startswith("{") | s.startswith("[")) & F.try_parse_json(s).isNotNull()
    return (s != "") & ~payload & (F.coalesce(text, F.lit("")).contains("diff --git ") | (text.rlike(r"(?m)^---\s+\S+") & text.rlike(r"(?m)^\+\+\+\s+\S+")))


def loop_detail(detail: Column) -> Column:
    """depth and count of a loop's detail text."""
    return F.struct(
        F.try_to_number(F.regexp_extract(detail, r"Depth:\s*(\d+)", 1), F.lit("9999999999")).cast("int").alias("depth"),
        F.nullif(F.regexp_extract(detail, r"Count:\s*(.+)$", 1), F.lit("")).alias("bucket"),
    )


def response_objects(raw: Column) -> Column:
    """The array of result objects of a response as JSON texts: the whole, else its outermost braces; an object with
    ``results`` or a bare array. Null if nothing parses."""
    from millrace.functions.text import strip_reasoning

    x = strip_reasoning(raw)
    whole = F.try_parse_json(x)
    inner = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    v = F.coalesce(whole, F.when(inner != "", F.try_parse_json(inner)))
    results = F.coalesce(F.try_variant_get(v, "$.results", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    return F.transform(F.filter(results, lambda o: F.schema_of_variant(o).startswith("OBJECT")), lambda o: F.to_json(o))


def usage_counts(raw: Column) -> Column:
    """Token counts of a usage object, the nested count of cached tokens included."""
    v = F.try_parse_json(raw)
    keys = ("prompt_tokens", "completion_tokens", "total_tokens", "prompt_cache_hit_tokens", "prompt_cache_miss_tokens", "cache_hit_tokens", "cache_miss_tokens")
    return F.struct(*[F.try_variant_get(v, f"$.{k}", "bigint").alias(k) for k in keys], F.try_variant_get(v, "$.prompt_tokens_details.cached_tokens", "bigint").alias("cached_tokens"))


def related_issues(issues: DataFrame, key: str, links: str, prefix: str) -> DataFrame:
    """src, dst, relation from an array of links (outward, inward: struct of key; type: struct of outward, inward, name):
    both directions, relations that relate or duplicate, keys of the given prefix only."""
    l = issues.select(F.col(key).alias("src"), F.explode(links).alias("l"))
    sides = [l.select("src", F.trim(f"l.{side}.key").alias("dst"), F.trim(F.coalesce(F.nullif(F.col(f"l.type.{side}"), F.lit("")), F.col("l.type.name"), F.lit(""))).alias("relation")) for side in ("outward", "inward")]
    low = F.lower("relation")
    return sides[0].unionByName(sides[1]).filter(F.col("dst").startswith(prefix) & (low.contains("relates to") | low.contains("duplicate")))


def timeline_refs(events: DataFrame, key: str, event: str, home: str) -> DataFrame:
    """key, kind (pull or commit), repository, ref from heterogeneous events in JSON (three shapes), in the order given by pos."""
    v = F.try_parse_json(event)
    at = lambda p: F.try_variant_get(v, p, "string")
    base = events.select(key, "pos", home, v.alias("v"), at("$.source.issue.pull_request").alias("pr"), at("$.source.issue.repository_url").alias("pr_repo"), at("$.source.issue.number").alias("pr_no"), at("$.commit_id").alias("sha"), at("$.commit_url").alias("sha_url"), at("$.subject.type").alias("kind"), at("$.subject.url").alias("url"))
    own = lambda u: F.coalesce(repository_of(u), F.col(home))
    pulls = base.filter("pr IS NOT NULL AND pr_no IS NOT NULL").select(key, "pos", F.lit("pull").alias("kind"), own(F.col("pr_repo")).alias("repository"), F.col("pr_no").alias("ref"))
    commits = base.filter("sha <> ''").select(key, "pos", F.lit("commit").alias("kind"), own(F.col("sha_url")).alias("repository"), F.col("sha").alias("ref"))
    last = F.regexp_extract("url", r"([0-9]+)/*$", 1)
    subjects = base.filter((F.col("kind") == "PullRequest") & (last != "")).select(key, "pos", F.lit("pull").alias("kind"), own(F.col("url")).alias("repository"), last.alias("ref"))
    return pulls.unionByName(commits).unionByName(subjects)
