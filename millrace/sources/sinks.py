"""Sinks: CSV and JSON reports, bundles and logs. All go through Spark's commit protocol, so a reader never sees half a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_report(df: DataFrame, path: str, quote_all: bool = True) -> None:
    """Header and UTF-8; with quote_all every field is quoted and a quote is doubled."""
    df.write.mode("overwrite").option("header", "true").option("quoteAll", str(quote_all).lower()).option("escape", '"').option("nullValue", "").csv(path)


def json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def one_object(df: DataFrame, name: str = "report") -> DataFrame:
    """Each row as one JSON object text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


BOM = "\ufeff"


def csv_with_mark(df: DataFrame, path: str) -> None:
    """Header in every part and UTF-8 with a byte order mark, as spreadsheet programs want it."""
    first, *rest = df.columns
    csv_report(df.withColumnRenamed(first, BOM + first), path, quote_all=False)


def counters(df: DataFrame, value: str, names: tuple[str, ...]) -> DataFrame:
    """One JSON object with a count for each of the fixed names, 0 included, and the total."""
    return one_object(df.agg(*[F.count_if(F.col(value) == n).alias(n) for n in names], F.count("*").alias("total")))


def report_document(blocks: DataFrame, block: str = "block", value: str = "value", n: str = "n") -> DataFrame:
    """All distributions as one JSON document: block, then value, then count; each block has few values."""
    one = blocks.groupBy(block).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, n)))).alias("values"))
    by_name = lambda a, b: F.when(a[block] < b[block], -1).when(a[block] > b[block], 1).otherwise(0)
    return one.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(block, "values")), by_name))).alias("report"))


def free_names(df: DataFrame, scope: str, name: str, taken: str, *order: str) -> DataFrame:
    """Adds saved: the name, or the name with _1, _2 ... before its extension, such that within a scope no two rows have
    the same one without letter case; rows marked as taken keep theirs. Names are numbered over all rows of a base; where a
    numbered name is that of another row, it is numbered again (four rounds). The column of names must not be ``name``."""
    from millrace.operators.rank import numbered_names

    x = df.withColumns({"__free": (~F.col(taken)).cast("int"), "saved": F.col(name)})
    for _ in range(4):
        x = numbered_names(x.withColumnRenamed("saved", "__saved"), "__saved", scope, "__free", *order).withColumnRenamed("name", "saved").drop("__saved")
    return x.drop("__free")


def saved_bundle(before: DataFrame, manifest: DataFrame, fresh: DataFrame, scope: str = "issue_id") -> tuple[DataFrame, DataFrame]:
    """(files, manifest) of issue folders after saving ``fresh`` (scope, pos, original, content). Of the files that are there
    (scope, saved, content) only those that the previous manifest (scope, saved) lists are replaced, in the folders that are
    saved; all others stay, and no new file takes the name of one of them."""
    touched = fresh.select(scope).distinct()
    listed = manifest.join(touched, scope, "left_semi").select(scope, "saved").distinct()
    kept = before.join(listed, [scope, "saved"], "left_anti").select(scope, F.lit(-1).alias("pos"), F.col("saved").alias("original"), "content", F.lit(True).alias("taken"))
    preferred = F.when(F.lower("original").endswith(".java"), F.col("original")).otherwise(F.concat("original", F.lit(".java")))
    added = fresh.select(scope, "pos", preferred.alias("original"), "content", F.lit(False).alias("taken"))
    named = free_names(kept.unionByName(added), scope, "original", "taken", "pos")
    stays = manifest.join(touched, scope, "left_anti").select(scope, "saved")
    return named.select(scope, "saved", "content"), stays.unionByName(named.filter("NOT taken").select(scope, "saved"))


def patch_manifest(fixes: DataFrame, scope: str = "issue_id") -> DataFrame:
    """scope, pos, patch_file, patch_status of fixes (scope, pos, repository, sha, pull_request, patch_text): valid patches get a
    file name by pull request, commit or place, without collisions; a text that is no patch has the status invalid_content."""
    from millrace.functions.extract import valid_patch
    from millrace.functions.text import safe_name

    valid = F.coalesce(valid_patch(F.col("patch_text")), F.lit(False))
    repo = F.replace(F.coalesce(F.nullif(F.col("repository"), F.lit("")), F.lit("repo")), F.lit("/"), F.lit("-"))
    sha = F.left(F.coalesce("sha", F.lit("")), F.lit(12))
    last = F.when(F.col("pull_request").isNotNull(), F.concat(F.lit("pr"), F.col("pull_request").cast("string"))).when(sha != "", sha).otherwise(F.col("pos").cast("string"))
    base = safe_name(F.concat(F.lit("fix_"), repo, F.lit("_"), last, F.lit(".patch")))
    x = fixes.select(scope, "pos", base.alias("base"), valid.alias("valid"), (F.trim(F.coalesce("patch_text", F.lit(""))) != "").alias("text"))
    good = free_names(x.filter("valid").withColumn("taken", F.lit(False)), scope, "base", "taken", "pos").select(scope, "pos", F.col("saved").alias("patch_file"))
    return x.join(good, [scope, "pos"], "left").select(scope, "pos", "patch_file", F.when(F.col("text") & ~F.col("valid"), "invalid_content").alias("patch_status"))


def label_export(cases: DataFrame, label: str, wanted: str, there: DataFrame, overwrite: bool, dry_run: bool) -> tuple[DataFrame, DataFrame]:
    """(plan, scan): what happens to each case (case_id, result text) of the wanted label - copied, overwritten,
    skipped_existing, or selected in a dry run - and the counts of the scan in one row. ``there``: cases exported before."""
    v = F.try_parse_json("result")
    read = cases.select("case_id", "result", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("object"), F.lower(F.trim(F.try_variant_get(v, f"$.{label}", "string"))).alias("label"))
    known = F.coalesce(F.col("label").isin("yes", "no", "unclear"), F.lit(False))
    scan = read.agg(
        F.count("*").alias("case_dirs_seen"),
        *[F.count_if(F.col("label") == x).alias(x) for x in ("yes", "no", "unclear")],
        F.count_if(F.col("result").isNull()).alias("missing_result"),
        F.count_if(F.col("result").isNotNull() & ~F.col("object")).alias("invalid_json"),
        F.count_if(F.col("object") & ~known).alias("invalid_label"),
    )
    chosen = read.filter(F.col("label") == wanted.lower()).select("case_id")
    exists = chosen.join(there.select("case_id", F.lit(True).alias("__there")), "case_id", "left")
    action = F.lit("selected") if dry_run else F.when(F.col("__there").isNull(), "copied").otherwise("overwritten" if overwrite else "skipped_existing")
    return exists.select("case_id", action.alias("action")), scan


def bundle(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that df holds; what other runs saved stays."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def log_text(grouped: DataFrame, path: str, bugs_only: bool = False) -> None:
    """Contexts one after the other with a heading each; lines without a context first (left out with bugs_only)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("context")
    marked = grouped.withColumns({"__bug": F.max(F.col("text").contains("BUG FOUND")).over(w), "__first": F.min("line_no").over(w)})
    if bugs_only:
        marked = marked.filter("__bug AND context IS NOT NULL")
    rule = "=" * 54
    head = F.concat(F.lit(f"\n{rule}\nGroup: "), F.col("context"), F.when(F.col("__bug"), " [BUG]").otherwise(""), F.lit(f"\n{rule}\n"))
    text = F.when(F.col("context").isNotNull() & (F.col("line_no") == F.col("__first")), F.concat(head, F.col("text"))).otherwise(F.col("text"))
    marked.orderBy(F.col("context").isNotNull(), F.when(F.col("context").isNotNull(), F.col("__first")), "context", "line_no").select(text.alias("value")).write.mode("overwrite").text(path)


def taxonomy_latex(df: DataFrame) -> DataFrame:
    """category, pass, count rows as lines of a LaTeX table."""
    from millrace.functions.text import latex

    return df.select(F.concat(latex(F.col("category")), F.lit(" & "), latex(F.col("pass")), F.lit(" & "), F.col("count").cast("string"), F.lit(r" \\")).alias("line"))


def export_manifest(df: DataFrame, label: str) -> DataFrame:
    """Rows and labels of an export, one row."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("cases"))
