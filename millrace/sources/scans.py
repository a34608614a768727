"""Scans of document trees: files, cases, metadata, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def texts(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, folder, file, text of whole files; hidden ones are skipped by Spark's file index."""
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return raw.select(path.alias("path"), F.element_at(F.split(path, "/"), -2).alias("folder"), F.element_at(F.split(path, "/"), -1).alias("file"), F.col("value").alias("text"))


def stamps(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, size, modified without reading any content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


# Fixed value: helper files that are no sources of their own.
HELPER_FILES = ("FuzzerUtils.java",)


def sources(files: DataFrame, excluded: tuple[str, ...] = HELPER_FILES) -> DataFrame:
    """Source files that are not helpers."""
    return files.filter(F.col("file").endswith(".java") & ~F.col("file").isin(*excluded))


def main_file(files: DataFrame, is_main: str = "has_main") -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected): folder and its file if exactly one has a main method, with all files if none has; folders with
    several are rejected."""
    by = files.groupBy("folder").agg(F.count_if(is_main).alias("mains"))
    chosen = files.join(by, "folder").filter(((F.col("mains") == 1) & F.col(is_main)) | (F.col("mains") == 0)).drop("mains")
    return chosen, by.filter("mains > 1")


def canonical_metadata(files: DataFrame, is_result: str) -> DataFrame:
    """folder, file: its metadata - named as the folder, else the first JSON that begins with the folder's name and is no result."""
    exact = F.col("file") == F.concat("folder", F.lit(".json"))
    fits = files.filter(F.col("file").endswith(".json") & ~F.col("file").rlike(is_result) & (exact | F.col("file").startswith(F.col("folder"))))
    w = W.partitionBy("folder").orderBy(F.desc(exact), "file")
    return fits.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("folder", "file")


def valid_cases(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Folders with metadata and a source."""
    return metadata.select("folder").join(sources(files).select("folder"), "folder", "left_semi")


def json_objects(files: DataFrame) -> DataFrame:
    """Adds object: the parsed JSON object, or null; the text stays beside it."""
    v = F.try_parse_json("text")
    return files.withColumn("object", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def listed(files: DataFrame, names: DataFrame, declared: str = "types") -> tuple[DataFrame, DataFrame]:
    """(found, missing): listed class names (``name``; blank and # lines are none) with the file that declares them."""
    wanted = names.select(F.trim("name").alias("name")).filter("name <> '' AND NOT startswith(name, '#')").distinct()
    index = files.select("path", F.explode(declared).alias("name")).groupBy("name").agg(F.min("path").alias("path"))
    return wanted.join(index, "name"), wanted.join(index, "name", "left_anti")


def stale(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Keys whose newest input is newer than the output, or that have none."""
    i, o = (d.groupBy(key).agg(F.max("modified").alias(n)) for d, n in ((inputs, "newest"), (outputs, "made")))
    return i.join(o, key, "left").filter("made IS NULL OR newest > made").select(key)


def coverage_lines(tracefiles: DataFrame) -> DataFrame:
    """path, line, hits of coverage trace files (file, text): records of ``SF:path``, ``DA:line,hits`` and ``end_of_record``."""
    lines = tracefiles.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("at", "t"))
    w = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    path = F.last(F.when(F.col("t").startswith("SF:"), F.regexp_replace("t", "^SF:", "")).when(F.col("t") == "end_of_record", ""), ignorenulls=True).over(w)
    hit = lines.withColumn("path", path).filter(F.col("t").rlike(r"^DA:\d+,\d+") & (F.col("path") != ""))
    number = lambda k: F.regexp_extract("t", r"^DA:(\d+),(\d+)", k).cast("bigint")
    return hit.select("path", number(1).cast("int").alias("line"), number(2).alias("hits"))


def coverage(counters: DataFrame, pattern: str, component: str) -> DataFrame:
    """component, lines, hit: merged line counters of the paths that match; component is the first group of the pattern."""
    merged = counters.filter(F.col("path").rlike(pattern)).groupBy("path", "line").agg(F.sum("hits").alias("hits"))
    return merged.groupBy(F.regexp_extract("path", component, 1).alias("component")).agg(F.count("*").alias("lines"), F.count_if(F.col("hits") > 0).alias("hit"))


def seeds(files: DataFrame) -> DataFrame:
    """One row for each source with a main method: folder, file, package, primary type, qualified name."""
    from millrace.functions import code, extract

    info = sources(files).withColumn("i", extract.source_info(code.masked(F.col("text")), F.col("file")))
    return info.filter("i.has_main").select("folder", "file", "i.package", "i.primary", extract.qualified_main(F.col("i")).alias("main_class"))
