import json

import pytest
import os

from pyspark.sql import functions as F

from millrace.operators.timeline import window_statistics
from millrace.sources import scans, sinks
from millrace.streaming import logs, windows

LINES = "start\n[INFO ] [t] a - one\n[INFO ] [t] ctx1] - x\n[c1] - hello\n  more\nBUG FOUND\n[INFO ] plain\nlost\n[c2] - z\n[c1] - again\n"


def lines(spark):
    return spark.createDataFrame([("f", k, t) for k, t in enumerate(LINES.splitlines())], "source string, line_no bigint, text string")


def test_log_groups(spark, tmp_path):
    g = logs.grouped_lines(lines(spark))
    got = {r["line_no"]: r["context"] for r in g.collect()}
    assert (got[0], got[3], got[4], got[5], got[6], got[7], got[8], got[9]) == (None, "c1", "c1", "c1", None, None, "c2", "c1")
    rep = {r["context"]: (r["lines"], r["has_bug"]) for r in logs.group_report(g).collect()}
    assert rep["c1"] == (4, True) and rep["c2"] == (1, False)
    sinks.log_text(g, str(tmp_path / "l"), bugs_only=True)
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "l")).collect())
    assert "Group: c1 [BUG]" in text and "c2" not in text and "lost" not in text


def test_log_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = LINES.splitlines()
    for k, (a, b) in enumerate(((0, 5), (5, 8), (8, len(rows)))):
        (src / f"{k}.json").write_text("".join(json.dumps({"source": "f", "line_no": n, "text": rows[n]}) + "\n" for n in range(a, b)))
        os.utime(src / f"{k}.json", (1_700_000_000 + k,) * 2)  # the file source reads the oldest first
    stream = spark.readStream.schema("source string, line_no bigint, text string").option("maxFilesPerTrigger", 1).json(str(src))
    q = logs.stream_grouped_lines(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["line_no"], r["context"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(r["line_no"], r["context"]) for r in logs.grouped_lines(lines(spark)).collect()}


def test_window_stream_equals_batch(spark, tmp_path):
    s = spark.range(400).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 3).alias("ts"), (F.col("id") % 3 > 0).alias("productive"), (F.col("id") % 7 / 7).alias("cpu"), (F.col("id") % 50).alias("wait_ms"))
    s.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    q = windows.stream_statistics(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, window_statistics(s, "ts").collect()))


def test_first_of_signature_and_upserts(spark, tmp_path):
    s = spark.range(20).select(F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"), (F.col("id") % 4).alias("k"), "id")
    s.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    q = windows.stream_first_of(stream, F.col("k").cast("string"), "ts").writeStream.format("memory").queryName("d").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("d").count() == 4
    write = windows.upsert_sink(str(tmp_path / "state"), "k", "id")
    write(s.filter("id < 10"), 0)
    write(s.filter("id >= 10 AND k < 2"), 1)
    write(s.filter("id >= 10 AND k < 2"), 1)
    assert {r["k"]: r["id"] for r in spark.read.parquet(str(tmp_path / "state/version=1")).collect()} == {0: 16, 1: 17, 2: 6, 3: 7}


def test_scans(spark, tmp_path):
    tree = {"A/A.java": "class A { public static void main(String[] a) { } }", "A/B.java": "class B { }", "A/FuzzerUtils.java": "x", "A/A.json": '{"id": 1}', "A/Ax.json": "[1]", "B/M1.java": "main", "B/M2.java": "main", "B/Bz.json": "{broken", "B/B_llm_type.json": "{}", ".hidden/C.java": "x"}
    for name, text in tree.items():
        p = tmp_path / "t" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = scans.texts(spark, str(tmp_path / "t"))
    assert {(r["folder"], r["file"]) for r in scans.sources(files).collect()} == {("A", "A.java"), ("A", "B.java"), ("B", "M1.java"), ("B", "M2.java")}
    chosen, rejected = scans.main_file(scans.sources(files).withColumn("has_main", F.col("text").contains("main")))
    assert [(r["folder"], r["file"]) for r in chosen.collect()] == [("A", "A.java")] and [r["folder"] for r in rejected.collect()] == ["B"]
    assert [(r["file"], r["main_class"]) for r in scans.seeds(files).collect()] == [("A.java", "A")]
    meta = scans.canonical_metadata(files, r"_llm_")
    assert {(r["folder"], r["file"]) for r in meta.collect()} == {("A", "A.json"), ("B", "Bz.json")}
    assert {r["folder"] for r in scans.valid_cases(files, meta).collect()} == {"A", "B"}
    objs = scans.json_objects(files.filter(F.col("file").endswith(".json"))).select("file", F.col("object").isNotNull().alias("ok"))
    assert {r["file"]: r["ok"] for r in objs.collect()} == {"A.json": True, "Ax.json": False, "Bz.json": False, "B_llm_type.json": True}
    found, missing = scans.listed(files.filter("folder = 'A'").select("path", F.split("file", r"\.")[0].alias("n")).select("path", F.array("n").alias("types")), spark.createDataFrame([("A",), (" ",), ("# x",), ("Z",)], "name string"))
    assert [r["name"] for r in found.collect()] == ["A"] and [r["name"] for r in missing.collect()] == ["Z"]
    st = scans.stamps(spark, str(tmp_path / "t"), "*.java").withColumn("key", F.lit("k"))
    assert scans.stale(st, st.limit(0), "key").count() == 1 and scans.stale(st, st.withColumn("modified", F.expr("modified + INTERVAL 1 DAY")), "key").count() == 0


def test_coverage(spark):
    c = spark.createDataFrame([("/src/hotspot/a/x", 1, 0), ("/src/hotspot/a/x", 1, 2), ("/src/hotspot/a/x", 2, 0), ("/lib/y", 1, 1)], "path string, line int, hits bigint")
    assert [tuple(r) for r in scans.coverage(c, "/src/hotspot/", "/src/hotspot/([^/]+)/").collect()] == [("a", 2, 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y'), (2, None)], "k int, t string")
    sinks.csv_report(df, str(tmp_path / "c"))
    body = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("*.csv")))
    assert '"1","say ""x"", y"' in body
    sinks.json_report(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert json.loads(sinks.one_object(df.limit(1)).head(1)[0][0]) == {"k": 1, "t": 'say "x", y'}
    sinks.bundle(df, str(tmp_path / "b"), "k")
    sinks.bundle(df.filter("k = 2").withColumn("t", F.lit("new")), str(tmp_path / "b"), "k")
    assert {r["k"]: r["t"] for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {1: 'say "x", y', 2: "new"}
    tex = sinks.taxonomy_latex(spark.createDataFrame([("a_b", "c & d", 3)], "category string, pass string, count int")).head(1)[0][0]
    assert tex == r"a\_b & c \& d & 3 \\"
    assert {r["label"]: r["cases"] for r in sinks.export_manifest(df.withColumn("l", F.lit("Yes")), "l").collect()} == {"Yes": 2}


def test_case_tree_source(spark, tmp_path):
    from millrace.sources import case_tree

    for k in range(7):
        (tmp_path / f"c{k}").mkdir()
        (tmp_path / f"c{k}" / "A.java").write_text(f"class A{k} {{ }}")
        (tmp_path / f"c{k}" / "x.json").write_text("{}")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "B.java").write_text("x")
    case_tree.register(spark)
    df = spark.read.format("case_tree").option("suffix", ".java").option("folders_per_task", 3).load(str(tmp_path))
    assert {(r["folder"], r["file"], r["text"]) for r in df.collect()} == {(f"c{k}", "A.java", f"class A{k} {{ }}") for k in range(7)}
    assert df.rdd.getNumPartitions() == 3 and df.filter("error IS NOT NULL").count() == 0


def test_log_tail_reads_complete_lines_once(spark, tmp_path):
    from millrace.sources import log_tail

    log_tail.register(spark)
    assert log_tail.complete_end(__file__, 0) == 0
    (tmp_path / "in").mkdir()
    a, b = tmp_path / "in/a.log", tmp_path / "in/b.log"

    def run():
        q = spark.readStream.format("log_tail").option("bytes_per_task", 7).load(str(tmp_path / "in/*.log")).writeStream.format("parquet")
        q.option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["text"] for r in spark.read.schema("source string, offset bigint, text string").parquet(str(tmp_path / "out")).collect())

    a.write_bytes(b"first\nsecond line that is longer than a task\r\npart")
    assert run() == ["first", "second line that is longer than a task"]
    a.write_bytes(b"first\nsecond line that is longer than a task\r\npart done\n")
    b.write_bytes("übel\n\n\xff".encode("utf-8") + b"\xff\n")
    got = run()
    assert got[:2] == ["", "first"] and "part done" in got and "übel" in got and len(got) == 6
    a.write_bytes(b"new\n")  # shorter than before: read again from its begin
    assert "new" in run() and len(run()) == 7


def test_names_stay_free(spark):
    rows = [("i", k, n, t) for k, (n, t) in enumerate([("a.java", True), ("A.java", False), ("a_1.java", False), ("a.java", False), ("b", False)])]
    df = spark.createDataFrame(rows + [("j", 0, "a.java", False)], "issue_id string, pos int, original string, taken boolean")
    got = {(r["issue_id"], r["pos"]): r["saved"] for r in sinks.free_names(df, "issue_id", "original", "taken", "pos").collect()}
    assert got["i", 0] == "a.java" and got["i", 1] == "A_1.java" and got["j", 0] == "a.java" and len({n.lower() for (i, _), n in got.items() if i == "i"}) == 5


def test_shared_folder_is_asked_for(monkeypatch):
    from types import SimpleNamespace

    from millrace import session

    class Context:
        master = "spark://host:7077"
        _jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=Context())
    with pytest.raises(RuntimeError):
        session.shared_dir(fake)
