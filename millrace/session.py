"""Session set-up and the places where intermediate tables are written."""

from __future__ import annotations

import atexit
import hashlib
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "millrace") -> SparkSession:
    """A session for tests and benches on one machine; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh local one if it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='millrace-')}")
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get()
    return at


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that their Python workers can import it."""
    sc = spark.sparkContext
    # With adaptive execution Spark 4.1 may take a union of differently coalesced inputs for one that is partitioned alike.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if getattr(sc, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    shared = shared_dir(spark)
    folder = Path(shared.removeprefix("file:")) if shared.startswith(("file:/", "/")) else Path(tempfile.mkdtemp(prefix="millrace-"))
    folder.mkdir(parents=True, exist_ok=True)
    at = folder / f"millrace-{digest}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, f"millrace/{f.relative_to(root)}")
    sc.addPyFile(str(at))
    sc._millrace_shipped = True


_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; it is deleted when the process ends, if not by ``release`` before."""
    if not _made:
        atexit.register(_clean)
    _made.append(f"{shared_dir(spark).rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of the shared folder."""
    p, fs = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file of the shared folder: it is written beside its place and moved there."""
    p, fs = _file_system(spark, path)
    beside, _ = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    if not fs.rename(beside, p):
        fs.delete(p, False)
        if not fs.rename(beside, p):
            raise OSError(f"{path} cannot be replaced")


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            release(spark)
    except Exception as e:  # noqa: BLE001 - the process is ending; what is left lies in the shared folder
        print(f"intermediate tables not deleted: {e}", file=sys.stderr)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process; call it when no result that reads them is needed any more."""
    n = 0
    while _made:
        p, fs = _file_system(spark, _made.pop())
        n += bool(fs.delete(p, True))
    return n


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``written``, when nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if any(path.split(":", 1)[-1].lstrip("/") == made.split(":", 1)[-1].lstrip("/") for made in _made):
            p, fs = _file_system(spark, path)
            fs.delete(p, True)


def written(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
