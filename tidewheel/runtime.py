"""Session helpers: worker imports, tables in the shared folder."""

from __future__ import annotations

import os
import sys
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
#: Folders written by ``cut`` that nobody has removed yet, newest last.
_written: list[str] = []
#: Whether Spark deletes the shuffle files of a statement when it ends; else they stay until the driver's JVM happens to
#: collect garbage. Read when a statement starts; Spark before 4.1 doesn't know it.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of each session that writes tables just now: its own value of SWEEP, and how many it writes.
_sweeping: dict[str, tuple[str | None, int]] = {}
_lock = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors.

    Nothing happens where the repository is on ``PYTHONPATH`` or the driver runs inside it; otherwise the package is
    zipped once per application and distributed with ``addPyFile``.
    """
    app = spark.sparkContext.applicationId
    on_path = str(ROOT) in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))
    if app in _shipped or on_path or Path.cwd() == ROOT or "site-packages" in str(ROOT):
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp()) / "tidewheel_worker.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "tidewheel").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    path = list(sys.path)
    spark.sparkContext.addPyFile(str(target))
    sys.path[:] = path


def shared_folder(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary folder; a cluster has no folder that all its machines
    see, so that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewheel"))
        leave(spark, sc._jsc.sc().getCheckpointDir().get())
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """With ``SWEEP`` on, for all statements of this session that run meanwhile; as it was once the last of them has ended."""
    key = spark._jsparkSession.sessionUUID()
    with _lock:
        before, running = _sweeping.get(key, (spark.conf.get(SWEEP, None), 0))
        _sweeping[key] = before, running + 1
        spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        with _lock:
            before, running = _sweeping[key]
            _sweeping[key] = before, running - 1
            if running == 1:
                del _sweeping[key]
                if before is None:
                    spark.conf.unset(SWEEP)
                else:
                    spark.conf.set(SWEEP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there: its lineage ends.

    The shuffle files that the write needed go with it, so that those of one table at a time are on disk. The table goes with
    the application at the latest.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    with _swept(spark):
        df.write.parquet(path)
    _written.append(path)
    leave(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def leave(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that no later read needs."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _written:
            _written.remove(path)


def last_cut() -> str:
    """The folder of the newest table, to be removed once a later table stands for it."""
    return _written[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside are deleted at the end: for a caller that has written its result by then."""
    before = len(_written)
    try:
        yield
    finally:
        remove(spark, *_written[before:])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
