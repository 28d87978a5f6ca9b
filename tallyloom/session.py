"""Session helpers: a tuned local session, the shared folder, shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_KEPT: list[tuple[SparkSession, str]] = []
_OPEN = threading.local()  # tables written while a table is being built, per thread and level


def local_session(app: str = "tallyloom", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TALLYLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return spark
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tallyloom-")) / "tallyloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(archive))  # Spark's file server hands it to every executor
    _SHIPPED.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder.

    Where none is set, a local session gets a temporary one; on a cluster that is an error, as executors would write to their
    own disks and what they wrote would be missing when it is read.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        have = sc._jsc.sc().getCheckpointDir()
        found = have.get() if have.isDefined() else None
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyloom-shared-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def keep(df: DataFrame | Callable[[], DataFrame], tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Given a function that makes the frame, the tables kept while it runs are removed once its result is written.
    """
    levels: list[list[str]] = _OPEN.__dict__.setdefault("levels", [])
    inner: list[str] = []
    if not isinstance(df, DataFrame):
        levels.append(inner)
        try:
            df = df()
        finally:
            levels.pop()
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tallyloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for done in inner:
        _remove(spark, done)
    if not _KEPT:
        atexit.register(drop_kept)
    _KEPT.append((spark, path))
    if levels:
        levels[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the gateway may be gone already
        pass


def drop_kept() -> None:
    """Remove the tables written by :func:`keep`: after a query whose result is used up, and when the driver ends."""
    while _KEPT:
        _remove(*_KEPT.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
