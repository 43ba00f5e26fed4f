"""Session set-up and the places where jobs may write.

Everything that must outlive an executor goes to the folder that the cluster names in
``spark.checkpoint.dir``; a private folder is made only where that setting is absent
(local tests).
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shutterloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_shutterloom_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
    to = os.path.join(tempfile.mkdtemp(prefix="shutterloom-"), f"{PACKAGE.name}.zip")
    Path(to).write_bytes(buffer.getvalue())
    sc.addPyFile(to)
    sc._shutterloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(sc, "_shutterloom_folder", None)
        if folder is None:
            folder = sc._shutterloom_folder = "file://" + tempfile.mkdtemp(prefix="shutterloom-shared-")
            if sc.getCheckpointDir() is None:
                sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/shutterloom/{name}-{uuid.uuid4().hex}"


#: Spark then deletes the shuffles of a query when it ends, instead of when the driver collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: its lineage ends there, and its shuffles are
    deleted. :func:`dropped` deletes the table."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._shutterloom_path = path
    if _OPEN:
        _OPEN[-1].made.append(out)
    return out


class Scratch:
    """Tables that were written in a block; those that are not kept are deleted at its end."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []
        self.kept: set[str] = set()

    def keep(self, *tables: DataFrame) -> None:
        self.kept |= {t._shutterloom_path for t in tables if hasattr(t, "_shutterloom_path")}


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Deletes the tables that :func:`written` makes in the block, but for the kept ones; blocks may be nested, and an
    inner one's kept tables are then the outer one's."""
    own = Scratch()
    _OPEN.append(own)
    try:
        yield own
    finally:
        _OPEN.remove(own)
        for t in own.made:
            if t._shutterloom_path not in own.kept:
                dropped(t)
            elif _OPEN:
                _OPEN[-1].made.append(t)


_OPEN: list[Scratch] = []


def dropped(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` gave and nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t._shutterloom_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
