"""Session creation and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session made here; a cluster's own session is taken as it is.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`DEFAULTS`; keyword arguments use ``__`` for the dots of a setting's name."""
    builder = SparkSession.builder.appName("lexmill")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as named by ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a folder of this process is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_folder.get(spark.sparkContext.applicationId)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = _own_folder[spark.sparkContext.applicationId] = f"file://{path}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_own_folder: dict[str, str] = {}
#: Paths of the tables of write_shared that are still there, each with what deletes it.
_tables: dict[str, Callable[[], object]] = {}


def _deleter(spark: SparkSession, path: str) -> Callable[[], object]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return lambda: system.delete(target, True)


def write_shared(df: DataFrame, name: str = "cut", partition_by: tuple[str, ...] = ()) -> str:
    """Writes ``df`` as Parquet in the shared folder and returns the path.

    The table is deleted, on whatever file system it lies, by :func:`drop_shared`, :func:`drop_all_shared` or when the
    driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexmill-{name}-{uuid.uuid4().hex}"
    _tables[path] = _deleter(spark, path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written to and read again from the shared folder: later stages don't recompute it, and any executor may be lost."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


def drop_shared(spark: SparkSession, path: str) -> None:
    """Deletes a table of :func:`write_shared` that is not needed any more."""
    (_tables.pop(path, None) or _deleter(spark, path))()


def drop_all_shared() -> None:
    """Deletes all tables written so far: results that still read them must have been used or written elsewhere."""
    while _tables:
        with contextlib.suppress(Exception):  # the JVM may be gone when Python ends
            _tables.popitem()[1]()


atexit.register(drop_all_shared)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster on which it isn't installed."""
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lexmill-zip-"), "lexmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lexmill", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
