"""Session and shared-storage helpers used by every part of the library."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files once it has ended; a stage that is run again makes them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own; on a
    cluster there is no folder to fall back to, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="paceledger-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class _Scopes(threading.local):
    """The tables that are being gathered by each open ``scratch`` of a thread, innermost last."""

    def __init__(self) -> None:
        self.open: list[list[DataFrame]] = []


_scopes = _Scopes()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and it gives
    the planner the table's true size, so that a later join is broadcast only
    if the side is really small. Spark removes a step's shuffle files when it
    has ended, by a setting that the session keeps from the first step on.
    ``discard`` deletes the table once nothing reads it any more, and so does
    the end of a ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paceledger-{name}-{uuid.uuid4().hex}"
    if spark.conf.get(CLEANUP, "false") != "true":
        spark.conf.set(CLEANUP, "true")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._paceledger_path = path
    for scope in _scopes.open[-1:]:
        scope.append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned; no DataFrame that reads them may be run afterwards."""
    for table in tables:
        if path := getattr(table, "_paceledger_path", None):
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, where it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialize`` writes inside go at the end, but for those given to the function that this yields.

    For jobs whose result is written before the end: what a lazy result still reads must be kept.
    """
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.open.append(made)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _scopes.open.pop()
        discard(*[t for t in made if all(t is not k for k in kept)])


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for sessions whose workers can't import it; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="paceledger-"), "paceledger-package")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root)))
