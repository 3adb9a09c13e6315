"""A store whose readers see the state before or after a write, never half of it.

``data/version=<n>/date=<day>/`` holds the days that version n wrote, and
``versions/v=<n>/`` lists, for every day of the store, the folder that has it: one
row a day. A version counts once the list's job has committed (its ``_SUCCESS``),
which is the one switch: before it the new folders are unknown, after it the days
written anew come from them and all others from where they were. Whatever a killed
write leaves behind is overwritten by the next one. A reader that has begun keeps
its files until ``clear`` removes versions that are no longer wanted.

Only folder names and one row per day pass through the driver. There is one writer
at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceledger.operators.store import date_window
from paceledger.session import remove

LIST = "date DATE, version BIGINT"
NO_DATE = "__HIVE_DEFAULT_PARTITION__"


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it isn't there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, oldest first."""
    found = [n for n in names_in(spark, f"{path}/versions") if n.startswith("v=")]
    return sorted(int(n[2:]) for n in found if "_SUCCESS" in names_in(spark, f"{path}/versions/{n}"))


def current(spark: SparkSession, path: str) -> int | None:
    return max(numbers(spark, path), default=None)


def days(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(date, version): where each day of a version lies."""
    return spark.read.schema(LIST).parquet(f"{path}/versions/v={version}")


def read(spark: SparkSession, path: str, schema: str, start=None, end=None, version: int | None = None) -> DataFrame:
    """The store's rows (of the current version) in a window of dates; only the window's folders are listed and read."""
    version = current(spark, path) if version is None else version
    if version is None:
        return spark.createDataFrame([], schema)
    rows = date_window(days(spark, path, version), start, end).collect()
    folders = [f"{path}/data/version={r['version']}/date={r['date'] or NO_DATE}" for r in rows]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).drop("version")


def publish(rows: DataFrame, path: str, write, keep_days: DataFrame | None = None) -> int:
    """Write ``rows`` as the next version and switch to it; its number.

    ``write(rows, folder)`` writes them by date. ``keep_days`` (date, version) are
    the days that stay where they are; days that ``rows`` holds take their place.
    """
    spark = rows.sparkSession
    version = max([0, *(int(n[2:]) for n in names_in(spark, f"{path}/versions") if n.startswith("v="))]) + 1
    folder = f"{path}/data/version={version}"
    remove(spark, folder)
    write(rows, folder)
    written = [n[5:] for n in names_in(spark, folder) if n.startswith("date=")]
    new = spark.createDataFrame([(None if d == NO_DATE else d, version) for d in written], "date STRING, version BIGINT").withColumn("date", F.col("date").cast("date"))
    if keep_days is not None:
        taken = new.select(F.col("date").alias("_d"))
        new = new.unionByName(keep_days.join(F.broadcast(taken), F.col("date").eqNullSafe(F.col("_d")), "left_anti").select("date", "version"))
    new.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v={version}")
    return version


def clear(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all versions but the newest ``keep``, and the folders that none of these reads."""
    known = numbers(spark, path)
    kept = known[-keep:]
    wanted = {(r["version"], str(r["date"] or NO_DATE)) for v in kept for r in days(spark, path, v).collect()}
    for v in known[:-keep]:
        remove(spark, f"{path}/versions/v={v}")
    for name in names_in(spark, f"{path}/data"):
        v = int(name.split("=")[1])
        if v > max(kept, default=0):
            continue
        for day in names_in(spark, f"{path}/data/{name}"):
            if day.startswith("date=") and (v, day[5:]) not in wanted:
                remove(spark, f"{path}/data/{name}/{day}")
        if not any(day.startswith("date=") for day in names_in(spark, f"{path}/data/{name}")):
            remove(spark, f"{path}/data/{name}")
