"""Readers of landed dumps, the store, the registry, policies, assessments and audit logs. Every JSON read has a schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceledger import schemas
from paceledger.operators.audit import filter_audit, flatten_audit, recent_events
from paceledger.operators.connectors import explode_registry
from paceledger.operators.policy import flatten_policy
from paceledger.operators.store import date_window
from paceledger.sources import landing, versions


def scan_activities(spark: SparkSession, path: str, start=None, end=None, descriptor: str | None = None) -> DataFrame:
    """Raw activities, in an inclusive window of UTC dates, of one descriptor if given.

    Lines that aren't JSON are left out; ``landing.read_lines`` gives their text,
    and ``landing.land`` keeps dumps by day and descriptor, so that a window
    reads its own folders only.
    """
    rows = landing.read_lines(spark, path, schemas.ACTIVITIES)[0]
    if descriptor is not None:
        rows = rows.where(F.col("descriptor") == descriptor)
    day = rows.withColumn("_day", F.to_date(F.timestamp_millis("date")))
    return date_window(day, start, end, "_day").drop("_day")


def scan_trivia(spark: SparkSession, path: str, start=None, end=None, descriptor: str = "gds") -> DataFrame:
    return scan_activities(spark, path, start, end, descriptor)


def scan_game_logs(spark: SparkSession, playthroughs: str, engagement: str, descriptors: tuple[str, str], start=None, end=None) -> tuple[DataFrame, DataFrame]:
    return scan_activities(spark, playthroughs, start, end, descriptors[0]), scan_activities(spark, engagement, start, end, descriptors[1])


def scan_fit_points(spark: SparkSession, path: str, start_nanos: int | None = None, end_nanos: int | None = None) -> DataFrame:
    """Fit points, those whose start lies in [start_nanos, end_nanos] where bounds are given."""
    rows = landing.read_lines(spark, path, schemas.FIT_POINTS)[0]
    low = -(2**62) if start_nanos is None else start_nanos
    high = 2**62 if end_nanos is None else end_nanos
    if start_nanos is None and end_nanos is None:
        return rows
    return rows.withColumn("point", F.filter("point", lambda p: p["startTimeNanos"].try_cast("bigint").between(low, high))).where(F.size("point") > 0)


def scan_daily(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """The daily store as it stands; of a window only its days' folders are read."""
    return versions.read(spark, path, schemas.DAILY, start, end)


def scan_registry(spark: SparkSession, path: str) -> DataFrame:
    """The connector rows of a registry file; a document without a users list gives none."""
    return explode_registry(spark.read.option("multiLine", True).schema(schemas.REGISTRY).json(path))


def scan_users(spark: SparkSession, path: str) -> DataFrame:
    users = spark.read.option("multiLine", True).schema(schemas.REGISTRY).json(path)
    return users.select(F.explode("users").alias("u")).select("u.user_id")


def scan_policy(spark: SparkSession, path: str, on_missing: str = "raise") -> DataFrame:
    """A policy file's rules. A missing or broken file raises; with on_missing="allow" it is an empty policy, which allows all."""
    try:
        doc = spark.read.option("multiLine", True).option("mode", "PERMISSIVE" if on_missing == "allow" else "FAILFAST").schema(schemas.POLICY).json(path)
    except AnalysisException:
        if on_missing != "allow":
            raise
        doc = spark.createDataFrame([], schemas.POLICY)
    return flatten_policy(doc)


def scan_audit(spark: SparkSession, *paths: str) -> DataFrame:
    """Audit events; malformed lines are skipped."""
    return _audit(spark, *paths).drop("day")


def _audit(spark: SparkSession, *paths: str) -> DataFrame:
    """Audit events with the ``day`` of their partition, where the log has such."""
    rows = spark.read.schema(schemas.AUDIT).option("mode", "DROPMALFORMED").json(list(paths))
    return rows if "day" in rows.columns else rows.withColumn("day", F.lit(None).cast("date"))


def scan_log(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Flat events of a log by day, in an inclusive window of days; other days' files aren't read."""
    return flatten_audit(date_window(_audit(spark, path), start, end, "day"))


def first_day_needed(spark: SparkSession, path: str, n: int, **predicates) -> str | None:
    """The day from which on a log by day has n events that meet the predicates: the newest 1, 2, 4, ... days are tried; None if all days are needed.

    Days are folder names, which the driver lists.
    """
    folders = sorted((d[4:] for d in versions.names_in(spark, path) if d.startswith("day=") and d[4:] != versions.NO_DATE), reverse=True)
    newest = 1
    while newest <= len(folders):
        some = filter_audit(scan_log(spark, path, start=folders[newest - 1]), **predicates)
        if some.limit(n).count() == n:
            return folders[newest - 1]
        newest *= 2
    return None


def newest_events(spark: SparkSession, path: str, n: int = 50, most: int | None = None, **predicates) -> DataFrame:
    """``query_events`` of a log by day, read from its newest days only.

    Events without a day are the oldest. Equal times are in no fixed order, as in
    ``query_events``.
    """
    n = max(1, n if most is None else min(n, most))
    log = scan_log(spark, path, start=first_day_needed(spark, path, n, **predicates))
    return recent_events(filter_audit(log, **predicates).drop("day"), n)


def scan_audit_layers(spark: SparkSession, *paths: str) -> DataFrame:
    """Audit events of several folders, read recursively; ``layer`` is the file's folder."""
    rows = spark.read.schema(schemas.AUDIT).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(list(paths))
    return rows.withColumn("layer", F.element_at(F.split("_metadata.file_path", "/"), -2))


def scan_assessments(spark: SparkSession, path: str) -> DataFrame:
    """Assessment entries, one row each; an empty or broken file gives none."""
    doc = spark.read.option("multiLine", True).schema(schemas.ASSESSMENTS).json(path)
    users = doc.select(F.explode("users").alias("user_id", "u"))
    return users.select(F.col("user_id").try_cast("bigint").alias("user_id"), F.explode("u.entries").alias("e")).select("user_id", "e.date", "e.final_scores.*")
