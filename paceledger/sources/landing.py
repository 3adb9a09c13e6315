"""Incremental landing of raw JSON dumps: each file is read once, broken lines are kept as text, rows lie by day and descriptor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceledger import schemas
from paceledger.operators.store import date_window
from paceledger.sources import versions

CORRUPT = "_corrupt"
BROKEN = "batch BIGINT, file STRING, line STRING, reason STRING"


def activity_day() -> Column:
    return F.to_date(F.timestamp_millis("date"))


def point_day() -> Column:
    """The day of a record's first fit point."""
    return F.to_date(F.timestamp_micros(F.floor(F.col("point")[0]["startTimeNanos"].try_cast("decimal(38,0)") / 1000).cast("bigint")))


def parse_lines(lines: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """Lines of JSON as rows of ``schema``, with ``_corrupt``: the line's text where it isn't JSON of that schema, else NULL. Blank lines go."""
    parsed = F.from_json(text, f"{schema}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT})
    others = [c for c in lines.columns if c != text]
    return lines.where(F.trim(text, F.lit(" \t\r")) != "").withColumn("_p", parsed).select(*others, "_p.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines (file, line)) of a dump; one read each, both lazy."""
    rows = parse_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")), schema)
    return rows.where(f"{CORRUPT} IS NULL").drop(CORRUPT, "file"), rows.where(f"{CORRUPT} IS NOT NULL").select("file", F.col(CORRUPT).alias("line"))


def land(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str = schemas.ACTIVITIES, day: Column | None = None, files_per_batch: int | None = None, then=None):
    """A writer that takes the files of ``folder`` that it hasn't met to ``out``.

    Rows go to ``out/rows`` by batch, day and (where they have one) descriptor,
    broken lines with their file and text to ``out/broken`` by batch. The
    checkpoint knows the files, so each is read once over all runs, and a batch
    that is repeated replaces its own folders. ``then(rows, batch_id)`` may take
    the rows further; what it returns, rows with their ``reason``, joins the broken.
    """
    reader = spark.readStream if files_per_batch is None else spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    stream = parse_lines(lines, schema).withColumn("day", activity_day() if day is None else day)
    by = ["day", *(["descriptor"] if "descriptor" in stream.columns else [])]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the files are parsed once for rows and broken lines
        try:
            good, bad = batch.where(f"{CORRUPT} IS NULL").drop(CORRUPT), batch.where(f"{CORRUPT} IS NOT NULL")
            good.write.mode("overwrite").partitionBy(*by).parquet(f"{out}/rows/batch={batch_id}")
            refused = bad.select("file", F.col(CORRUPT).alias("line"), F.lit("not JSON of the schema").alias("reason"))
            more = None if then is None else then(good.drop("day"), batch_id)
            if more is not None:
                refused = refused.unionByName(more.select("file", "line", "reason"))
            refused.write.mode("overwrite").parquet(f"{out}/broken/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def scan_landed(spark: SparkSession, out: str, schema: str = schemas.ACTIVITIES, start=None, end=None, descriptor: str | None = None) -> DataFrame:
    """Landed rows in an inclusive window of days, of one descriptor if given; other folders aren't read."""
    if not versions.names_in(spark, f"{out}/rows"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch BIGINT, day DATE").option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    if descriptor is not None:
        rows = rows.where(F.col("descriptor") == descriptor)
    return date_window(rows, start, end, "day").drop("batch", "day")


def broken(spark: SparkSession, out: str) -> DataFrame:
    """(batch, file, line, reason) of all that was refused."""
    if not versions.names_in(spark, f"{out}/broken"):
        return spark.createDataFrame([], BROKEN)
    return spark.read.schema(BROKEN).option("basePath", f"{out}/broken").parquet(f"{out}/broken").select("batch", "file", "line", "reason")
