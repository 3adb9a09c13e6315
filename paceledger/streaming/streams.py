"""Structured Streaming forms of the audit and store operators, over the same Column builders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from paceledger import schemas
from paceledger.operators import audit, store
from paceledger.session import shared_dir, ship_package

LATE = "10 minutes"
#: State of its own per key needs the store that keeps it on disk.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_audit(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The append-only log as a stream, flat and with a timestamp."""
    reader = spark.readStream.schema(schemas.AUDIT).option("mode", "DROPMALFORMED")
    return audit.flatten_audit((reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).json(path))


def timed(events: DataFrame, late: str = LATE) -> DataFrame:
    """ts as TIMESTAMP with a watermark; later events than that are dropped by the windows below. ``route_late`` keeps them."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def stream_denials(events: DataFrame, min_denies: int = 3, window: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Windows in which a tool was denied to a client ``min_denies`` times or more.

    In update mode an alert comes in the micro-batch that reaches the threshold,
    and again whenever its count grows; ``merged`` keeps each alert's last state.
    """
    denied = timed(events).where(F.col("error_code") == audit.DENIED)
    counts = denied.groupBy(F.window("ts", window, slide).alias("w"), "client_id", "name").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_denies).select(F.unix_micros("w.start").alias("window_start"), "client_id", "name", "n")


def stream_access_counts(events: DataFrame, window: str = "1 hour") -> DataFrame:
    counts = timed(events).groupBy(F.window("ts", window).alias("w"), "name", "client_id").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok_calls"))
    return counts.select(F.unix_micros("w.start").alias("window_start"), "name", "client_id", "calls", "ok_calls")


def stream_trace_sessions(events: DataFrame, gap: str = "30 seconds") -> DataFrame:
    counts = timed(events).groupBy(F.session_window("ts", gap).alias("w"), "corr_id").agg(F.count("*").alias("n_events"))
    return counts.select(F.unix_micros("w.start").alias("session_start"), "corr_id", "n_events")


def stream_dedup(rows: DataFrame, *keys: str, late: str = "1 day") -> DataFrame:
    return timed(rows, late).dropDuplicatesWithinWatermark(list(keys))


def stream_redact(events: DataFrame, salt: str) -> DataFrame:
    return audit.seal(events, salt)


# ---- two layers -----------------------------------------------------------------------------------------------
def stream_correlate(gateway: DataFrame, sources: DataFrame, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """Events of two layers with one corr_id at most ``within`` apart: (corr_id, gateway, sources), structs of the rows.

    An outer join: an event whose other layer never comes has NULL there, and
    comes out once the watermark has passed the time in which it could have come.
    Both layers' state ends there too, so it is bounded by ``within`` and ``late``.
    Events without a corr_id belong to no request and aren't reported.
    """
    span = F.expr(f"INTERVAL {within}")

    def side(events: DataFrame, prefix: str) -> DataFrame:
        events = timed(events.where("corr_id IS NOT NULL"), late)
        return events.select(F.col("corr_id").alias(f"{prefix}_corr"), F.col("ts").alias(f"{prefix}_ts"), F.struct(*[c for c in events.columns if c != "corr_id"]).alias(prefix))

    left, right = side(gateway, "gateway"), side(sources, "sources")
    near = (F.col("sources_ts") >= F.col("gateway_ts") - span) & (F.col("sources_ts") <= F.col("gateway_ts") + span)
    both = left.join(right, (F.col("gateway_corr") == F.col("sources_corr")) & near, "full_outer")
    return both.select(F.coalesce("gateway_corr", "sources_corr").alias("corr_id"), "gateway", "sources")


# ---- the newest value of each key -----------------------------------------------------------------------------
#: Keys share so many groups of state, so that what each group costs a micro-batch (frames to and from Python, timers) is paid by
#: many keys. A checkpoint holds for one number.
GROUPS = 1024


class Newest(StatefulProcessor):
    """Keeps the newest (time, value) of each key of a group, until the watermark is ``ttl_ms`` past its last change, and emits a row for each change and one when it ends.

    A group has one timer, no later than the first end among its keys.
    """

    def __init__(self, kinds: T.StructType, ttl_ms: int) -> None:
        self.kinds, self.ttl_ms = kinds, ttl_ms
        self.key, self.value = kinds.names
        self.whole = isinstance(kinds[self.value].dataType, T.IntegralType)

    def init(self, handle) -> None:
        self.handle = handle
        state = T.StructType([T.StructField("at", T.LongType()), T.StructField("value", self.kinds[self.value].dataType), T.StructField("changes", T.LongType())])
        self.newest = handle.getMapState("newest", T.StructType([self.kinds[self.key]]), state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best: dict = {}
        for part in rows:
            top = part.sort_values(["event_us", self.value], na_position="first").drop_duplicates(self.key, keep="last")
            for k, at, value in zip(top[self.key].tolist(), top["event_us"].tolist(), top[self.value].tolist()):
                found = (at, None if pd.isna(value) else int(value) if self.whole else value)
                best[k] = max(best.get(k, found), found, key=_rank)
        changed = []
        for k, found in best.items():
            had = self.newest.getValue((k,))
            if had is None or _rank(found) > _rank((had[0], had[1])):
                changes = 1 + (had[2] if had is not None else 0)
                self.newest.updateValue((k,), (*found, changes))
                changed.append((k, *found, changes))
        if changed:
            self._wake(min(self._end(at) for _, at, _, _ in changed))
            yield self._rows(changed, "changed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, ended, first = timerValues.getCurrentWatermarkInMs(), [], None
        for (k,), (at, value, changes) in self.newest.iterator():
            end = self._end(at)
            if end <= now:
                ended.append((k, at, value, changes))
            elif first is None or end < first:
                first = end
        for k, *_ in ended:
            self.newest.removeKey((k,))
        if first is not None:
            self.handle.registerTimer(first)
        if ended:
            yield self._rows(ended, "expired")

    def close(self) -> None:
        pass

    def _end(self, at: int) -> int:
        return at // 1000 + self.ttl_ms

    def _wake(self, at: int) -> None:
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def _rows(self, found: list[tuple], event: str) -> pd.DataFrame:
        keys, at, values, changes = zip(*found)
        return pd.DataFrame({self.key: keys, f"latest_{self.value}": pd.Series(values, dtype=object if self.whole else None), "latest_at": at, "changes": changes, "event": event})


def _rank(pair: tuple) -> tuple:
    return (pair[0], pair[1] is not None, pair[1] if pair[1] is not None else 0)


def stream_latest(rows: DataFrame, key: str, ts: str, value: str, ttl: int = 30 * 86400, late: str = "1 day") -> DataFrame:
    """The value with the newest ``ts`` of each key: (key, latest value, latest_at in microseconds, changes, event).

    One row per change, in update mode, and none for rows that are older than
    what is known. A key's state ends once the watermark is ``ttl`` seconds past
    its last change, with a row whose event is ``expired``; if the key comes again
    it starts anew. So the state is bounded by the keys seen within that time.
    Rows without a key or time are left out, equal times go by value.
    """
    spark = rows.sparkSession
    ship_package(spark)
    spark.conf.set(*STATE_STORE)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out = T.StructType([T.StructField(key, kinds[key]), T.StructField(f"latest_{value}", kinds[value]), T.StructField("latest_at", T.LongType()), T.StructField("changes", T.LongType()), T.StructField("event", T.StringType())])
    known = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    known = known.select(F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("_group"), key, ts, F.unix_micros(ts).alias("event_us"), value)
    held = T.StructType([T.StructField(key, kinds[key]), T.StructField(value, kinds[value])])
    return known.groupBy("_group").transformWithStateInPandas(statefulProcessor=Newest(held, 1000 * ttl), outputStructType=out, outputMode="Update", timeMode="EventTime")


# ---- sinks ----------------------------------------------------------------------------------------------------
def stream_upsert_daily(rows: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch through to the store. Batches replace by key with seq inside the batch, so a replay changes nothing."""
    from paceledger.sources import writers

    def write(batch: DataFrame, batch_id: int) -> None:
        last = store.last_write_wins(batch, order=("inserted_at", "seq") if "seq" in batch.columns else ("inserted_at",))
        writers.upsert_daily(batch.sparkSession, path, last)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def write_changes(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """A writer of what each micro-batch emits, one folder a batch: a batch that is repeated replaces its own folder and nothing else."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def read_changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that ``write_changes`` wrote, with their ``batch``; none where no batch has been."""
    empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return empty
    return spark.read.schema(empty.schema).parquet(path)


def merged(changes: DataFrame, *keys: str, order: str = "batch") -> DataFrame:
    """The last state of each key among changes."""
    rest = [c for c in changes.columns if c not in (*keys, order)]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def route_late(rows: DataFrame, path: str, checkpoint: str, late_s: int = 600, ts: str = "ts"):
    """A writer that sends every row to ``path`` as on time or late, one folder a micro-batch; ``read_routed`` reads both.

    A row is late if its time lies more than ``late_s`` seconds before the newest
    of all earlier micro-batches, which is Spark's own watermark for it: a stateful
    operator would drop it without a count. Rows without a time are late. Each
    batch leaves the newest time so far beside its rows, so a batch that is
    repeated finds the same watermark and replaces its own rows only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = F.lit(None).cast("timestamp")
        if batch_id:
            newest = F.lit(spark.read.schema("newest timestamp").parquet(f"{path}/newest/batch={batch_id - 1}").first()[0])
        marked = batch.withColumn("late", is_late(F.col(ts).cast("timestamp"), newest, late_s))
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={batch_id}")
        written = spark.read.schema(marked.schema).parquet(f"{path}/rows/batch={batch_id}")
        written.agg(F.greatest(F.max(F.col(ts).cast("timestamp")), newest).alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def is_late(ts: Column, newest: Column, late_s: int) -> Column:
    return ts.isNull() | F.coalesce(ts < newest - F.make_interval(secs=F.lit(late_s)), F.lit(False))


def read_routed(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows on time, late rows), each with the ``batch`` that brought it."""
    kinds = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("late", T.BooleanType())])
    rows = spark.read.schema(kinds).parquet(f"{path}/rows")
    return rows.where("NOT late").drop("late"), rows.where("late").drop("late")


def late_counts(on_time: DataFrame, late: DataFrame) -> DataFrame:
    """(batch, on_time, late): how many rows of each micro-batch went where."""
    both = on_time.select("batch", F.lit(0).alias("late")).unionByName(late.select("batch", F.lit(1).alias("late")))
    return both.groupBy("batch").agg(F.count_if(F.col("late") == 0).alias("on_time"), F.count_if(F.col("late") == 1).alias("late"))


def folders(spark: SparkSession) -> str:
    """A new folder in the shared storage, for a stream's output and checkpoint."""
    return f"{shared_dir(spark)}/paceledger_{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote.

    Executors write the rows to Parquet in the shared folder: append mode by the
    file sink, update mode as one folder a micro-batch, whose number is the column
    ``batch``, complete mode as one table that each micro-batch replaces. In append mode windows and sessions come out once the watermark has
    passed their end, so those that are still open at the end of the data stay in
    the state; in update mode they come out as they are.
    """
    spark, path = stream.sparkSession, folders(stream.sparkSession)
    if mode == "append":
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    if mode == "complete":
        # a source without data makes no micro-batch
        spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows")
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows")).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    write_changes(stream, f"{path}/rows", f"{path}/checkpoint", mode).start().awaitTermination()
    return read_changes(spark, f"{path}/rows", stream.schema)


#: A landed file has about so many rows at least, where there is more than one.
FILE_ROWS = 1_000_000


def land(rows: DataFrame, parts: list[Column], path: str) -> int:
    """Land the rows of each condition at ``path``, one after another, in equally many files; returns how many, for a stream that reads one condition a batch.

    Small tables make one file a condition; of larger ones each task writes its
    own, and a condition that has rows in fewer tasks is filled up with empty files.
    """
    spark, files = rows.sparkSession, 1 + rows.count() // FILE_ROWS
    if files > 1:
        files = min(files, rows.rdd.getNumPartitions())
    for n, part in enumerate(parts, 1):
        rows.where(part).coalesce(files).write.mode("append").parquet(path)
        if files > 1:
            for _ in range(n * files - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
                spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return files
