"""The audit log: filters, traces, denial alerts and access summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceledger.functions import redact as R
from paceledger.functions import scalars as S

DENIED = "denied_by_policy"


def lookback_bound(ts: Column, as_of: Column, lookback_s: int | None = None, since: Column | None = None) -> Column:
    """True for events since the later of (as_of - lookback) and ``since``; a negative lookback counts as 0, a NULL ts passes."""
    bounds = []
    if lookback_s is not None:
        bounds.append(as_of - F.make_interval(secs=F.lit(max(0, lookback_s))))
    if since is not None:
        bounds.append(since)
    if not bounds:
        return F.lit(True)
    low = F.greatest(*bounds) if len(bounds) > 1 else bounds[0]
    return ts.isNull() | low.isNull() | (ts >= low)


def filter_audit(
    events: DataFrame,
    *,
    client_id: str | None = None,
    subject_hash: str | None = None,
    name: str | None = None,
    name_prefix: str | None = None,
    purpose: str | None = None,
    ok: bool | None = None,
    error_code: str | None = None,
) -> DataFrame:
    """Events that meet every predicate given; a missing purpose equals '' and a missing ok false. Needs flat purpose and error_code columns."""
    for column, wanted in (("client_id", client_id), ("subject_hash", subject_hash), ("name", name), ("error_code", error_code)):
        if wanted is not None:
            events = events.where(F.col(column).eqNullSafe(F.lit(wanted)))
    if name_prefix is not None:
        events = events.where(F.col("name").startswith(name_prefix))
    if purpose is not None:
        events = events.where(F.coalesce("purpose", F.lit("")) == purpose)
    if ok is not None:
        events = events.where(F.coalesce("ok", F.lit(False)) == ok)
    return events


def flatten_audit(raw: DataFrame) -> DataFrame:
    """Events as read from the log with ts as a timestamp and flat purpose and error_code."""
    return raw.withColumns({"ts": S.parse_ts(F.col("ts")), "purpose": F.coalesce("purpose", "args.purpose", "args.args.purpose"), "error_code": F.col("args.error.code")})


def find_user(events: DataFrame) -> Column:
    """The first user id among an event's arguments, depth first."""
    found = R.find_first(F.col("args"), events.schema["args"].dataType, "user_id")
    return F.lit(None).cast("string") if found is None else found


def seal(events: DataFrame, salt: str) -> DataFrame:
    """Hash the subject, then mask secrets, then personal keys. The hash must see the id that the masks hide."""
    hashed = events.withColumn("subject_hash", F.coalesce(F.col("subject_hash"), R.subject_hash(find_user(events), salt)))
    return R.redact_pii(R.redact_secrets(hashed))


def attach_corr_id(requests: DataFrame, *key: str) -> DataFrame:
    """A correlation id for requests that have none, made from their key, so reruns agree."""
    made = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in key]), 256)
    return requests.withColumn("corr_id", F.coalesce("corr_id", made))


def recent_events(events: DataFrame, n: int | None = 50, order: str = "ts", most: int | None = None) -> DataFrame:
    """The newest n events, oldest first; n is at least 1 and 50 if not a number, ``most`` caps it if given."""
    n = max(1, n if isinstance(n, int) else 50)
    n = n if most is None else min(n, most)
    return events.orderBy(F.col(order).desc()).limit(n).orderBy(F.col(order).asc())


def query_events(events: DataFrame, n: int = 50, order: str = "ts", **predicates) -> DataFrame:
    return recent_events(filter_audit(events, **predicates), n, order)


def project_trace(events: DataFrame) -> DataFrame:
    """One shape for old and new events: tool, purpose, policy and status from wherever they lie."""
    args = F.col("args")
    return events.select(
        "ts",
        "corr_id",
        "client_id",
        F.coalesce("name", "tool").alias("tool"),
        F.coalesce(F.col("purpose"), args["purpose"], args["args"]["purpose"]).alias("purpose"),
        F.coalesce(F.col("status"), F.when(F.col("ok"), "ok").when(~F.col("ok"), "error")).alias("status"),
        F.coalesce(F.col("policy"), args["policy"]).alias("policy"),
        "ms",
    )


def last_trace_rows(trace: DataFrame, n: int = 12, order: str = "ts") -> DataFrame:
    return trace.orderBy(F.col(order).desc()).limit(n)


def correlate_layers(events: DataFrame, order: str = "ts") -> DataFrame:
    """Events of all layers by corr_id: their number, the layers met and the ordered steps.

    Events without a corr_id belong to no request and correlate with nothing, so they are left out, as by an equi-join;
    ``attach_corr_id`` gives them one.
    """
    step = F.struct(F.col(order).alias("at"), "layer", "name", "ok")
    return events.where("corr_id IS NOT NULL").groupBy("corr_id").agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set("layer")).alias("layers"), F.array_sort(F.collect_list(step)).alias("steps"))


def denial_alerts(events: DataFrame, min_denies: int = 3, code: str = DENIED) -> DataFrame:
    """(client_id, name, n): tools denied to a client at least ``min_denies`` times. Filter by client, purpose and lookback before."""
    return events.where(F.col("error_code") == code).groupBy("client_id", "name").agg(F.count("*").alias("n")).where(F.col("n") >= min_denies)


def alert_order(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.col("n").desc(), "name")


def evidence_per_tool(events: DataFrame, alerts: DataFrame, last: int = 5, order: str = "ts", code: str = DENIED) -> DataFrame:
    """The last few denied events (order column, corr_id) of each alerting client and tool."""
    denied = events.where(F.col("error_code") == code).join(alerts.select("client_id", "name"), ["client_id", "name"], "left_semi")
    newest = Window.partitionBy("client_id", "name").orderBy(F.col(order).desc())
    return denied.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= last).select("client_id", "name", "n", order, "corr_id")


def exclude_introspection(events: DataFrame, prefix: str, introspection: tuple[str, ...]) -> DataFrame:
    """Events of the governed tools (by name prefix) without those that only read the log."""
    return events.where(F.col("name").startswith(prefix) & ~F.col("name").isin(*introspection))


def access_summary(events: DataFrame, order: str = "ts") -> DataFrame:
    """Per tool, purpose and client: calls, successes, errors, the last one, with names for missing keys."""
    keyed = events.select(F.col("name").alias("tool"), F.coalesce(F.nullif("purpose", F.lit("")), F.lit("unknown")).alias("purpose"), F.coalesce("client_id", F.lit("UNKNOWN_CLIENT")).alias("client"), F.coalesce("ok", F.lit(False)).alias("ok"), F.col(order).alias("at"))
    return keyed.groupBy("tool", "purpose", "client").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok_calls"), F.count_if(~F.col("ok")).alias("error_calls"), F.max("at").alias("last_at"))


def error_histogram(events: DataFrame) -> DataFrame:
    """Per tool, purpose and client: a map from error code to its number among failed events."""
    failed = events.where(~F.coalesce("ok", F.lit(False)) & F.col("error_code").isNotNull())
    keyed = failed.select(F.col("name").alias("tool"), F.coalesce(F.nullif("purpose", F.lit("")), F.lit("unknown")).alias("purpose"), F.coalesce("client_id", F.lit("UNKNOWN_CLIENT")).alias("client"), "error_code")
    counts = keyed.groupBy("tool", "purpose", "client", "error_code").agg(F.count("*").alias("n"))
    return counts.groupBy("tool", "purpose", "client").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_code", "n")))).alias("errors"))


def summary_order(summary: DataFrame) -> DataFrame:
    return summary.orderBy("tool", "purpose", "client")


def payload_stats(payloads: DataFrame, most: int = 500) -> DataFrame:
    """Sizes of payload rows (records, attempts arrays, streams map, error): counts, per-stream counts, error code, JSON bytes (NULL above ``most`` rows)."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    streams = F.transform_values("streams", lambda k, v: F.coalesce(F.size(v["records"]), F.lit(0)))
    out = payloads.withColumn("stream_counts", streams)
    total = F.aggregate(F.map_values("stream_counts"), F.lit(0), lambda a, x: a + x)
    small = (n("records") <= most) & (n("attempts") <= most)
    present = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in payloads.columns), F.lit(0))
    return out.select(
        *payloads.columns,
        present.alias("n_keys"),
        F.col("error.code").alias("error_code"),
        n("records").alias("n_records"),
        n("attempts").alias("n_attempts"),
        "stream_counts",
        F.coalesce(total, F.lit(0)).alias("n_stream_records"),
        F.when(small, F.octet_length(F.to_json(F.struct(*payloads.columns)))).alias("json_bytes"),
    )
