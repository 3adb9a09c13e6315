"""The daily activity store: ingest, choice of one row per day, features, windows and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceledger.functions import scalars as S

KEY = ("user_id", "date", "source")


# ---- ingest -------------------------------------------------------------------------------------------------
def property_value(props: Column, key: str, units: tuple[str, ...] | None = None) -> Column:
    """The last value of a property; with ``units``, the last one in a known unit, as (value, unit)."""
    hit = F.filter(props, lambda p: (p["property"]["translationKey"] == key) & (p["property"]["baseUnit"].isin(*units) if units else F.lit(True)))
    return F.try_element_at(hit, F.lit(-1))


def distance_to_meters(value: Column, unit: Column) -> Column:
    v = value.try_cast("double")
    return F.when(unit == "m", v).when(unit == "cm", v / 100).when(unit == "km", v * 1000)


def duration_to_seconds(value: Column, unit: Column) -> Column:
    v = value.try_cast("double")
    return F.when(unit == "s", v).when(unit == "min", v * 60).when(unit == "h", v * 3600)


def pivot_activity_properties(activities: DataFrame) -> DataFrame:
    """Raw activities (user_id, id, date in ms, propertyInstances) as one walk row each, without a shuffle."""
    props = F.col("propertyInstances")
    steps = property_value(props, "STEPS")
    distance, duration = property_value(props, "DISTANCE", ("m", "cm", "km")), property_value(props, "DURATION", ("s", "min", "h"))
    return activities.select(
        "user_id",
        F.col("id").alias("activity_id"),
        S.millis_to_local(F.col("date")).alias("date"),
        steps["value"].try_cast("bigint").alias("steps"),
        distance_to_meters(distance["value"], distance["property"]["baseUnit"]).alias("distance_meters"),
        duration_to_seconds(duration["value"], duration["property"]["baseUnit"]).alias("duration_s"),
        property_value(props, "KCALORIES")["value"].try_cast("double").alias("kcalories"),
    )


def flatten_fit_points(points: DataFrame) -> DataFrame:
    """Fit points (user_id, point array) as one walk row a point."""
    p = points.select("user_id", F.explode("point").alias("p"))
    nanos = lambda c: F.col(c).try_cast("decimal(38,0)")
    seconds = ((nanos("p.endTimeNanos") - nanos("p.startTimeNanos")) / 1_000_000_000).cast("double")
    first = F.try_element_at(F.filter("p.value", lambda v: v["intVal"].isNotNull()), F.lit(1))["intVal"]
    return p.select("user_id", S.nanos_to_local(F.col("p.startTimeNanos")).alias("date"), first.alias("steps"), F.when(seconds > 0, seconds).alias("duration_s"))


def violations(date: Column, steps: Column, floats: dict[str, Column], duration: Column) -> Column:
    """Messages of the rules a record breaks; an empty array if none."""
    n = steps.try_cast("bigint")
    rules = [
        (date.isNull() | (F.trim(date) == ""), "date is required"),
        (date.isNotNull() & S.strict_iso(date).isNull(), "date must be ISO without offset"),
        (steps.isNotNull() & n.isNull(), "steps must be a whole number"),
        (n < 0, "steps must not be negative"),
        *[(c.isNotNull() & c.try_cast("double").isNull(), f"{name} must be a number") for name, c in floats.items()],
        (duration.isNotNull() & ~duration.rlike("^\\d{2}:\\d{2}:\\d{2}$"), "duration must be HH:MM:SS"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for bad, message in rules]))


def validate_records(records: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) of text records (date, steps, distance_meters, kcalories, duration); strict raises on the first bad one."""
    marked = records.withColumn("violations", violations(F.col("date"), F.col("steps"), {c: F.col(c) for c in ("distance_meters", "kcalories")}, F.col("duration")))
    if strict:
        marked = marked.withColumn("violations", F.when(F.size("violations") > 0, F.raise_error(F.array_join("violations", "; ")).cast("array<string>")).otherwise(F.col("violations")))
    typed = marked.where(F.size("violations") == 0).withColumn("steps", F.coalesce(F.col("steps").try_cast("bigint"), F.lit(0).cast("bigint")))
    typed = typed.withColumn("date", S.strict_iso(F.col("date"))).withColumns({c: F.col(c).try_cast("double") for c in ("distance_meters", "kcalories")})
    return typed.drop("violations"), marked.where(F.size("violations") > 0)


def _first_filled(df: DataFrame, names: tuple[str, ...], kind: str) -> Column:
    """The first of alternative columns that is neither NULL, zero nor blank."""
    have = [F.col(n) for n in names if n in df.columns]
    if kind == "string":
        return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in have], F.lit(None).cast("string"))
    zero = F.lit(0).cast(kind)
    return F.coalesce(*[F.nullif(c.try_cast(kind), zero) for c in have], zero)


def normalize_ingest(records: DataFrame, source: str | Column, inserted_at: int | Column) -> DataFrame:
    """Loose records (user_id and alternative names) as daily rows; undated rows go, the original row stays as JSON."""
    src = F.lower(F.trim(F.lit(source) if isinstance(source, str) else source))
    times = ("duration_s", "duration", "duration_seconds")
    raw = records.withColumns({"_raw": F.to_json(F.struct("*")), "_src": src})
    raw = raw.withColumns({c: S.hms_to_seconds(F.col(c).cast("string")) for c in times if c in records.columns})
    out = raw.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        S.norm_date(_first_filled(raw, ("date", "day", "timestamp"), "string")).try_cast("date").alias("date"),
        F.coalesce(F.nullif("_src", F.lit("")), F.lit("unknown")).alias("source"),
        _first_filled(raw, ("steps", "step_count"), "bigint").alias("steps"),
        _first_filled(raw, ("distance_meters", "distance"), "double").alias("distance_meters"),
        _first_filled(raw, times, "double").alias("duration_s"),
        _first_filled(raw, ("kcalories", "calories"), "double").alias("kcalories"),
        F.col("_raw").alias("raw_json"),
        (F.lit(inserted_at) if isinstance(inserted_at, int) else inserted_at).cast("bigint").alias("inserted_at"),
    )
    return out.where("date IS NOT NULL")


def last_write_wins(rows: DataFrame, keys: tuple[str, ...] = KEY, order: tuple[str, ...] = ("inserted_at", "seq")) -> DataFrame:
    """Of rows with one key the last one by ``order``."""
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def sum_per_key(rows: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The other reading of several rows of one key: their measures add up."""
    measures = [F.sum(c).alias(c) for c in ("steps", "distance_meters", "duration_s", "kcalories") if c in rows.columns]
    return rows.groupBy(*keys).agg(*measures, F.max("inserted_at").alias("inserted_at"))


def upsert_daily(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after incoming rows replace those with their key; ``incoming`` may have seq, the order inside the batch."""
    old = existing.withColumn("_new", F.lit(0)).withColumn("seq", F.lit(-1).cast("bigint"))
    new = incoming.withColumn("_new", F.lit(1))
    new = new if "seq" in incoming.columns else new.withColumn("seq", F.lit(0).cast("bigint"))
    both = old.unionByName(new, allowMissingColumns=True)
    return last_write_wins(both, order=("_new", "inserted_at", "seq")).select(*existing.columns)


def retain_daily(rows: DataFrame, as_of: int, days: int = 60) -> tuple[DataFrame, DataFrame]:
    """(rows inserted within ``days`` days before as_of, counts of kept and deleted) in one pass each."""
    cutoff = as_of - days * 86400
    counts = rows.agg(F.count_if(F.col("inserted_at") >= cutoff).alias("kept"), F.count_if(F.col("inserted_at") < cutoff).alias("deleted"))
    return rows.where(F.col("inserted_at") >= cutoff), counts


def retention_by_date(rows: DataFrame, as_of: int, days: int = 60) -> DataFrame:
    """(date, n_rows, kept, deleted): what the retention does to each date, from one scan of two columns."""
    cutoff = as_of - days * 86400
    return rows.groupBy("date").agg(F.count("*").alias("n_rows"), F.count_if(F.col("inserted_at") >= cutoff).alias("kept"), F.count_if(F.col("inserted_at") < cutoff).alias("deleted"))


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ---- reading ------------------------------------------------------------------------------------------------
def date_window(rows: DataFrame, start=None, end=None, column: str = "date") -> DataFrame:
    """Inclusive bounds; undated rows go once a bound is given."""
    if start is not None:
        rows = rows.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col(column) <= F.lit(end).cast("date"))
    return rows


def preferred_per_day(rows: DataFrame, prefer: str | Column) -> DataFrame:
    """One row per user and day: the preferred source, else the newest insert, ties by source."""
    wanted = F.lit(prefer) if isinstance(prefer, str) else prefer
    best = Window.partitionBy("user_id", "date").orderBy(F.when(F.col("source") == wanted, 0).otherwise(1), F.col("inserted_at").desc(), "source")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def preferred_in_row(rows: Column, prefer: Column) -> Column:
    """``preferred_per_day`` inside a row: of an array of (date, origin, inserted_at, ...) one element per date, by date."""
    other = lambda r: F.when(r["origin"] == prefer, 0).otherwise(1)
    ranked = F.array_sort(F.transform(rows, lambda r: F.struct(r["date"].alias("date"), other(r).alias("other"), (-r["inserted_at"]).alias("age"), r["origin"].alias("origin"), r.alias("row"))))
    first = F.filter(ranked, lambda r, i: (i == 0) | ~r["date"].eqNullSafe(F.get(ranked, i - 1)["date"]))
    return F.transform(first, lambda r: r["row"])


def daily_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.count("*").alias("days"), F.coalesce(F.sum("steps"), F.lit(0)).alias("total_steps"), F.coalesce(F.avg("steps"), F.lit(0.0)).alias("avg_steps"))


def store_sources(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def walk_features(rows: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Per user: records with whole steps, their total, truncated mean, least and greatest; users without any, and ``users`` besides, get zeros and NULLs."""
    n = F.col("steps").try_cast("bigint")
    out = rows.groupBy("user_id").agg(F.count(n).alias("days"), F.coalesce(F.sum(n), F.lit(0)).alias("total_steps"), F.min(n).alias("min_steps"), F.max(n).alias("max_steps"))
    if users is not None:
        out = users.select("user_id").distinct().join(out, "user_id", "left").fillna(0, ["days", "total_steps"])
    mean = F.when(F.col("days") > 0, (F.col("total_steps") / F.col("days")).cast("bigint")).otherwise(0).cast("bigint")
    return out.select("user_id", "days", "total_steps", mean.alias("avg_steps"), "min_steps", "max_steps")


def trailing_avg_steps(rows: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Mean steps from ``days`` days up to as_of on, rounded half to even; missing steps count as 0, bad dates and steps don't count."""
    date = F.col("date").cast("string").try_cast("date")
    raw = F.col("steps").cast("string")
    n = F.when(raw.isNull() | (raw == ""), 0).otherwise(raw.try_cast("bigint"))
    recent = rows.where((date >= F.date_sub(F.lit(as_of).cast("date"), days - 1)) & n.isNotNull())
    return recent.groupBy("user_id").agg(F.bround(F.avg(n)).cast("bigint").alias("avg_steps"), F.count("*").alias("n_records"))


def page_per_user(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """LIMIT and OFFSET inside each user's rows by date; negatives count as 0."""
    offset = max(0, offset)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("date", "source"))
    out = rows.withColumn("_n", n).where(F.col("_n") > offset)
    return (out if limit is None else out.where(F.col("_n") <= offset + max(0, limit))).drop("_n")


def page(rows: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    out = rows.orderBy(*order).offset(max(0, offset))
    return out if limit is None else out.limit(max(0, limit))


def date_order(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows by date, those of one date by ``ties``."""
    return rows.orderBy("date", *ties)


# ---- what is stored -----------------------------------------------------------------------------------------
def observed_fields(records: DataFrame, raw: str = "raw_json", most: int = 12) -> DataFrame:
    """Per domain, the first ``most`` names of fields seen in the JSON records."""
    keys = records.select("domain", F.explode(F.json_object_keys(raw)).alias("k"))
    return keys.groupBy("domain").agg(F.slice(F.array_sort(F.collect_set("k")), 1, most).alias("fields"))


def inventory(records: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Per domain: number of records, first and last date, observed fields."""
    counts = records.groupBy("domain").agg(F.count("*").alias("n_records"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return counts.join(observed_fields(records, raw), "domain", "left")


def extract_records(payload: Column, streams: Column) -> Column:
    """A payload's records, else those of the first stream that has some."""
    with_records = F.filter(F.map_values(streams), lambda s: s["records"].isNotNull())
    return F.coalesce(payload, F.get(with_records, F.lit(0))["records"])
