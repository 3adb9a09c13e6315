import datetime as dt
import json
from zoneinfo import ZoneInfo

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paceledger.functions import scalars as S
from paceledger.operators import store
from paceledger.plans import jobs
from paceledger.sources import landing, readers, versions, writers
from tests.test_policy_audit import folder_filters

DAY = dt.date.fromisoformat


def files_of(folder, day):
    """Data files of a day, in whatever version of the store."""
    return {p.name for p in folder.glob(f"data/version=*/date={day}/*.parquet")}


def daily(spark, rows):
    full = [(u, d and DAY(d), s, n, 0.0, 0.0, 0.0, None, t) for u, d, s, n, t in rows]
    return spark.createDataFrame(full, "user_id bigint, date date, source string, steps bigint, distance_meters double, duration_s double, kcalories double, raw_json string, inserted_at bigint")


@pytest.fixture
def rows(spark):
    return daily(spark, [(1, "2025-01-01", "arena", 100, 1), (1, "2025-01-01", "stepcloud", 999, 1), (1, "2025-01-02", "stepcloud", 200, 1)])


def test_preferred_and_stats(rows):
    best = store.preferred_per_day(rows, "arena")
    assert [(r.steps, r.source) for r in best.orderBy("date").collect()] == [(100, "arena"), (200, "stepcloud")]
    stats = store.daily_stats(best).first()
    assert (stats.days, stats.total_steps, stats.avg_steps) == (2, 300, 150.0)
    assert store.store_sources(rows).first().sources == ["arena", "stepcloud"]


def test_ties_go_by_source(spark):
    tied = daily(spark, [(1, "2025-01-01", "b", 2, 5), (1, "2025-01-01", "a", 1, 5)])
    assert store.preferred_per_day(tied, "zzz").first().source == "a"


def test_paging(spark):
    rows = daily(spark, [(1, f"2025-01-0{i}", "a", 10 * i, i) for i in (1, 2, 3)])
    assert [r.steps for r in store.page_per_user(rows, 1, 1).collect()] == [20]
    assert store.page_per_user(rows, -1, -5).count() == 0
    assert store.page(rows, [F.col("date")], None, 2).first().steps == 30


def test_features(spark):
    rows = spark.createDataFrame([(1, "100"), (1, "200"), (1, "300"), (2, None), (2, "bad")], "user_id bigint, steps string")
    got = {r.user_id: tuple(r)[1:] for r in store.walk_features(rows, rows).collect()}
    assert got == {1: (3, 600, 200, 100, 300), 2: (0, 0, 0, None, None)}


def test_trailing_average_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(1, "2025-01-09", "1000"), (1, "2025-01-08", "3000"), (1, "2024-12-11", "8000"), (1, "bad-date", "9999"), (1, "2025-01-10", "500"), (2, "2025-01-10", "2"), (2, "2025-01-09", "3")], "user_id bigint, date string, steps string")
    got = {r.user_id: r.avg_steps for r in store.trailing_avg_steps(rows, "2025-01-10").collect()}
    assert got == {1: 1500, 2: 2}


def test_retention(spark):
    rows = daily(spark, [(1, "2025-01-01", "a", 1, 0), (1, "2025-01-02", "a", 1, 200 * 86400)])
    kept, counts = store.retain_daily(rows, 200 * 86400, 1)
    assert kept.count() == 1 and tuple(counts.first()) == (1, 1)


def test_upsert_rewrites_touched_dates_only(spark, rows, tmp_path):
    path = str(tmp_path / "daily")
    writers.write_daily(rows, path)
    before = files_of(tmp_path / "daily", "2025-01-02")
    incoming = daily(spark, [(1, "2025-01-01", "arena", 111, 2), (1, "2025-01-01", "arena", 112, 2), (2, "2025-01-03", "arena", 7, 2)]).withColumn("seq", F.monotonically_increasing_id())
    writers.upsert_daily(spark, path, incoming)
    got = sorted((r.user_id, str(r.date), r.source, r.steps) for r in readers.scan_daily(spark, path).collect())
    assert got == [(1, "2025-01-01", "arena", 112), (1, "2025-01-01", "stepcloud", 999), (1, "2025-01-02", "stepcloud", 200), (2, "2025-01-03", "arena", 7)]
    assert files_of(tmp_path / "daily", "2025-01-02") == before


def test_upsert_keeps_rows_without_date(spark, tmp_path):
    path = str(tmp_path / "daily")
    writers.write_daily(daily(spark, [(1, None, "a", 1, 0), (2, "2025-01-01", "a", 2, 0)]), path)
    writers.upsert_daily(spark, path, daily(spark, [(3, None, "a", 3, 1), (2, "2025-01-01", "a", 5, 1)]))
    assert sorted((r.user_id, r.steps) for r in readers.scan_daily(spark, path).collect()) == [(1, 1), (2, 5), (3, 3)]


def test_retention_rewrites_touched_dates_only(spark, tmp_path):
    path = str(tmp_path / "daily")
    new = 200 * 86400
    writers.write_daily(daily(spark, [(1, "2025-01-01", "a", 1, 0), (1, "2025-01-02", "a", 2, 0), (2, "2025-01-02", "a", 3, new), (1, "2025-01-03", "a", 4, new), (1, None, "a", 5, 0)]), path)
    before = files_of(tmp_path / "daily", "2025-01-03")
    assert tuple(writers.retain_daily(spark, path, new, 1).first()) == (2, 3)
    assert sorted((r.user_id, str(r.date), r.steps) for r in readers.scan_daily(spark, path).collect()) == [(1, "2025-01-03", 4), (2, "2025-01-02", 3)]
    assert sorted((str(r.date), r.version) for r in versions.days(spark, path, versions.current(spark, path)).collect()) == [("2025-01-02", 2), ("2025-01-03", 1)]
    assert files_of(tmp_path / "daily", "2025-01-03") == before
    versions.clear(spark, path, keep=1)
    assert not files_of(tmp_path / "daily", "2025-01-01") and readers.scan_daily(spark, path).count() == 2


def test_large_date_is_split(spark, tmp_path):
    rows = spark.range(0, 200000, 1, 8).select(F.col("id").alias("user_id"), F.lit("2025-01-01").cast("date").alias("date"), F.sha2(F.col("id").cast("string"), 256).alias("source"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "1m")
    try:
        writers.write_daily(rows, str(tmp_path / "daily"))
    finally:
        spark.conf.set(size, before)
    assert len(files_of(tmp_path / "daily", "2025-01-01")) > 1
    assert readers.scan_daily(spark, str(tmp_path / "daily")).count() == 200000


def test_readers_see_before_or_after_a_write(spark, tmp_path):
    """A read that has begun keeps its rows through an upsert; a write that is killed before its switch leaves the store as it was."""
    path = str(tmp_path / "daily")
    writers.write_daily(daily(spark, [(1, "2025-01-01", "a", 1, 0), (1, "2025-01-02", "a", 2, 0)]), path)
    begun = readers.scan_daily(spark, path)
    writers.upsert_daily(spark, path, daily(spark, [(1, "2025-01-01", "a", 11, 1), (1, "2025-01-03", "a", 3, 1)]))
    steps = lambda df: sorted((str(r.date), r.steps) for r in df.collect())
    assert steps(begun) == [("2025-01-01", 1), ("2025-01-02", 2)]
    after = [("2025-01-01", 11), ("2025-01-02", 2), ("2025-01-03", 3)]
    assert steps(readers.scan_daily(spark, path)) == after

    def killed(rows, folder):
        writers._write(rows, folder)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        versions.publish(daily(spark, [(1, "2025-01-02", "a", 99, 2)]), path, killed, versions.days(spark, path, 2))
    assert steps(readers.scan_daily(spark, path)) == after and versions.numbers(spark, path) == [1, 2]
    # a list without its commit isn't a version either
    (tmp_path / "daily" / "versions" / "v=3").mkdir()
    assert versions.current(spark, path) == 2
    writers.upsert_daily(spark, path, daily(spark, [(2, "2025-01-02", "a", 5, 3)]))
    assert steps(readers.scan_daily(spark, path)) == [after[0], after[1], ("2025-01-02", 5), after[2]]
    versions.clear(spark, path, keep=1)
    assert len(versions.numbers(spark, path)) == 1 and readers.scan_daily(spark, path).count() == 4
    window = readers.scan_daily(spark, path, "2025-01-02", "2025-01-02")
    assert all("date=2025-01-02" in f for f in window.inputFiles()) and window.count() == 2
    assert readers.scan_daily(spark, path, "2030-01-01").count() == 0 and readers.scan_daily(spark, str(tmp_path / "none")).count() == 0


def test_landing_reads_each_file_once(spark, tmp_path):
    """Two runs over a folder: broken lines are kept with their text, a window reads its own days, rows that break a rule stay out of the store."""
    drop, out, state, path = (str(tmp_path / n) for n in ("drop", "landed", "state", "daily"))
    (tmp_path / "drop").mkdir()
    ms = lambda day: int(dt.datetime(2025, 1, day, 12, tzinfo=dt.UTC).timestamp() * 1000)
    line = lambda i, day, steps: json.dumps({"id": i, "date": ms(day), "user_id": i % 2, "descriptor": "walk" if i % 2 else "run", "propertyInstances": [{"property": {"translationKey": "STEPS", "baseUnit": None}, "value": str(steps)}]})
    (tmp_path / "drop" / "a.json").write_text("\n".join([line(1, 1, 10), line(2, 2, 20), line(3, 3, -5), '{"id": 4, "date": 17', "", "not json"]))
    for k in range(2):
        jobs.ingest_new(spark, drop, out, state, "Arena", 7, path)
        assert landing.scan_landed(spark, out).count() == 3 + k
        (tmp_path / "drop" / "b.json").write_text(line(5, 2, 50))
    refused = {(r.line if "propertyInstances" not in r.line else json.loads(r.line)["id"], r.reason) for r in landing.broken(spark, out).collect()}
    assert refused == {('{"id": 4, "date": 17', "not JSON of the schema"), ("not json", "not JSON of the schema"), (3, "steps must not be negative")}
    assert sorted((r.user_id, str(r.date), r.steps) for r in readers.scan_daily(spark, path).collect()) == [(0, "2025-01-02", 20), (1, "2025-01-01", 10), (1, "2025-01-02", 50)]
    window = landing.scan_landed(spark, out, start="2025-01-02", end="2025-01-02", descriptor="walk")
    assert [r.id for r in window.collect()] == [5] and all(c in folder_filters(window) for c in ("day", "descriptor"))
    rows, bad = landing.read_lines(spark, drop, "id BIGINT, date BIGINT")
    assert rows.count() == 4 and {r.line for r in bad.collect()} == {"not json", '{"id": 4, "date": 17'}
    assert landing.broken(spark, str(tmp_path / "none")).count() == 0 and landing.scan_landed(spark, str(tmp_path / "none")).count() == 0


def test_local_times_of_both_transitions(spark):
    """Against the zone rules of the standard library: every ten minutes of the days on which the clocks change."""
    zone = ZoneInfo(S.ZONE)
    texts = [f"{day}T{h:02d}:{m:02d}:00" for day in ("2024-03-31", "2024-10-27", "2024-07-01") for h in range(24) for m in range(0, 60, 10)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", S.loose_ts(F.col("t"), S.ZONE).alias("a"), S.loose_ts(F.col("t"), S.ZONE, later=True).alias("b"), S.local_times(S.parse_ts(F.col("t")), S.ZONE)["kind"].alias("kind"))
    for r in got.select("t", F.unix_micros("a").alias("a"), F.unix_micros("b").alias("b"), "kind").collect():
        naive = dt.datetime.fromisoformat(r.t)
        first, second = (naive.replace(tzinfo=zone, fold=f).timestamp() for f in (0, 1))
        back = dt.datetime.fromtimestamp(first, zone).replace(tzinfo=None)
        kind = "skipped" if back != naive else "repeated" if first != second else "plain"
        assert r.kind == kind and r.a == first * 1_000_000, r.t
        assert r.b == (second if kind == "repeated" else first) * 1_000_000
    utc = spark.range(1).select(F.unix_micros(S.loose_ts(F.lit("2024-10-27T00:30:00Z"), S.ZONE)).alias("a"), S.loose_ts(F.lit(None).cast("string"), S.ZONE).alias("n")).first()
    assert utc.a == dt.datetime(2024, 10, 27, 0, 30, tzinfo=dt.UTC).timestamp() * 1_000_000 and utc.n is None


def test_property_pivot(spark):
    p = lambda k, u, v: ((k, u), v)
    raw = spark.createDataFrame(
        [(1, 5, 1719828000000, None, [p("STEPS", None, "1"), p("STEPS", None, "12"), p("DISTANCE", "km", "1.5"), p("DISTANCE", "mile", "9"), p("DURATION", "min", "2")])],
        "user_id bigint, id bigint, date bigint, descriptor string, propertyInstances array<struct<property:struct<translationKey:string,baseUnit:string>,value:string>>",
    )
    got = store.pivot_activity_properties(raw).first()
    assert (got.date, got.steps, got.distance_meters, got.duration_s, got.kcalories) == ("2024-07-01 12:00:00", 12, 1500.0, 120.0, None)
    day = jobs.ingest(raw.unionByName(raw.withColumn("id", F.lit(6))), "Arena", 9)
    assert [(str(r.date), r.source, r.steps) for r in day.collect()] == [("2024-07-01", "arena", 12)]
    assert jobs.ingest(raw.unionByName(raw), "arena", 9, "sum").first().steps == 24


def test_validation(spark):
    rec = spark.createDataFrame([("2024-01-01T00:00:00", "5", "1.5", None, "00:10:00"), (None, "-1", "x", None, "0:10:00")], "date string, steps string, distance_meters string, kcalories string, duration string")
    good, bad = store.validate_records(rec)
    assert good.first().steps == 5
    assert bad.first().violations == ["date is required", "steps must not be negative", "distance_meters must be a number", "duration must be HH:MM:SS"]
    with pytest.raises(PySparkException):
        store.validate_records(rec, strict=True)[0].collect()


@pytest.mark.parametrize(
    ("seconds", "text"), [(0, "0:00:00"), (59, "0:00:59"), (3661, "1:01:01"), (86399, "23:59:59"), (86400, "1 day, 0:00:00"), (190000, "2 days, 4:46:40")]
)
def test_hms(spark, seconds, text):
    row = spark.range(1).select(S.seconds_to_hms(F.lit(seconds)).alias("t"), S.hms_to_seconds(S.seconds_to_hms(F.lit(seconds))).alias("s")).first()
    assert (row.t, row.s) == (text, float(seconds))


def test_loose_times(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(S.norm_date(F.lit(" 2025-01-02T03:04:05Z "))) == "2025-01-02"
    assert value(S.norm_date(F.lit("  "))) is None
    assert value(S.day_month_year(F.lit("2025-01-02T03:04:05Z"))) == "02-01-2025"
    assert value(S.day_month_year(F.lit("nope"))) is None
    assert value(S.day_bound(F.lit("2025-01-02"), True)) == "2025-01-02T23:59:59Z"
    assert value(S.strict_iso(F.lit("2025-01-02T03:04:05+01:00"))) is None
    assert value(S.strict_iso(F.lit("2025-01-02T03:04:05"))) == "2025-01-02T03:04:05"
    assert value(S.strip_bearer(F.lit(" bearer  abc "))) == "abc"
    assert value(S.millis_to_local(F.lit(1719828000000).cast("bigint"))) == "2024-07-01 12:00:00"
    assert value(S.nanos_to_local(F.lit("1719828000000000000"))) == "2024-07-01 12:00:00"
