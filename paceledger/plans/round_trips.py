"""Registered queries that write derived data to the shared folder and read it back, and those of the remaining scalars and jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceledger.functions import redact as R
from paceledger.functions import scalars as S
from paceledger.operators import audit, connectors, games, policy, store
from paceledger.plans import jobs
from paceledger.plans.queries import AS_OF, BEST, BOTH, CONNECTED, INTROSPECTION, LWW, MATRIX, POLICY, PREFIX, SALT, SHIFTED, _plays, _quiz, _resolved, _scaled_sql, best, query, shifted, text
from paceledger.plans.views import ctes, view
from paceledger.session import shared_dir
from paceledger.sources import landing, readers, writers
from paceledger.streaming import streams


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/paceledger-{name}-{uuid.uuid4().hex}"


def prop(key: str, value, unit: str | None = None):
    return F.struct(F.struct(F.lit(key).alias("translationKey"), F.lit(unit).cast("string").alias("baseUnit")).alias("property"), value.cast("string").alias("value"))


def _dump(spark: SparkSession, d: str) -> str:
    """Raw activities of the events, as JSON lines."""
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "gds").when(k % 3 == 1, "walk").otherwise("run")
    steps = F.when(k % 10 == 0, F.lit(-5)).otherwise(F.floor("value"))
    rows = e.select(k.alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("date"), "user_id", kind.alias("descriptor"), F.array(prop("STEPS", steps), prop("DURATION", k % 90, "min")).alias("propertyInstances"))
    path = folder(spark, "activities")
    rows.write.json(path)
    return path


@query("SELECT event_id AS id, user_id FROM events WHERE event_id % 3 = 1 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'")
def scan_activities(spark, d):
    return readers.scan_activities(spark, _dump(spark, d), "2024-01-03", "2024-01-20", "walk").select("id", "user_id")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY user_id")
def scan_trivia(spark, d):
    return readers.scan_trivia(spark, _dump(spark, d)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN event_id % 3 = 1 THEN 'walk' ELSE 'run' END AS descriptor, event_id AS id FROM events WHERE event_id % 3 > 0")
def scan_game_logs(spark, d):
    path = _dump(spark, d)
    plays, logs = readers.scan_game_logs(spark, path, path, ("walk", "run"))
    return plays.unionByName(logs).select("descriptor", "id")


@query("SELECT event_id AS user_id, CAST(floor(value) AS BIGINT) AS steps FROM events WHERE epoch_us(ts) BETWEEN 1704412800000000 AND 1705622400000000")
def scan_fit_points(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    point = F.struct(start.cast("string").alias("startTimeNanos"), (start + 1).cast("string").alias("endTimeNanos"), F.array(F.struct(F.floor("value").cast("bigint").alias("intVal"))).alias("value"))
    path = folder(spark, "fit")
    e.select(F.col("event_id").alias("user_id"), F.array(point).alias("point")).write.json(path)
    return store.flatten_fit_points(readers.scan_fit_points(spark, path, 1704412800000000000, 1705622400000000000)).select("user_id", "steps")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    rows = view(spark, d, "activity")
    return rows.withColumns({"duration_s": none.cast("double"), "kcalories": none.cast("double"), "raw_json": none.cast("string")})


@query(ctes("activity") + f" SELECT user_id, CAST(date AS STRING) AS date, source, steps FROM {LWW} AS q WHERE n = 1 AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-15'")
def scan_daily(spark, d):
    path = folder(spark, "daily")
    writers.write_daily(store.last_write_wins(_daily(spark, d)).drop("seq"), path)
    return readers.scan_daily(spark, path, "2024-01-05", "2024-01-15").select("user_id", text("date"), "source", "steps")


@query(ctes("activity") + f" SELECT user_id, CAST(date AS STRING) AS date, source, steps, inserted_at FROM {LWW} AS q WHERE n = 1")
def stored_upserts(spark, d):
    """Two upserts into a store that doesn't exist before the first."""
    path, rows = folder(spark, "daily"), _daily(spark, d)
    for part in (rows.where("seq % 3 <> 2"), rows.where("seq % 3 > 0")):
        writers.upsert_daily(spark, path, part)
    return readers.scan_daily(spark, path).select("user_id", text("date"), "source", "steps", "inserted_at")


@query(ctes("activity") + f" SELECT user_id, CAST(date AS STRING) AS date, source, steps, inserted_at FROM {LWW} AS q WHERE n = 1 AND inserted_at >= 300")
def stored_retention(spark, d):
    path = folder(spark, "daily")
    writers.write_daily(store.last_write_wins(_daily(spark, d)).drop("seq"), path)
    writers.retain_daily(spark, path, 60 * 86400 + 300)
    return readers.scan_daily(spark, path).select("user_id", text("date"), "source", "steps", "inserted_at")


@query(ctes("activity") + f" SELECT user_id, CAST(date AS STRING) AS date, source, steps FROM {LWW} AS q WHERE n = 1")
def stream_upsert_daily(spark, d):
    """The rows as a stream that writes through to the store, run a second time from the start: nothing changes."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    path = folder(spark, "daily")
    for _ in range(2):
        events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
        from paceledger.plans.views import ACTIVITY

        rows = spark.sql(ACTIVITY, events=events).withColumns({c: F.lit(None).cast(t) for c, t in (("duration_s", "double"), ("kcalories", "double"), ("raw_json", "string"))})
        streams.stream_upsert_daily(rows, path, folder(spark, "upsert-state")).start().awaitTermination()
    return readers.scan_daily(spark, path).select("user_id", text("date"), "source", "steps")


@query(
    """WITH r AS (SELECT user_id, CAST(ts AS DATE) AS date, event_id, CAST(floor(value) AS BIGINT) AS n, event_id % 90 AS m, row_number() OVER (PARTITION BY user_id, CAST(ts + INTERVAL 1 HOUR AS DATE) ORDER BY event_id DESC) AS k,
 CAST(ts + INTERVAL 1 HOUR AS DATE) AS day FROM events WHERE event_id % 3 = 1 AND event_id % 10 <> 0)
 SELECT user_id, CAST(day AS STRING) AS date, 'walks' AS source, n AS steps, CAST(m * 60 AS DOUBLE) AS duration_s, 'stored' AS place FROM r WHERE k = 1
 UNION ALL SELECT user_id, CAST(CAST(ts + INTERVAL 1 HOUR AS DATE) AS STRING), 'walks', -5, CAST(event_id % 90 * 60 AS DOUBLE), 'steps must not be negative' FROM events WHERE event_id % 3 = 1 AND event_id % 10 = 0"""
)
def ingest(spark, d):
    """A dump of activities to the store, and what breaks a rule."""
    path = folder(spark, "daily")
    bad = jobs.ingest_to_store(readers.scan_activities(spark, _dump(spark, d), descriptor="walk"), " Walks ", 7, path)
    stored = readers.scan_daily(spark, path).select("user_id", text("date"), "source", "steps", "duration_s", F.lit("stored").alias("place"))
    return stored.unionByName(bad.select("user_id", F.substring("date", 1, 10).alias("date"), F.lit("walks").alias("source"), "steps", "duration_s", F.array_join("violations", ";").alias("place")))


#: Every fortieth line of the dump is cut off.
CUT = 40


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """(id, value): the dump's lines, some of them cut off."""
    whole = spark.read.text(_dump(spark, d))
    key = F.get_json_object("value", "$.id").cast("bigint")
    return whole.select(key.alias("id"), F.when(key % CUT == 7, F.expr("left(value, length(value) - 9)")).otherwise(F.col("value")).alias("value"))


@query(
    f"""SELECT descriptor AS place, CAST(day AS STRING) AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT *, CAST(ts AS DATE) AS day, CASE event_id % 3 WHEN 0 THEN 'gds' WHEN 1 THEN 'walk' ELSE 'run' END AS descriptor FROM events) AS q
 WHERE event_id % {CUT} <> 7 AND day BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' AND descriptor <> 'run' GROUP BY 1, 2
 UNION ALL SELECT 'broken', CAST(event_id % 2 AS STRING), count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE event_id % {CUT} = 7 GROUP BY event_id % 2"""
)
def landed_activities(spark, d):
    """A dump that comes in two runs, read once: a window of two descriptors, and the broken lines by their own text."""
    lines, path = _lines(spark, d), folder(spark, "drop")
    for part in (0, 1):
        lines.where(F.col("id") % 2 == part).select("value").write.mode("append").text(path)
        landing.land(spark, path, f"{path}-landed", f"{path}-state").start().awaitTermination()
    out = f"{path}-landed"
    rows = [landing.scan_landed(spark, out, start="2024-01-03", end="2024-01-09", descriptor=k) for k in ("gds", "walk")]
    found = store.union_sources(*rows).groupBy(F.col("descriptor").alias("place"), F.to_date(F.timestamp_millis("date")).cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    key = F.regexp_extract("line", '"id":([0-9]+)', 1).cast("bigint")
    bad = landing.broken(spark, out).groupBy(F.lit("broken").alias("place"), (key % 2).cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum(key).alias("ids"))
    return found.unionByName(bad)


# ---- registry and policy ------------------------------------------------------------------------------------
@query(
    """SELECT c_custkey AS user_id, 'walk' AS domain, k AS pos, CASE WHEN k = 0 THEN 'Arena' ELSE 'StepCloud' END AS connected_application, concat('p', CAST(c_custkey AS STRING)) AS player_id
 FROM customer CROSS JOIN (VALUES (0), (1)) AS v(k) WHERE k <= c_custkey % 2"""
)
def scan_registry(spark, d):
    """Registry files of one document per nation."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    one = lambda app: F.struct(F.lit(app).alias("connected_application"), F.concat(F.lit("p"), "c_custkey").alias("player_id"), F.lit("Bearer x").alias("auth_bearer"))
    apps = F.slice(F.array(one("Arena"), one("StepCloud")), F.lit(1), (F.col("c_custkey") % 2 + 1).cast("int"))
    users = c.select(F.col("c_nationkey").alias("file"), F.struct(F.col("c_custkey").alias("user_id"), apps.alias("connected_apps_walk_data")).alias("u"))
    path = folder(spark, "registry")
    users.groupBy("file").agg(F.collect_list("u").alias("users")).repartition("file").write.partitionBy("file").json(path)
    found = readers.scan_registry(spark, path)
    return found.join(readers.scan_users(spark, path), "user_id").select("user_id", "domain", "pos", "connected_application", "player_id")


@query(POLICY + " SELECT user_id, client, purpose, tool, allow, redact FROM resolved")
def scan_policy(spark, d):
    """The rules as a policy document, read back and resolved for all requests."""
    r = view(spark, d, "rules").withColumn("rule", F.struct("allow", "redact"))
    by_purpose = r.groupBy("layer", "key").agg(F.map_from_entries(F.collect_list(F.struct("purpose", "rule"))).alias("rules"))
    layer = lambda name: F.map_from_entries(F.collect_list(F.when(F.col("layer") == name, F.struct("key", "rules"))))
    doc = by_purpose.agg(F.first(F.when(F.col("layer") == "default", F.col("rules")), ignorenulls=True).alias("defaults"), layer("client").alias("clients"), layer("tool").alias("tools"))
    path = folder(spark, "policy")
    doc.coalesce(1).write.json(path)
    out = policy.resolve_policy(view(spark, d, "requests"), readers.scan_policy(spark, path))
    return out.select("user_id", "client", "purpose", "tool", "allow", F.array_join("redact", ",").alias("redact"))


@query(MATRIX + " SELECT client, purpose, tool, allow, redact FROM resolved")
def write_policy_matrix(spark, d):
    r = view(spark, d, "requests")
    path = folder(spark, "matrix")
    writers.write_policy_matrix(policy.policy_matrix(*[r.select(c).distinct() for c in ("client", "purpose", "tool")], view(spark, d, "rules")), path)
    return spark.read.schema("client STRING, purpose STRING, tool STRING, allow BOOLEAN, redact ARRAY<STRING>").json(path).withColumn("redact", F.array_join("redact", ","))


# ---- audit log ----------------------------------------------------------------------------------------------
def _audit(spark: SparkSession, d: str) -> DataFrame:
    """The access log in the log's own schema, the user deep among the arguments for every third event."""
    e, none = view(spark, d, "access_log"), F.lit(None).cast("string")
    user = F.col("user_id").cast("string")
    deep = F.col("event_id") % 3 == 0
    inner = F.struct(F.when(deep, user).alias("user_id"), F.lit("secret").alias("token"))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit("tool").alias("kind"), "name", "client_id", "corr_id", F.col("event_id").cast("string").alias("request_id"),
        F.struct(F.when(~deep, user).alias("user_id"), F.col("purpose").alias("purpose"), F.struct(F.col("error_code").alias("code")).alias("error"), inner.alias("args")).alias("args"), "ok", "ms", none.alias("subject_hash"), "layer",
    )


@query(ctes("access_log") + f" SELECT event_id, substr(sha256(concat('{SALT}:', CAST(user_id AS STRING))), 1, 16) AS subject_hash, '{R.TOKEN}' AS user_id, '{R.TOKEN}' AS token, purpose, error_code, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM access_log")
def append_audit(spark, d):
    """The log sealed and appended in two parts, then scanned and flattened."""
    path, events = folder(spark, "audit"), _audit(spark, d).drop("layer")
    for part in (0, 1):
        writers.append_audit(events.where(F.pmod(F.xxhash64("request_id"), F.lit(2)) == part), path, SALT)
    out = audit.flatten_audit(readers.scan_audit(spark, path))
    user = F.coalesce("args.user_id", "args.args.user_id")
    return out.select(F.col("request_id").cast("bigint").alias("event_id"), "subject_hash", user.alias("user_id"), F.col("args.args.token").alias("token"), "purpose", "error_code", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(ctes("access_log") + " SELECT event_id, name, error_code FROM access_log WHERE error_code = 'denied_by_policy' AND client_id = 'AUDIT_APP' ORDER BY ts DESC LIMIT 40")
def newest_events(spark, d):
    """The newest denials of a client from the log by day, of which the newest days are read."""
    path, events = folder(spark, "audit"), _audit(spark, d).drop("layer")
    writers.append_audit(events, path, SALT)
    out = readers.newest_events(spark, path, 40, client_id="AUDIT_APP", error_code="denied_by_policy")
    return out.select(F.col("request_id").cast("bigint").alias("event_id"), "name", "error_code")


@query(ctes("access_log") + " SELECT layer, name, count(*) AS n FROM access_log GROUP BY layer, name")
def scan_audit_layers(spark, d):
    path, events = folder(spark, "layers"), _audit(spark, d)
    for layer in ("gateway", "sources"):
        events.where(F.col("layer") == layer).drop("layer").write.json(f"{path}/{layer}")
    return readers.scan_audit_layers(spark, path).groupBy("layer", "name").agg(F.count("*").alias("n"))


@query(ctes("access_log") + " SELECT event_id, client_id, error_code FROM access_log")
def stream_audit(spark, d):
    path = folder(spark, "audit")
    _audit(spark, d).drop("layer").write.json(path)
    out = streams.stream_audit(spark, path, 2).select(F.col("request_id").cast("bigint").alias("event_id"), "client_id", "error_code")
    return streams.run_to_end(out, "append")


@query(
    ctes("access_log") + """ SELECT name AS tool, coalesce(purpose, 'unknown') AS purpose, client_id AS client, count(*) AS calls, max(event_id) AS last_at FROM access_log GROUP BY 1, 2, 3 ORDER BY 1, 2, 3 LIMIT 10"""
)
def summary_order(spark, d):
    """The first ten rows of the ordered summary."""
    return audit.summary_order(audit.access_summary(view(spark, d, "access_log"), "event_id")).limit(10).select("tool", "purpose", "client", "calls", "last_at")


@query(ctes("activity") + BEST + " SELECT user_id, CAST(date AS STRING) AS date, steps FROM (SELECT *, row_number() OVER (ORDER BY date, user_id) AS k FROM best) AS q WHERE k <= 500")
def date_order(spark, d):
    """The first 500 rows in order of date: the order decides which."""
    return store.date_order(best(spark, d), "user_id").limit(500).select("user_id", text("date"), "steps")


@query(
    """WITH c AS (SELECT event_id, event_id % 4 AS n_records, event_id % 3 AS n_attempts, event_id % 5 AS a, CASE WHEN event_id % 2 = 0 THEN 'bad' END AS code FROM events)
 SELECT event_id, code AS error_code, CAST(n_records AS INT) AS n_records, CAST(n_attempts AS INT) AS n_attempts, CAST(a + 1 AS INT) AS n_stream_records, CAST(4 + CASE WHEN code IS NULL THEN 0 ELSE 1 END AS INT) AS n_keys FROM c"""
)
def payload_stats(spark, d):
    k = F.col("event_id")
    rows = lambda n: F.array_repeat(F.lit(1), n.cast("int"))
    stream = lambda n: F.struct(rows(n).alias("records"))
    p = spark.read.parquet(f"{d}/events.parquet").select("event_id", rows(k % 4).alias("records"), rows(k % 3).alias("attempts"), F.create_map(F.lit("a"), stream(k % 5), F.lit("b"), stream(F.lit(1))).alias("streams"), F.when(k % 2 == 0, F.struct(F.lit("bad").alias("code"))).alias("error"))
    return audit.payload_stats(p).select("event_id", "error_code", "n_records", "n_attempts", "n_stream_records", "n_keys")


@query(
    MATRIX.replace("WITH ", "WITH access_log AS (" + ctes("access_log")[len("WITH access_log AS (") : -1] + "), ", 1) + f""", w AS (SELECT * FROM access_log WHERE user_id = (SELECT min(user_id) FROM access_log WHERE user_id % 50 = 7)),
 own AS (SELECT *, name || '/' || coalesce(purpose, 'unknown') || '/' || client_id AS item FROM w WHERE starts_with(name, '{PREFIX}') AND name NOT IN ('{INTROSPECTION[0]}', '{INTROSPECTION[1]}'))
 SELECT 'access' AS part, item, count(*) AS n FROM own GROUP BY item
 UNION ALL SELECT 'errors', item || '/' || error_code, count(*) FROM own WHERE NOT ok AND error_code IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'allowed', client || '/' || purpose || '/' || tool, CASE WHEN allow THEN 1 ELSE 0 END FROM resolved
 UNION ALL SELECT 'inventory', event_type, count(*) FROM events WHERE user_id = (SELECT min(user_id) FROM w) GROUP BY 1, 2"""
)
def transparency_report(spark, d):
    """What is stored of one person, what is allowed, who looked, and with what errors."""
    events = view(spark, d, "access_log")
    events = events.withColumn("subject_hash", R.subject_hash(F.col("user_id"), SALT))
    subject = events.where("user_id % 50 = 7").agg(F.min("user_id").alias("u")).select(R.subject_hash(F.col("u"), SALT).alias("h")).first()["h"] or ""
    raw = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("event_type").alias("domain"), F.to_date("ts").alias("date"), F.col("props").alias("raw_json"))
    r = view(spark, d, "requests")
    names = [r.select(c).distinct() for c in ("client", "purpose", "tool")]
    parts = jobs.transparency_report(events.withColumn("ts", F.col("event_id")), raw, view(spark, d, "rules"), *names, subject_hash=subject, salt=SALT, prefix=PREFIX, introspection=INTROSPECTION)
    item = F.concat_ws("/", "tool", "purpose", "client")
    row = lambda part, what, n: [F.lit(part).alias("part"), what.alias("item"), n.cast("bigint").alias("n")]
    errors = parts["errors"].select("tool", "purpose", "client", F.explode("errors").alias("code", "n"))
    return store.union_sources(
        parts["access"].select(*row("access", item, F.col("calls"))),
        errors.select(*row("errors", F.concat_ws("/", item, "code"), F.col("n"))),
        parts["allowed"].select(*row("allowed", F.concat_ws("/", "client", "purpose", "tool"), F.col("allow").cast("int"))),
        parts["inventory"].select(*row("inventory", F.col("domain"), F.col("n_records"))),
    )


@query(ctes("access_log") + " SELECT CAST(row_number() OVER (ORDER BY ts) - 1 AS INT) AS n, layer, name, ok, (SELECT string_agg(DISTINCT layer, ',' ORDER BY layer) FROM access_log WHERE corr_id = 'c17') AS layers FROM access_log WHERE corr_id = 'c17'")
def trace_layers(spark, d):
    """One request's way through the layers, from the folders of both logs."""
    path, events = folder(spark, "layers"), _audit(spark, d)
    for layer in ("gateway", "sources"):
        events.where(F.col("layer") == layer).drop("layer").write.json(f"{path}/{layer}")
    return jobs.trace_layers(readers.scan_audit_layers(spark, path).withColumn("at", F.col("request_id").cast("bigint")), "c17", "at")


# ---- scalars ------------------------------------------------------------------------------------------------
@query(
    f"""WITH {SHIFTED}, v AS (SELECT *, event_id * 37 % 300000 AS sec FROM z) SELECT event_id, CASE WHEN sec < 86400 THEN '' WHEN sec < 172800 THEN '1 day, ' ELSE CAST(sec // 86400 AS STRING) || ' days, ' END || CAST(sec % 86400 // 3600 AS STRING) || ':'
 || lpad(CAST(sec % 3600 // 60 AS STRING), 2, '0') || ':' || lpad(CAST(sec % 60 AS STRING), 2, '0') AS hms, strftime(t + to_hours(h), '%Y-%m-%d %H:%M:%S') AS local_time, CASE WHEN event_id % 5 <> 0 THEN CAST(CAST(t AS DATE) AS STRING) END AS loose_date,
 CASE WHEN event_id % 2 = 0 THEN strftime(t, '%Y-%m-%dT23:59:59Z') ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END AS day_end, epoch_us(CASE WHEN event_id % 2 = 0 AND t >= TIMESTAMP '2024-10-27 01:00:00' AND t < TIMESTAMP '2024-10-27 02:00:00' THEN t - INTERVAL 1 HOUR ELSE t END) // 1000000 * 1000000000 AS zoned_nanos,
 CASE WHEN event_id % 2 = 0 THEN strftime(t, '%Y-%m-%d') ELSE strftime(t - INTERVAL 365 DAY, '%Y-%m-%d') END AS window_start, CASE WHEN event_id % 3 = 0 THEN event_id END AS json_value, CASE WHEN event_id % 3 <> 0 THEN 'text ' || CAST(event_id AS STRING) END AS json_text FROM v"""
)
def scalar_text(spark, d):
    """Durations, local times, loose dates, day bounds, zoned times, default windows and JSON values of all events."""
    k, t = F.col("event_id"), F.col("t")
    stamp = F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    # a local text of the repeated hour means its first pass
    local = F.date_format(F.from_utc_timestamp(t, S.ZONE), "yyyy-MM-dd'T'HH:mm:ss")
    zoned = S.loose_ts(F.when(k % 2 == 0, local).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")), S.ZONE)
    start, _ = S.default_window(F.when(k % 2 == 0, F.to_date(t).cast("timestamp")), F.lit(None).cast("timestamp"), t)
    value = S.as_json(F.when(k % 3 == 0, F.concat(F.lit('{"n": '), k.cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("text "), k.cast("string"))), "n BIGINT")
    out = shifted(spark, d).select(
        "event_id", S.seconds_to_hms(k * 37 % 300000).alias("hms"), S.nanos_to_local((F.unix_micros(t) * 1000).cast("string")).alias("local_time"), S.loose_date(F.when(k % 5 == 0, "no date").otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))).cast("string").alias("loose_date"),
        S.day_bound(F.when(k % 2 == 0, F.date_format(t, "yyyy-MM-dd")).otherwise(stamp), True).alias("day_end"), S.to_nanos(zoned).alias("zoned_nanos"), F.date_format(start, "yyyy-MM-dd").alias("window_start"),
        value["value"]["n"].alias("json_value"), value["text"].alias("json_text"),
    )
    return out


@query(f"SELECT event_id, '{R.TOKEN}' AS token, event_type AS note, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS metric, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 4 END AS INT) AS n_records, concat('p', CAST(user_id AS STRING)) AS player FROM events WHERE event_id % 5 <> 0")
def envelopes(spark, d):
    """Sanitised arguments, metrics in either shape, records of the payload or its streams, and stamped provenance."""
    k = F.col("event_id")
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("args", R.sanitize_args(F.create_map(F.lit(" Token"), F.lit("t"), F.lit("note"), F.col("event_type"))))
    shape = lambda v: F.struct(v.alias("m"))
    e = e.withColumn("data", F.when(k % 10 != 5, F.struct(F.when(k % 2 == 0, shape(F.lit(1))).alias("trivia_results"), F.when(k % 2 == 1, 2).alias("m")))).withColumn("error", F.when(k % 10 == 0, "down"))
    e = games.extract_metrics(e, "trivia_results", ("m",))
    rows = lambda n: F.array_repeat(F.lit("r"), n.cast("int"))
    e = e.withColumn("records", store.extract_records(F.when(k % 3 == 0, rows(F.lit(0))), F.create_map(F.lit("a"), F.struct(F.lit(None).cast("array<string>").alias("records")), F.lit("b"), F.struct(rows(k % 4).alias("records")))))
    e = connectors.stamp_provenance(e.withColumn("player_id", F.concat(F.lit("p"), "user_id")), AS_OF)
    return e.select("event_id", F.col("args")[" Token"].alias("token"), F.col("args")["note"].alias("note"), F.col("m").alias("metric"), F.size("records").alias("n_records"), F.col("provenance")["player_id"].alias("player"))


@query(CONNECTED + " SELECT user_id, player_id, CASE WHEN user_id % 3 = 0 THEN concat('own', CAST(user_id AS STRING)) ELSE token END AS token FROM resolved WHERE source = 'arena'")
def resolve_diabetes_connector(spark, d):
    walk = _resolved(spark, d)
    own = walk.where("user_id % 3 = 0 AND source = 'arena'").withColumns({"domain": F.lit("diabetes"), "token": F.concat(F.lit("own"), "user_id")})
    return connectors.resolve_diabetes_connector(walk.unionByName(own), "arena")


@query(ctes("orders_of") + " SELECT request_id, user_id FROM orders_of WHERE user_id % 10 = 0")
def unknown_users(spark, d):
    req = view(spark, d, "orders_of")
    users = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id")).where("user_id % 10 <> 0")
    return connectors.unknown_users(req, users).select("request_id", "user_id")


# ---- literacy -----------------------------------------------------------------------------------------------
@query(
    BOTH.replace("{plays}", _plays).replace("coalesce(avg(response), 0) AS avg_response", "avg(1 + id % 7) AS avg_response") + f""", t AS (SELECT user_id, {_scaled_sql(games.TRIVIA)} FROM rates), gm AS (SELECT user_id, {_scaled_sql(games.GAME)} FROM overview),
 s AS (SELECT t.user_id, -0.15 * avg_hint + avg_correct - 0.85 * avg_incorrect AS a, 0.15 * avg_response - trips_per_game + 0.85 * avg_accuracy AS b FROM t JOIN gm ON t.user_id = gm.user_id)
 SELECT user_id, '{AS_OF}' AS assess_date, round(a, 6) AS trivia_score, round(b, 6) AS game_score, round(0.6 * a + 0.4 * b, 6) AS final_score FROM s"""
)
def literacy_assessment(spark, d):
    """Scores from raw activities of every user, appended to the assessments and read back."""
    # a file of few row groups is read by few tasks, and the work is in the texts; with a number, tasks aren't joined by their few bytes
    p = view(spark, d, "plays").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    kinds = F.concat(*[F.array_repeat(F.struct(F.lit(k).alias("DestinationPathType")), F.col(c).cast("int")) for k, c in ((1, "home"), (2, "outdoors"), (3, "work"))])
    plays = p.select("user_id", F.array(prop("SCORE", F.col("score")), prop("PLAYTIME", F.col("playtime")), prop("GLUCOSE_RANGE_PERCENTAGE", F.col("accuracy")), prop("DAYS_PLAYED", F.col("days")), prop("PLAYTHROUGH_DATA", F.to_json(F.struct(kinds.alias("Turns"))))).alias("propertyInstances"))
    number = lambda x: F.lit(float(x))
    turn = F.struct(number(1).alias("Score"), (F.col("hospital_turns") == 1).alias("IsHospitalised"), number(1).alias("GlucoseValueStart"), number(5).alias("GlucoseValueEnd"), number(2).alias("MinutesStart"), (F.lit(3.0) + F.col("id") % 7).alias("MinutesEnd"))
    play = F.to_json(F.struct(F.lit(False).alias("Aborted"), F.array(turn).alias("Turns")))
    logs = p.select("user_id", "id", F.array(prop("ENGAGEMENT_DATA", F.to_json(F.struct(F.array(F.struct(F.array(play).alias("Values"))).alias("GameplayData"))))).alias("propertyInstances"))
    scores = jobs.literacy_assessment(_quiz(spark, d), plays, logs)
    path = folder(spark, "assessments")
    writers.append_assessments(scores.select("user_id", "trivia_score", "game_score", "final_score"), path, AS_OF)
    return spark.read.parquet(path).select("user_id", text("assess_date"), *[F.round(c, 6).alias(c) for c in ("trivia_score", "game_score", "final_score")])


@query("SELECT c_custkey AS user_id, CAST(k AS STRING) AS date, round(c_acctbal / 3 + k, 6) AS final FROM customer CROSS JOIN (VALUES (1), (2), (3)) AS v(k) WHERE k <= c_custkey % 3")
def scan_assessments(spark, d):
    """Assessment histories, a document per nation."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    entry = lambda k: F.struct(F.lit(str(k)).alias("date"), F.struct((F.col("c_acctbal") / 3 + k).alias("final")).alias("final_scores"))
    entries = F.slice(F.array(entry(1), entry(2), entry(3)), F.lit(1), (F.col("c_custkey") % 3).cast("int"))
    users = c.select(F.col("c_nationkey").alias("file"), F.struct(F.col("c_custkey").cast("string").alias("k"), F.struct(entries.alias("entries")).alias("v")).alias("u"))
    path = folder(spark, "history")
    users.groupBy("file").agg(F.map_from_entries(F.collect_list("u")).alias("users")).repartition("file").write.partitionBy("file").json(path)
    return readers.scan_assessments(spark, path).select("user_id", "date", F.round("final", 6).alias("final"))
