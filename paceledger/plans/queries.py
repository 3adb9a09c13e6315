"""The registered queries of the health-record library, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceledger.functions import redact as R
from paceledger.functions import scalars as S
from paceledger.operators import audit, connectors, games, policy, store
from paceledger.plans import jobs
from paceledger.plans.views import ctes, view
from paceledger.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
LIVE = ("arena", "stepcloud")
AS_OF = "2024-01-30"
SALT = "demo-salt"
PREFIX, INTROSPECTION = "health.", ("health.telemetry.query.v1", "health.telemetry.recent.v1")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def text(c: str):
    return F.col(c).cast("string").alias(c)


BEST = """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY CASE WHEN source = 'arena' THEN 0 ELSE 1 END,
 inserted_at DESC, source) AS n FROM activity) AS q WHERE n = 1)"""


def best(spark: SparkSession, d: str) -> DataFrame:
    return store.preferred_per_day(view(spark, d, "activity"), "arena")


# ---- store --------------------------------------------------------------------------------------------------
@query(ctes("activity") + BEST + " SELECT user_id, CAST(date AS STRING) AS date, source, steps FROM best")
def preferred_per_day(spark, d):
    return best(spark, d).select("user_id", text("date"), "source", "steps")


@query(ctes("activity") + BEST + " SELECT user_id, count(*) AS days, CAST(sum(steps) AS BIGINT) AS total_steps, round(avg(steps), 6) AS avg_steps FROM best GROUP BY user_id")
def daily_stats(spark, d):
    return store.daily_stats(best(spark, d)).withColumn("avg_steps", F.round("avg_steps", 6))


@query(ctes("activity") + " SELECT user_id, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT user_id, source FROM activity) AS q GROUP BY user_id")
def store_sources(spark, d):
    return store.store_sources(view(spark, d, "activity")).withColumn("sources", F.array_join("sources", ","))


@query(
    ctes("activity") + BEST + """ SELECT user_id, count(*) AS days, CAST(sum(steps) AS BIGINT) AS total_steps, CAST(floor(sum(steps) / count(*)) AS BIGINT) AS avg_steps,
 min(steps) AS min_steps, max(steps) AS max_steps FROM best GROUP BY user_id"""
)
def walk_features(spark, d):
    rows = best(spark, d)
    return store.walk_features(rows, rows.select("user_id"))


@query(
    ctes("activity") + BEST + f""" SELECT user_id, CAST(round_even(avg(steps), 0) AS BIGINT) AS avg_steps, count(*) AS n_records FROM best
 WHERE date >= DATE '{AS_OF}' - INTERVAL 6 DAY GROUP BY user_id"""
)
def trailing_avg_steps(spark, d):
    return store.trailing_avg_steps(best(spark, d), AS_OF)




@query(
    ctes("activity", "tiers") + BEST + f""", a AS (SELECT user_id, CAST(round_even(avg(steps), 0) AS BIGINT) AS avg_steps FROM best WHERE date >= DATE '{AS_OF}' - INTERVAL 6 DAY GROUP BY user_id),
 b AS (SELECT u.user_id, coalesce(a.avg_steps, 0) AS avg_steps FROM (SELECT DISTINCT user_id FROM activity) AS u LEFT JOIN a ON u.user_id = a.user_id),
 c AS (SELECT b.*, t.*, row_number() OVER (PARTITION BY b.user_id ORDER BY t.below NULLS LAST) AS k FROM b JOIN tiers AS t ON t.below IS NULL OR b.avg_steps < t.below)
 SELECT user_id, avg_steps, 7 AS days_considered, tier, message, refs AS bct_refs, rationale FROM c WHERE k = 1"""
)
def coach_plans(spark, d):
    tiers = view(spark, d, "tiers").withColumn("bct_refs", F.split("refs", "\\|")).withColumn("below", F.col("below").cast("bigint"))
    out = jobs.coach_plans(view(spark, d, "activity"), "arena", AS_OF, tiers)
    return out.select("user_id", "avg_steps", "days_considered", "tier", "message", F.array_join("bct_refs", "|").alias("bct_refs"), "rationale")


@query(ctes("activity") + " SELECT user_id, CAST(date AS STRING) AS date, source, steps, seq FROM activity WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")
def date_window(spark, d):
    return store.date_window(view(spark, d, "activity"), "2024-01-10", "2024-01-12").select("user_id", text("date"), "source", "steps", "seq")


@query(
    ctes("activity") + BEST + """ SELECT user_id, CAST(date AS STRING) AS date, steps FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date, source) AS k FROM best) AS q
 WHERE k > 2 AND k <= 5"""
)
def page_per_user(spark, d):
    return store.page_per_user(best(spark, d), 3, 2).select("user_id", text("date"), "steps")


@query(ctes("activity") + " SELECT user_id, CAST(date AS STRING) AS date, source, steps, seq FROM activity ORDER BY seq LIMIT 25 OFFSET 50")
def page(spark, d):
    return store.page(view(spark, d, "activity"), [F.col("seq")], 25, 50).select("user_id", text("date"), "source", "steps", "seq")


LWW = "(SELECT *, row_number() OVER (PARTITION BY user_id, date, source ORDER BY inserted_at DESC, seq DESC) AS n FROM activity)"


@query(ctes("activity") + f" SELECT user_id, CAST(date AS STRING) AS date, source, steps, seq FROM {LWW} AS q WHERE n = 1")
def last_write_wins(spark, d):
    return store.last_write_wins(view(spark, d, "activity")).select("user_id", text("date"), "source", "steps", "seq")


@query(ctes("activity") + " SELECT user_id, CAST(date AS STRING) AS date, source, CAST(sum(steps) AS BIGINT) AS steps FROM activity GROUP BY user_id, date, source")
def sum_per_day(spark, d):
    return store.sum_per_key(view(spark, d, "activity")).select("user_id", text("date"), "source", "steps")


@query(ctes("activity") + " SELECT CAST(sum(CASE WHEN inserted_at >= 300 THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN inserted_at < 300 THEN 1 ELSE 0 END) AS BIGINT) AS deleted FROM activity")
def retain_daily(spark, d):
    return store.retain_daily(view(spark, d, "activity"), 60 * 86400 + 300)[1]


@query(
    ctes("activity") + """, old AS (SELECT *, row_number() OVER (PARTITION BY user_id, date, source ORDER BY inserted_at DESC) AS n FROM activity WHERE seq % 2 = 0),
 new AS (SELECT *, row_number() OVER (PARTITION BY user_id, date, source ORDER BY inserted_at DESC) AS n FROM activity WHERE seq % 2 = 1)
 SELECT user_id, CAST(date AS STRING) AS date, source, steps, inserted_at FROM new WHERE n = 1
 UNION ALL SELECT o.user_id, CAST(o.date AS STRING), o.source, o.steps, o.inserted_at FROM old AS o LEFT JOIN new AS w
 ON o.user_id = w.user_id AND o.date = w.date AND o.source = w.source WHERE o.n = 1 AND w.user_id IS NULL"""
)
def upsert_daily(spark, d):
    rows = view(spark, d, "activity")
    existing = store.last_write_wins(rows.where("seq % 2 = 0")).drop("seq")
    return store.upsert_daily(existing, rows.where("seq % 2 = 1")).select("user_id", text("date"), "source", "steps", "inserted_at")


@query(ctes("activity") + " SELECT source, count(*) AS n, CAST(sum(steps) AS BIGINT) AS steps FROM activity WHERE source <> 'manual' GROUP BY source")
def union_sources(spark, d):
    rows = view(spark, d, "activity")
    both = store.union_sources(rows.where("source = 'arena'"), rows.where("source = 'stepcloud'").drop("distance_meters"))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.sum("steps").alias("steps"))


@query(
    """SELECT user_id, CAST(CAST(ts AS DATE) AS STRING) AS date, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'arena' WHEN 1 THEN 'unknown' ELSE 'stepcloud' END AS source,
 CASE WHEN event_id % 4 = 0 AND floor(value) <> 0 THEN CAST(floor(value) AS BIGINT) ELSE CAST(floor(value) AS BIGINT) + 1 END AS steps, CASE WHEN event_id % 2 = 0 THEN value ELSE 0.0 END AS distance_meters,
 CAST(event_id % 100 AS DOUBLE) AS duration_s FROM events WHERE event_id % 5 <> 0"""
)
def normalize_ingest(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.floor("value").cast("bigint")
    loose = e.select(
        "user_id",
        F.when(F.col("event_id") % 5 == 0, "  ").when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("date"),
        F.when((F.col("event_id") % 5 != 0) & (F.col("event_id") % 2 == 1), F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.when(F.col("event_id") % 4 == 0, n).otherwise(0).alias("steps"),
        (n + 1).alias("step_count"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("distance"),
        F.concat(F.lit("0:0"), F.when(F.col("event_id") % 100 >= 60, "1:").otherwise("0:"), F.format_string("%02d", F.col("event_id") % 100 % 60)).alias("duration"),
        F.when(F.col("event_id") % 3 == 0, "  ARENA ").when(F.col("event_id") % 3 == 1, " ").otherwise("stepcloud").alias("src"),
    )
    return store.normalize_ingest(loose, F.col("src"), 0).select("user_id", text("date"), "source", "steps", "distance_meters", "duration_s")


@query(
    """SELECT event_id, concat_ws('; ', CASE WHEN event_id % 11 = 0 THEN 'date is required' END, CASE WHEN event_id % 7 = 0 THEN 'steps must be a whole number' END,
 CASE WHEN event_id % 7 = 1 THEN 'steps must not be negative' END, CASE WHEN event_id % 13 = 0 THEN 'duration must be HH:MM:SS' END) AS violations
 FROM events WHERE event_id % 11 = 0 OR event_id % 7 < 2 OR event_id % 13 = 0"""
)
def validate_records(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id")
    rec = e.select(
        "event_id",
        F.when(k % 11 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("date"),
        F.when(k % 7 == 0, "12.5").when(k % 7 == 1, "-3").otherwise(F.floor("value").cast("string")).alias("steps"),
        F.col("value").cast("string").alias("distance_meters"),
        F.lit(None).cast("string").alias("kcalories"),
        F.when(k % 13 == 0, "0:10:00").otherwise("00:10:00").alias("duration"),
    )
    return store.validate_records(rec)[1].select("event_id", F.array_join("violations", "; ").alias("violations"))


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE NULL END AS distance_meters, CASE WHEN event_id % 3 = 0 THEN value * 60 WHEN event_id % 3 = 1 THEN value * 3600 END AS duration_s,
 CAST(floor(value) AS BIGINT) + 1 AS steps FROM events"""
)
def pivot_activity_properties(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    prop = lambda key, unit, value: F.struct(F.struct(F.lit(key).alias("translationKey"), unit.cast("string").alias("baseUnit")).alias("property"), value.cast("string").alias("value"))
    k = F.col("event_id")
    raw = e.select(
        "user_id",
        k.alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("date"),
        F.array(
            prop("STEPS", F.lit(None), F.floor("value")),
            prop("STEPS", F.lit(None), F.floor("value") + 1),
            prop("DISTANCE", F.when(k % 2 == 0, "m").otherwise("mile"), F.col("value")),
            prop("DISTANCE", F.lit("yard"), F.lit(1)),
            prop("DURATION", F.when(k % 3 == 0, "min").when(k % 3 == 1, "h").otherwise("day"), F.col("value")),
        ).alias("propertyInstances"),
    )
    return store.pivot_activity_properties(raw).select(F.col("activity_id").alias("event_id"), "distance_meters", "duration_s", "steps")


@query("SELECT event_id, CAST(floor(value) AS BIGINT) AS steps, 60.0 AS duration_s FROM events")
def flatten_fit_points(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    value = F.array(F.struct(F.lit(None).cast("bigint").alias("intVal")), F.struct(F.floor("value").cast("bigint").alias("intVal")))
    point = F.struct(start.cast("string").alias("startTimeNanos"), (start + 60_000_000_000).cast("string").alias("endTimeNanos"), value.alias("value"))
    out = store.flatten_fit_points(e.select(F.col("event_id").alias("user_id"), F.array(point).alias("point")))
    return out.select(F.col("user_id").alias("event_id"), "steps", "duration_s")


SHIFTED = "s AS (SELECT *, ts + to_days(CAST(event_id % 12 * 30 AS INT)) AS t FROM events), z AS (SELECT *, CASE WHEN t >= TIMESTAMP '2024-03-31 01:00:00' AND t < TIMESTAMP '2024-10-27 01:00:00' THEN 2 ELSE 1 END AS h FROM s)"


def shifted(spark, d) -> DataFrame:
    """Events spread over the twelve months of a year, as t."""
    return spark.read.parquet(f"{d}/events.parquet").withColumn("t", F.col("ts").cast("timestamp") + F.make_dt_interval(days=(F.col("event_id") % 12 * 30).cast("int")))


@query(f"WITH {SHIFTED} SELECT event_id, strftime(t + to_hours(h), '%Y-%m-%d %H:%M:%S') AS local_time, strftime(t, '%Y-%m-%d %H:%M:%S') AS utc_time, strftime(t, '%d-%m-%Y') AS dmy FROM z")
def time_text(spark, d):
    e = shifted(spark, d).withColumn("ms", F.unix_millis("t"))
    iso = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select("event_id", S.millis_to_local(F.col("ms")).alias("local_time"), S.millis_to_utc(F.col("ms")).alias("utc_time"), S.day_month_year(iso).alias("dmy"))


# ---- redaction ----------------------------------------------------------------------------------------------
def _payloads(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id")
    rec = lambda i: F.struct(F.lit("Bearer abc").alias("token"), F.concat(F.lit(f"u{i}"), "user_id").alias("email"), (F.floor("value") + i).cast("bigint").alias("keep"))
    provenance = F.create_map(F.lit("player_id"), F.col("user_id").cast("string"), F.lit("email"), F.lit("x"), F.lit("note"), F.col("event_type"))
    inner = F.struct(F.when(k % 4 == 0, "bearer x").otherwise("y").alias("token"), k.alias("n"))
    return e.select(
        "event_id", "user_id", "event_type",
        F.slice(F.array(rec(0), rec(1), rec(2)), F.lit(1), (k % 3 + 1).cast("int")).alias("records"),
        F.map_filter(provenance, lambda key, _: (key != "email") | (k % 2 == 0)).alias("provenance"),
        F.create_map(F.lit("user_id"), F.col("user_id"), F.lit("n"), k).alias("counts"),
        F.create_map(F.lit("a"), inner, F.concat(F.lit(" Token"), F.when(k % 5 == 0, "s").otherwise("")), inner).alias("nested"),
    )


@query("SELECT event_id, 'note' AS keys, event_type AS note FROM events")
def minimize_provenance(spark, d):
    p = _payloads(spark, d).withColumn("p", R.minimize_provenance(F.col("provenance")))
    return p.select("event_id", F.array_join(F.map_keys("p"), ",").alias("keys"), F.col("p")["note"].alias("note"))


@query(
    f"""SELECT event_id, '{R.TOKEN}' AS token, CASE WHEN event_id % 3 > 0 THEN '{R.TOKEN}' END AS email, CAST(floor(value) AS BIGINT) AS keep, '{R.TOKEN}' AS player, '{R.TOKEN}' AS user_count,
 CAST(event_id AS STRING) AS n, '{R.TOKEN}' AS inner_token, event_id AS inner_n FROM events"""
)
def redact_paths(spark, d):
    p = R.redact_paths(_payloads(spark, d), ["records.token", "records.email", "provenance.player_id", "counts.user_id", "nested.a.token", "", None, "no.such", "nested.a.none"])
    first, second = F.get("records", F.lit(0)), F.get("records", F.lit(1))
    return p.select(
        "event_id", first["token"].alias("token"), second["email"].alias("email"), first["keep"].alias("keep"), F.col("provenance")["player_id"].alias("player"), F.col("counts")["user_id"].alias("user_count"),
        F.col("counts")["n"].alias("n"), F.col("nested")["a"]["token"].alias("inner_token"), F.col("nested")["a"]["n"].alias("inner_n"),
    )


@query("SELECT event_id, CAST(2 * (event_id % 3 + 1) + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END + 1 AS INT) AS n_masked FROM events")
def redaction_count(spark, d):
    p = _payloads(spark, d)
    return p.select("event_id", R.redaction_count(p, ["records.token", "records.email", "provenance.email", "nested.a.token", "nested.z.token", "no.such", ""]).alias("n_masked"))


#: Members that hold secrets, and what becomes of them: values of every kind, keys padded, escaped and in any case, at depth.
SECRET_MEMBERS = (
    (r'"token": "a\"b, \"token\": 1"', f'"token": "{R.TOKEN}"'),
    (r'"api_key" : {"v": "secret", "deep": [1, {"x": "}"}]}', f'"api_key" : "{R.TOKEN}"'),
    (r'"args": [{"ACCESS_TOKEN": ["abc", [2]], "keep": 1.50}, "token", [[{"token ": null}]]]', f'"args": [{{"ACCESS_TOKEN": "{R.TOKEN}", "keep": 1.50}}, "token", [[{{"token ": "{R.TOKEN}"}}]]]'),
    (r'"\u0041pikey": -1e5, "note": "\u0041 token"', rf'"\u0041pikey": "{R.TOKEN}", "note": "\u0041 token"'),
    (r'" Authorization\t": " bearer xyz", "tokens": "kept"', rf'" Authorization\t": "Bearer {R.TOKEN}", "tokens": "kept"'),
    (r'"auth_bearer": "x"}, {"', f"{R.TOKEN}"),
)


@query(
    "SELECT event_id, CASE CAST(event_id % 6 AS INT) "
    + " ".join(f"WHEN {i} THEN concat(left(props, length(props) - 1), ', ', '{after}', '}}')" for i, (_, after) in enumerate(SECRET_MEMBERS[:-1]))
    + f" ELSE '{SECRET_MEMBERS[-1][1]}' END AS props FROM events"
)
def redact_json_keys(spark, d):
    """Every sixth text isn't JSON and is masked whole."""
    e = spark.read.parquet(f"{d}/events.parquet")
    member = F.get(F.array(*[F.lit(before) for before, _ in SECRET_MEMBERS]), (F.col("event_id") % len(SECRET_MEMBERS)).cast("int"))
    raw = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(", "), member, F.lit("}"))
    return e.select("event_id", R.redact_json_keys(raw).alias("props"))


@query(
    f"""SELECT event_id, 'Bearer {R.TOKEN}' AS token, concat('u0', CAST(user_id AS STRING)) AS email, CASE WHEN event_id % 4 = 0 THEN 'Bearer {R.TOKEN}' ELSE '{R.TOKEN}' END AS inner_token,
 event_id AS inner_n, event_id % 5 = 0 AS other_kept FROM events"""
)
def redact_secret_keys(spark, d):
    p = R.redact_secrets(_payloads(spark, d))
    inner = F.col("nested")["a"]
    others = F.map_filter("nested", lambda key, v: (key != "a") & v.isNotNull())
    return p.select("event_id", F.col("records")[0]["token"].alias("token"), F.col("records")[0]["email"].alias("email"), inner["token"].alias("inner_token"), inner["n"].alias("inner_n"), (F.size(others) == 1).alias("other_kept"))


@query(
    f"""SELECT event_id, '{R.TOKEN}' AS user_id, 'Bearer abc' AS token, '{R.TOKEN}' AS email, '{R.TOKEN}' AS player, event_type AS note, '{R.TOKEN}' AS user_count, CAST(event_id AS STRING) AS n FROM events"""
)
def redact_pii_keys(spark, d):
    p = R.redact_pii(_payloads(spark, d))
    rec = F.col("records")[0]
    return p.select(
        "event_id", "user_id", rec["token"].alias("token"), rec["email"].alias("email"), F.col("provenance")["player_id"].alias("player"), F.col("provenance")["note"].alias("note"),
        F.col("counts")["user_id"].alias("user_count"), F.col("counts")["n"].alias("n"),
    )


@query(f"SELECT event_id, substr(sha256(concat('{SALT}:', CAST(user_id AS STRING))), 1, 16) AS subject_hash FROM events")
def subject_hash(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", R.subject_hash(F.col("user_id"), SALT).alias("subject_hash"))


# ---- policy -------------------------------------------------------------------------------------------------
RESOLVED = """, resolved AS (SELECT r.user_id, r.client, r.purpose, r.tool, coalesce(t.allow, c.allow, g.allow, true) AS allow, coalesce(t.redact, c.redact, g.redact, '') AS redact,
 g.allow AS default_allow, c.allow AS client_allow, t.allow AS tool_allow FROM requests AS r
 LEFT JOIN rules AS g ON g.layer = 'default' AND g.purpose = lower(trim(r.purpose)) LEFT JOIN rules AS c ON c.layer = 'client' AND c.key = r.client AND c.purpose = lower(trim(r.purpose))
 LEFT JOIN rules AS t ON t.layer = 'tool' AND t.key = r.tool AND t.purpose = lower(trim(r.purpose)))"""
POLICY = ctes("requests", "rules") + RESOLVED


@query(POLICY + " SELECT user_id, client, purpose, tool, allow, redact FROM resolved")
def resolve_policy(spark, d):
    out = policy.resolve_policy(view(spark, d, "requests"), view(spark, d, "rules"))
    return out.select("user_id", "client", "purpose", "tool", "allow", F.array_join("redact", ",").alias("redact"))


@query(POLICY + " SELECT user_id, client, purpose, tool, allow, CAST(default_allow AS STRING) AS default_allow, CAST(client_allow AS STRING) AS client_allow, CAST(tool_allow AS STRING) AS tool_allow FROM resolved")
def explain_policy(spark, d):
    out = policy.explain_policy(view(spark, d, "requests"), view(spark, d, "rules"))
    layers = [F.col(f"{k}_rule.allow").cast("string").alias(f"{k}_allow") for k in ("default", "client", "tool")]
    return out.select("user_id", "client", "purpose", "tool", "allow", *layers)


#: The rules as they changed within the month: each default and client rule turns after the tenth, tool rules hold from the fifth on, and one never ended.
TIMED_RULES = """, timed AS (
 SELECT layer, key, purpose, allow, redact, CAST(NULL AS TIMESTAMP) AS valid_from, TIMESTAMP '2024-01-10 00:00:00' AS valid_to FROM rules WHERE layer <> 'tool'
 UNION ALL SELECT layer, key, purpose, NOT allow, redact, TIMESTAMP '2024-01-10 00:00:00', CAST(NULL AS TIMESTAMP) FROM rules WHERE layer <> 'tool'
 UNION ALL SELECT layer, key, purpose, allow, redact, TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-20 00:00:00' FROM rules WHERE layer = 'tool'
 UNION ALL SELECT layer, key, purpose, NOT allow, redact, TIMESTAMP '2024-01-15 12:00:00', CAST(NULL AS TIMESTAMP) FROM rules WHERE layer = 'tool')"""


def _timed_rules(spark, d) -> DataFrame:
    r = view(spark, d, "rules")
    at = lambda text: F.lit(text).cast("timestamp")
    other, tool = r.where("layer <> 'tool'"), r.where("layer = 'tool'")
    turned = lambda rows: rows.withColumn("allow", ~F.col("allow"))
    parts = [(other, None, "2024-01-10"), (turned(other), "2024-01-10", None), (tool, "2024-01-05", "2024-01-20"), (turned(tool), "2024-01-15 12:00:00", None)]
    return store.union_sources(*[rows.withColumns({"valid_from": at(a), "valid_to": at(b)}) for rows, a, b in parts])


def _held(layer: str, key: str) -> str:
    return f"""(SELECT event_id, allow, redact, valid_from FROM (SELECT a.event_id, t.allow, t.redact, t.valid_from,
  row_number() OVER (PARTITION BY a.event_id ORDER BY t.valid_from DESC NULLS LAST) AS n
  FROM asked AS a JOIN timed AS t ON t.layer = '{layer}' AND t.purpose = lower(trim(a.purpose)) {key} AND (t.valid_from IS NULL OR t.valid_from <= a.ts) AND (t.valid_to IS NULL OR t.valid_to > a.ts)) AS q WHERE n = 1)"""


@query(
    ctes("access_log", "rules") + TIMED_RULES + f""", asked AS (SELECT event_id, ts, client_id AS client, name AS tool, CASE WHEN event_id % 3 = 0 THEN upper(purpose) ELSE purpose END AS purpose FROM access_log WHERE purpose IS NOT NULL)
 SELECT a.event_id, a.purpose, coalesce(t.allow, c.allow, g.allow, true) AS allow, coalesce(t.redact, c.redact, g.redact, '') AS redact, CAST(epoch_us(t.valid_from) AS BIGINT) AS tool_since
 FROM asked AS a LEFT JOIN {_held("default", "")} AS g ON a.event_id = g.event_id LEFT JOIN {_held("client", "AND t.key = a.client")} AS c ON a.event_id = c.event_id
 LEFT JOIN {_held("tool", "AND t.key = a.tool")} AS t ON a.event_id = t.event_id"""
)
def explain_policy_at(spark, d):
    """Every logged call with the rule of its own day."""
    log = view(spark, d, "access_log").where("purpose IS NOT NULL")
    asked = log.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("client_id").alias("client"), F.col("name").alias("tool"), F.when(F.col("event_id") % 3 == 0, F.upper("purpose")).otherwise(F.col("purpose")).alias("purpose"))
    out = policy.explain_policy_at(asked, _timed_rules(spark, d))
    return out.select("event_id", "purpose", "allow", F.array_join("redact", ",").alias("redact"), F.unix_micros("tool_rule.valid_from").alias("tool_since"))


MATRIX = (
    ctes("requests", "rules").replace("requests AS (", "reqs AS (") + """, requests AS (SELECT 0 AS user_id, c.client, p.purpose, t.tool FROM (SELECT DISTINCT client FROM reqs) AS c
 CROSS JOIN (SELECT DISTINCT purpose FROM reqs) AS p CROSS JOIN (SELECT DISTINCT tool FROM reqs) AS t)""" + RESOLVED
)


@query(MATRIX + " SELECT client, purpose, tool, allow, redact FROM resolved")
def policy_matrix(spark, d):
    r = view(spark, d, "requests")
    names = [r.select(c).distinct() for c in ("client", "purpose", "tool")]
    return policy.policy_matrix(*names, view(spark, d, "rules")).select("client", "purpose", "tool", "allow", F.array_join("redact", ",").alias("redact"))


def _request_payloads(spark, d) -> DataFrame:
    r = view(spark, d, "requests")
    rec = F.struct(F.col("user_id").alias("steps"), (F.col("user_id") * 2).alias("kcalories"))
    return r.withColumn("records", F.array(rec)).withColumn("provenance", F.create_map(F.lit("player_id"), F.concat(F.lit("p"), "user_id"), F.lit("email"), F.lit("e"), F.lit("note"), F.lit("ok")))


@query(
    POLICY + f""" SELECT user_id, client, purpose, tool, CASE WHEN NOT allow THEN 'denied_by_policy' END AS error_code, user_id AS steps,
 CASE WHEN allow AND contains(redact, 'records.kcalories') THEN '{R.TOKEN}' ELSE CAST(user_id * 2 AS STRING) END AS kcalories,
 CASE WHEN allow AND contains(redact, 'provenance.player_id') THEN '{R.TOKEN}' ELSE concat('p', CAST(user_id AS STRING)) END AS player,
 CASE WHEN allow AND contains(redact, 'provenance.email') THEN '{R.TOKEN}' ELSE 'e' END AS email FROM resolved"""
)
def enforce_policy(spark, d):
    out = policy.enforce_policy(_request_payloads(spark, d), view(spark, d, "rules"), jobs.REDACTABLE)
    r, p = F.col("records")[0], F.col("provenance")
    return out.select("user_id", "client", "purpose", "tool", F.col("error.code").alias("error_code"), r["steps"].alias("steps"), r["kcalories"].alias("kcalories"), p["player_id"].alias("player"), p["email"].alias("email"))


@query(
    ctes("requests") + """ SELECT user_id, client, purpose, tool, CASE WHEN lower(trim(purpose)) = 'modeling' THEN 'not_supported' END AS error_code, CASE WHEN lower(trim(purpose)) = 'modeling' THEN 0 ELSE 1 END AS n_records,
 CASE lower(trim(purpose)) WHEN 'coaching' THEN 'email,note,player_id' WHEN 'analytics' THEN 'note' END AS provenance_keys FROM requests"""
)
def shape_for_purpose(spark, d):
    rows = _request_payloads(spark, d).withColumn("error", F.lit(None).cast("struct<code:string,message:string>"))
    out = policy.shape_for_purpose(rows)
    return out.select("user_id", "client", "purpose", "tool", F.col("error.code").alias("error_code"), F.coalesce(F.size("records"), F.lit(0)).alias("n_records"), F.array_join(F.array_sort(F.map_keys("provenance")), ",").alias("provenance_keys"))


@query(ctes("access_log") + " SELECT event_id, CASE WHEN purpose IS NULL THEN 'bad_request' END AS purpose_error, CASE WHEN event_id % 3 = 2 THEN 'bad_request' END AS prefer_error FROM access_log")
def validate_requests(spark, d):
    prefer = F.element_at(F.array(F.lit(" Vault"), F.lit(None), F.lit("cache")), (F.col("event_id") % 3 + 1).cast("int"))
    return view(spark, d, "access_log").select("event_id", policy.validate_purpose(F.upper("purpose"))["code"].alias("purpose_error"), policy.validate_prefer_data(prefer)["code"].alias("prefer_error"))


# ---- audit log ----------------------------------------------------------------------------------------------
DENIALS = " FROM access_log WHERE error_code = 'denied_by_policy'"


@query(ctes("access_log") + " SELECT event_id, client_id, name, ms FROM access_log WHERE client_id = 'COACH_APP' AND starts_with(name, 'health.walk') AND coalesce(purpose, '') = '' AND NOT ok AND error_code = 'upstream_error'")
def filter_audit(spark, d):
    out = audit.filter_audit(view(spark, d, "access_log"), client_id="COACH_APP", name_prefix="health.walk", purpose="", ok=False, error_code="upstream_error")
    return out.select("event_id", "client_id", "name", "ms")


@query(ctes("access_log") + " SELECT event_id, name FROM access_log WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7200 SECOND")
def lookback_events(spark, d):
    e = view(spark, d, "access_log")
    bound = audit.lookback_bound(F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 7200, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    return e.where(bound).select("event_id", "name")


@query(ctes("access_log") + " SELECT event_id, name, client_id FROM access_log ORDER BY event_id DESC LIMIT 50")
def recent_events(spark, d):
    return audit.recent_events(view(spark, d, "access_log"), 50, "event_id").select("event_id", "name", "client_id")


@query(ctes("access_log") + " SELECT event_id, name, ms FROM access_log WHERE client_id = 'AUDIT_APP' AND NOT ok ORDER BY event_id DESC LIMIT 20")
def query_events(spark, d):
    return audit.query_events(view(spark, d, "access_log"), 20, "event_id", client_id="AUDIT_APP", ok=False).select("event_id", "name", "ms")


@query(ctes("access_log") + f" SELECT client_id, name, count(*) AS n {DENIALS} GROUP BY client_id, name HAVING count(*) >= 3")
def denial_alerts(spark, d):
    return audit.denial_alerts(view(spark, d, "access_log"))


@query(
    ctes("access_log") + f""", w AS (SELECT * {DENIALS} AND client_id = 'COACH_APP' AND purpose = 'coaching' AND ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 2592000 SECOND),
 a AS (SELECT client_id, name FROM w GROUP BY client_id, name HAVING count(*) >= 3)
 SELECT client_id, name, n, event_id, corr_id FROM (SELECT w.client_id, w.name, w.event_id, w.corr_id, CAST(row_number() OVER (PARTITION BY w.client_id, w.name ORDER BY w.event_id DESC) AS INT) AS n
 FROM w JOIN a ON w.client_id = a.client_id AND w.name = a.name) AS q WHERE n <= 5"""
)
def evidence_per_tool(spark, d):
    e = view(spark, d, "access_log")
    e = audit.filter_audit(e, client_id="COACH_APP", purpose="coaching").where(audit.lookback_bound(F.col("ts"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 2592000))
    return audit.evidence_per_tool(e, audit.denial_alerts(e), order="event_id")


@query(
    ctes("access_log") + """ SELECT name AS tool, coalesce(purpose, 'unknown') AS purpose, client_id AS client, count(*) AS calls, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS ok_calls,
 CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS error_calls, max(event_id) AS last_at FROM access_log WHERE name <> 'health.telemetry.query.v1' GROUP BY 1, 2, 3"""
)
def access_summary(spark, d):
    return audit.access_summary(audit.exclude_introspection(view(spark, d, "access_log"), PREFIX, INTROSPECTION), "event_id")


@query(
    ctes("access_log") + """ SELECT tool, purpose, client, string_agg(error_code || '=' || CAST(n AS STRING), ',' ORDER BY error_code) AS errors FROM (SELECT name AS tool, coalesce(purpose, 'unknown') AS purpose,
 client_id AS client, error_code, count(*) AS n FROM access_log WHERE NOT ok AND error_code IS NOT NULL GROUP BY 1, 2, 3, 4) AS q GROUP BY 1, 2, 3"""
)
def error_histogram(spark, d):
    out = audit.error_histogram(view(spark, d, "access_log"))
    return out.withColumn("errors", F.array_join(F.array_sort(F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","))


@query(
    ctes("access_log") + """ SELECT corr_id, count(*) AS n_events, CASE WHEN count(DISTINCT layer) = 2 THEN 'gateway,sources' ELSE min(layer) END AS layers, string_agg(name, '>' ORDER BY event_id) AS steps
 FROM access_log GROUP BY corr_id"""
)
def correlate_layers(spark, d):
    out = audit.correlate_layers(view(spark, d, "access_log"), "event_id")
    return out.select("corr_id", "n_events", F.array_join("layers", ",").alias("layers"), F.array_join(F.transform("steps", lambda s: s["name"]), ">").alias("steps"))


@query(ctes("access_log") + " SELECT event_id, corr_id, name AS tool, coalesce(purpose, 'analytics') AS purpose, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status FROM access_log")
def project_trace(spark, d):
    e = view(spark, d, "access_log")
    args = F.struct(F.lit(None).cast("string").alias("purpose"), F.lit("p1").alias("policy"), F.struct(F.lit("analytics").alias("purpose")).alias("args"))
    old = e.withColumns({"tool": F.when(F.col("event_id") % 2 == 0, F.col("name")), "args": args, "status": F.lit(None).cast("string"), "policy": F.lit(None).cast("string")})
    old = old.withColumn("name", F.when(F.col("event_id") % 2 == 1, F.col("name"))).withColumn("ts", F.col("event_id"))
    return audit.project_trace(old).select(F.col("ts").alias("event_id"), "corr_id", "tool", "purpose", "status")


@query(ctes("access_log") + " SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN corr_id END, sha256(concat_ws(chr(31), CAST(event_id AS STRING), name))) AS corr_id FROM access_log")
def attach_corr_id(spark, d):
    e = view(spark, d, "access_log").withColumn("corr_id", F.when(F.col("event_id") % 2 == 0, F.col("corr_id")))
    return audit.attach_corr_id(e, "event_id", "name").select("event_id", "corr_id")


# ---- inventory ----------------------------------------------------------------------------------------------
@query(
    """SELECT event_type AS domain, count(*) AS n_records, CAST(min(CAST(ts AS DATE)) AS STRING) AS first_date, CAST(max(CAST(ts AS DATE)) AS STRING) AS last_date,
 string_agg(DISTINCT 'f' || CAST(event_id * 7 % 11 AS STRING), ',' ORDER BY 'f' || CAST(event_id * 7 % 11 AS STRING)) AS fields FROM events GROUP BY event_type"""
)
def inventory(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    raw = F.to_json(F.create_map(F.concat(F.lit("f"), F.col("event_id") * 7 % 11), F.col("value")))
    e = e.select(F.col("event_type").alias("domain"), F.to_date("ts").alias("date"), raw.alias("raw_json"))
    return store.inventory(e).select("domain", "n_records", text("first_date"), text("last_date"), F.array_join("fields", ",").alias("fields"))


@query("SELECT event_type AS domain, CASE WHEN min(event_id % 2) = 0 AND max(event_id % 2) = 1 THEN 'date,k,steps' WHEN min(event_id % 2) = 0 THEN 'k' ELSE 'date,steps' END AS fields FROM events GROUP BY event_type")
def observed_fields(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.to_json(F.struct(F.lit(1).alias("steps"), F.col("event_type").alias("date"))))
    return store.observed_fields(e.select(F.col("event_type").alias("domain"), raw.alias("raw_json"))).withColumn("fields", F.array_join("fields", ","))


# ---- connectors and sources ---------------------------------------------------------------------------------
OVERLAID = """, overlaid AS (SELECT c.user_id, c.domain, c.pos, c.connected_application, c.player_id, s.auth_bearer FROM connectors AS c LEFT JOIN secrets AS s ON c.user_id = s.user_id
 AND c.connected_application = s.connected_application AND coalesce(c.player_id, '') = coalesce(s.player_id, '')),
 resolved AS (SELECT o.user_id, o.domain, a.source, o.connected_application, o.player_id, regexp_replace(o.auth_bearer, '^Bearer ', '') AS token FROM overlaid AS o
 JOIN aliases AS a ON lower(o.connected_application) = a.alias WHERE o.player_id IS NOT NULL)"""
CONNECTED = ctes("connectors", "secrets", "aliases") + OVERLAID


def _overlaid(spark, d) -> DataFrame:
    s = view(spark, d, "secrets")
    twice = s.unionByName(s.withColumn("pos", F.lit(1)).withColumn("auth_bearer", F.lit("second")))
    return connectors.overlay_secrets(view(spark, d, "connectors"), twice)


def _resolved(spark, d) -> DataFrame:
    return connectors.resolve_connector(_overlaid(spark, d), view(spark, d, "aliases"))


@query(CONNECTED + " SELECT * FROM overlaid")
def overlay_secrets(spark, d):
    return _overlaid(spark, d)


@query(CONNECTED + " SELECT * FROM resolved")
def resolve_connector(spark, d):
    return _resolved(spark, d).drop("pos")


@query(
    CONNECTED + """ SELECT u.user_id, 'walk' AS domain, g.source, r.player_id IS NOT NULL AS configured, r.connected_application, r.player_id,
 coalesce(r.token, '') <> '' AND NOT contains(coalesce(r.token, ''), 'YOUR_') AS has_token FROM (SELECT c_custkey AS user_id FROM customer) AS u CROSS JOIN (VALUES ('arena'), ('stepcloud')) AS g(source)
 LEFT JOIN resolved AS r ON u.user_id = r.user_id AND g.source = r.source"""
)
def connector_status(spark, d):
    users = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return connectors.connector_status(users, _resolved(spark, d), [("walk", "arena"), ("walk", "stepcloud")])


@query(
    CONNECTED + """ SELECT o.o_orderkey AS request_id, CASE WHEN u.c_custkey IS NULL THEN 'unknown_user' WHEN r.user_id IS NULL THEN 'not_connected' WHEN coalesce(r.token, '') = '' THEN 'missing_token'
 WHEN o.o_custkey % 4 <> 0 THEN 'upstream_error' END AS error_code FROM (SELECT o_orderkey, o_custkey FROM orders) AS o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) AS u
 ON o.o_custkey = u.c_custkey LEFT JOIN resolved AS r ON o.o_custkey = r.user_id AND r.source = 'arena'"""
)
def classify_requests(spark, d):
    req = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), F.lit("walk").alias("domain"), F.lit("arena").alias("source"))
    users = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    data = users.where("user_id % 4 = 0").withColumn("source", F.lit("arena"))
    return connectors.classify_requests(req, users.where("user_id % 10 <> 0"), _resolved(spark, d), data).select("request_id", "error_code")


CHOICE = (
    ctes("candidates") + """, ranked AS (SELECT *, CASE WHEN source = 'vault' THEN CASE WHEN prefer_data <> 'live' THEN 1 END WHEN prefer_data <> 'vault' THEN
 CASE WHEN source = CASE WHEN coalesce(prefer, 'arena') = 'arena' THEN 'arena' ELSE 'stepcloud' END THEN 2 ELSE 3 END END AS rank, ok AND (source <> 'vault' OR n_records > 0) AS good FROM candidates),
 best AS (SELECT request_id, min(CASE WHEN good THEN rank END) AS top, max(prefer_data) AS mode FROM ranked WHERE rank IS NOT NULL GROUP BY request_id)"""
)


@query(
    CHOICE + """ SELECT b.request_id, r.source AS selected_source, CASE WHEN b.top IS NULL THEN CASE WHEN mode = 'vault' THEN 'vault_empty' ELSE 'all_sources_failed' END END AS error_code
 FROM best AS b LEFT JOIN ranked AS r ON b.request_id = r.request_id AND b.top = r.rank"""
)
def select_source(spark, d):
    return connectors.select_source(view(spark, d, "candidates"), LIVE).drop("attempts")


@query(
    CHOICE + """ SELECT b.request_id, string_agg(r.source || ':' || CASE WHEN good THEN 'ok' ELSE 'failed' END, '>' ORDER BY r.rank) AS attempts FROM best AS b
 JOIN ranked AS r ON b.request_id = r.request_id AND r.rank IS NOT NULL AND (b.top IS NULL OR r.rank <= b.top) GROUP BY b.request_id"""
)
def attempt_trace(spark, d):
    c = view(spark, d, "candidates")
    chosen = connectors.select_source(c, LIVE).select("request_id", F.explode("attempts").alias("a")).select("request_id", "a.*")
    out = connectors.attempt_trace(chosen)
    return out.select("request_id", F.array_join(F.transform("attempts", lambda a: F.concat(a["source"], F.lit(":"), F.when(a["ok"], "ok").otherwise("failed"))), ">").alias("attempts"))


# ---- games --------------------------------------------------------------------------------------------------
CARRIED = ctes("answers") + """, g AS (SELECT *, CASE WHEN k = 'THROUGH_HINT' THEN v END AS hint, sum(CASE WHEN k = 'THROUGH_HINT' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, date ORDER BY pos) AS grp FROM answers),
 h AS (SELECT *, max(hint) OVER (PARTITION BY user_id, date, grp) AS carried FROM g),
 counts AS (SELECT user_id, CAST(sum(CASE WHEN hint = 'true' THEN 1 ELSE 0 END) AS BIGINT) AS hint_true, CAST(sum(CASE WHEN hint = 'false' THEN 1 ELSE 0 END) AS BIGINT) AS hint_false,
 CAST(sum(CASE WHEN k = 'QUESTION_CORRECT' AND carried = 'false' AND v = 'true' THEN 1 ELSE 0 END) AS BIGINT) AS correct,
 CAST(sum(CASE WHEN k = 'QUESTION_CORRECT' AND carried = 'false' AND v = 'false' THEN 1 ELSE 0 END) AS BIGINT) AS incorrect FROM h GROUP BY user_id)"""
RATES = CARRIED + """, rates AS (SELECT user_id, CASE WHEN hint_true + hint_false > 0 THEN hint_true / (hint_true + hint_false) ELSE 0 END AS avg_hint,
 CASE WHEN hint_false > 0 THEN correct / hint_false ELSE 0 END AS avg_correct, CASE WHEN hint_false > 0 THEN incorrect / hint_false ELSE 0 END AS avg_incorrect FROM counts)"""
OVERVIEW = """, overview AS (SELECT user_id, coalesce(avg(score), 0) AS avg_score, coalesce(stddev_pop(score), 0) AS sd_score, coalesce(avg(playtime), 0) AS avg_playtime, coalesce(stddev_pop(playtime), 0) AS sd_playtime,
 coalesce(avg(days), 0) AS avg_days, coalesce(stddev_pop(days), 0) AS sd_days, CAST(sum(home) AS BIGINT) AS total_home_path, CAST(sum(outdoors) AS BIGINT) AS total_outdoors_path, CAST(sum(work) AS BIGINT) AS total_work_path,
 avg(accuracy) AS avg_accuracy, sum(hospital_turns) / count(*) AS trips_per_game, coalesce(avg(response), 0) AS avg_response FROM plays GROUP BY user_id)"""


def _quiz(spark, d) -> DataFrame:
    a = view(spark, d, "answers")
    prop = F.struct("pos", F.struct(F.col("k").alias("translationKey")).alias("property"), F.col("v").alias("value"))
    return a.groupBy("user_id", "date").agg(F.array_sort(F.collect_list(prop)).alias("propertyInstances"))


def _overview(spark, d) -> DataFrame:
    plays = view(spark, d, "plays")
    return games.game_overview(plays, plays)


@query(CARRIED + " SELECT * FROM counts")
def trivia_counts(spark, d):
    return games.trivia_counts(_quiz(spark, d))


@query(CARRIED + " SELECT user_id, pos, carried FROM h")
def carry_hint(spark, d):
    a = view(spark, d, "answers").withColumns({"activity": F.concat_ws("/", "user_id", F.col("date").cast("string")), "hint": F.when(F.col("k") == games.HINT, F.col("v"))})
    return games.carry_hint(a).select("user_id", "pos", "carried")


@query(RATES + " SELECT user_id, round(avg_hint, 6) AS avg_hint, round(avg_correct, 6) AS avg_correct, round(avg_incorrect, 6) AS avg_incorrect FROM rates")
def trivia_rates(spark, d):
    out = games.trivia_rates(games.trivia_counts(_quiz(spark, d)))
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in games.TRIVIA])


@query(
    ctes("game_turns") + """, s AS (SELECT user_id, date, pos, minutes, row_number() OVER (PARTITION BY user_id, date ORDER BY pos) AS k, count(*) OVER (PARTITION BY user_id, date) AS n FROM game_turns),
 e AS (SELECT user_id, date, k * 2 AS ord, n, minutes AS v FROM s WHERE k = 1 UNION ALL SELECT user_id, date, k * 2 + 1, n, minutes * 2 FROM s WHERE k > 1 OR minutes <> 0),
 l AS (SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY ord DESC) AS back FROM e)
 SELECT user_id, CAST(date AS STRING) AS date, coalesce(string_agg(CASE WHEN NOT (back = 1 AND v = 0) THEN CAST(v AS STRING) END, ',' ORDER BY ord), '') AS series FROM l GROUP BY user_id, date"""
)
def turn_series(spark, d):
    t = view(spark, d, "game_turns").groupBy("user_id", "date").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("minutes").alias("a"), (F.col("minutes") * 2).alias("b")))).alias("turns"))
    return t.select("user_id", text("date"), F.array_join(games.turn_series(F.col("turns"), "a", "b"), ",").alias("series"))


CRITICAL = ctes("game_turns") + """, f AS (SELECT user_id, date, min(pos) AS red FROM game_turns WHERE glucose BETWEEN 0 AND 2.6 OR glucose BETWEEN 15 AND 20 GROUP BY user_id, date),
 g AS (SELECT t.user_id, t.date, f.red, min(t.pos) AS green FROM game_turns AS t JOIN f ON t.user_id = f.user_id AND t.date = f.date AND t.pos > f.red WHERE t.glucose BETWEEN 4.5 AND 8 GROUP BY t.user_id, t.date, f.red)
 SELECT g.user_id, CAST(g.date AS STRING) AS date, b.minutes - a.minutes AS response_minutes FROM g JOIN game_turns AS a ON a.pos = g.red JOIN game_turns AS b ON b.pos = g.green WHERE b.minutes - a.minutes > 0"""


@query(CRITICAL)
def critical_response(spark, d):
    t = view(spark, d, "game_turns").groupBy("user_id", "date").agg(F.array_sort(F.collect_list(F.struct("pos", "glucose", "minutes"))).alias("t"))
    wait = games.critical_response(F.col("t.glucose"), F.col("t.minutes"))
    return t.select("user_id", text("date"), wait.alias("response_minutes")).where("response_minutes IS NOT NULL")


@query(CRITICAL)
def critical_response_rows(spark, d):
    return games.critical_response_rows(view(spark, d, "game_turns"), "user_id", "date").withColumn("date", F.col("date").cast("string"))


@query(
    ctes("plays") + OVERVIEW + " SELECT user_id, " + ", ".join(f"round({c}, 6) AS {c}" if not c.startswith("total") else c for c in (*games.PT, *games.GAME)) + " FROM overview"
)
def game_overview(spark, d):
    return _overview(spark, d).select("user_id", *[F.round(c, 6).alias(c) if not c.startswith("total") else F.col(c) for c in (*games.PT, *games.GAME)])


@query(
    """SELECT user_id, event_type, event_id AS latest_id, day AS latest_at FROM (SELECT user_id, event_type, event_id, CAST(CAST(ts AS DATE) AS STRING) AS day,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE) DESC, event_id) AS k FROM events) AS q WHERE k = 1"""
)
def latest_activity(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", F.col("event_id").alias("id"), F.to_date("ts").alias("date"), F.col("event_id").alias("pos"))
    return games.latest_activity(e, "user_id", "event_type").withColumn("latest_at", F.col("latest_at").cast("string"))


def _scaled_sql(names) -> str:
    low, high = f"least({', '.join(names)})", f"greatest({', '.join(names)})"
    return ", ".join(f"CASE WHEN {high} = {low} THEN 0 ELSE ({c} - {low}) / ({high} - {low}) END AS {c}" for c in names)


@query(ctes("plays") + OVERVIEW + f", m AS (SELECT user_id, {_scaled_sql(games.PT)} FROM overview) SELECT user_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in games.PT) + " FROM m")
def minmax_row(spark, d):
    scaled = S.minmax_row({c: F.col(c) for c in games.PT})
    return _overview(spark, d).select("user_id", *[F.round(v, 6).alias(c) for c, v in scaled.items()])


BOTH = RATES + f", plays AS ({{plays}}){OVERVIEW}"
_plays = ctes("plays")[len("WITH plays AS (") : -1]


@query(
    BOTH.replace("{plays}", _plays) + f""", t AS (SELECT user_id, {_scaled_sql(games.TRIVIA)} FROM rates), gm AS (SELECT user_id, {_scaled_sql(games.GAME)} FROM overview),
 s AS (SELECT t.user_id, -0.15 * avg_hint + avg_correct - 0.85 * avg_incorrect AS a, 0.15 * avg_response - trips_per_game + 0.85 * avg_accuracy AS b FROM t JOIN gm ON t.user_id = gm.user_id)
 SELECT user_id, round(a, 6) AS trivia_score, round(b, 6) AS game_score, round(0.6 * a + 0.4 * b, 6) AS final_score FROM s"""
)
def literacy_scores(spark, d):
    both = games.join_domains(games.trivia_rates(games.trivia_counts(_quiz(spark, d))), _overview(spark, d))
    return games.literacy_scores(both).select("user_id", *[F.round(c, 6).alias(c) for c in ("trivia_score", "game_score", "final_score")])


@query(
    ctes("plays") + OVERVIEW + f""", m AS (SELECT user_id, {_scaled_sql(games.PT)} FROM overview) SELECT user_id, round(0.5 * total_home_path + 0.5 * total_outdoors_path, 6) AS socializer,
 round(0.3 * avg_score + 0.05 * sd_score, 6) AS competitive, round(0.3 * avg_playtime + 0.15 * avg_days, 6) AS explorer FROM m"""
)
def player_types(spark, d):
    return games.player_types(_overview(spark, d)).select("user_id", *[F.round(c, 6).alias(c) for c in S.PLAYER_TYPES])


@query(
    """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(floor(value) AS BIGINT) ELSE -1 END AS score, CAST(event_id % 9 AS BIGINT) AS days, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS home,
 CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS outdoors, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS work FROM events"""
)
def playthrough_metrics(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    prop = lambda key, value: F.struct(F.struct(F.lit(key).alias("translationKey"), F.lit(None).cast("string").alias("baseUnit")).alias("property"), value.cast("string").alias("value"))
    turn = lambda kind: F.struct(kind.cast("int").alias("DestinationPathType"))
    turns = F.to_json(F.struct(F.array(turn(F.lit(1)), turn(F.col("event_id") % 3 + 1)).alias("Turns")))
    score = F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.floor("value").cast("string"))
    raw = e.select(F.col("event_id").alias("user_id"), F.array(prop("SCORE", score), prop("DAYS_PLAYED", F.col("event_id") % 9), prop("PLAYTHROUGH_DATA", turns)).alias("propertyInstances"))
    return games.playthrough_metrics(raw).select(F.col("user_id").alias("event_id"), F.coalesce("score", F.lit(-1)).alias("score"), "days", "home", "outdoors", "work")


@query(
    """SELECT event_id, CAST(floor(value) AS BIGINT) AS first_score, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS hospital_turns, CASE WHEN event_id % 3 = 0 THEN '1.0,2.0,5.0' ELSE '1.0,' || CAST(event_id % 3 + 4 AS STRING) || '.0' END AS glucose,
 concat('0.0,10.0,', CAST(event_id % 50 + 11 AS STRING), '.0') AS minutes FROM events
 WHERE event_id % 4 <> 0 AND floor(value) <> 0"""
)
def engagement_sessions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id")

    def turn(score, hospital, glucose, minutes):
        names = ("Score", "IsHospitalised", "GlucoseValueStart", "GlucoseValueEnd", "MinutesStart", "MinutesEnd")
        return F.struct(*[v.alias(n) for n, v in zip(names, (score.cast("double"), hospital, *[x if isinstance(x, type(score)) else F.lit(x) for x in (*glucose, *minutes)]))])

    turns = F.array(turn(F.floor("value"), k % 2 == 0, (1.0, F.when(k % 3 == 0, 2.0).otherwise(0.0)), (0.0, 10.0)), turn(F.lit(0), F.lit(True), (0.0, F.when(k % 3 == 0, 5.0).otherwise((k % 3 + 4).cast("double"))), (10.0, (k % 50 + 11).cast("double"))))
    play = F.to_json(F.struct((k % 4 == 0).alias("Aborted"), turns.alias("Turns")))
    log = F.to_json(F.struct(F.array(F.struct(F.array(play).alias("Values"))).alias("GameplayData")))
    prop = F.struct(F.struct(F.lit("ENGAGEMENT_DATA").alias("translationKey"), F.lit(None).cast("string").alias("baseUnit")).alias("property"), log.alias("value"))
    out = games.engagement_sessions(e.select(k.alias("user_id"), k.alias("id"), F.array(prop).alias("propertyInstances")))
    return out.select(F.col("id").alias("event_id"), F.col("scores")[0].cast("bigint").alias("first_score"), "hospital_turns", F.array_join("glucose", ",").alias("glucose"), F.array_join("minutes", ",").alias("minutes"))


@query(
    ctes("game_turns") + """ SELECT pos, CASE WHEN glucose BETWEEN 0 AND 2.6 OR glucose BETWEEN 15 AND 20 THEN 'red' WHEN glucose BETWEEN 4.5 AND 8 THEN 'green' ELSE 'other' END AS colour FROM game_turns"""
)
def glucose_colour(spark, d):
    return view(spark, d, "game_turns").select("pos", S.glucose_colour(F.col("glucose")).alias("colour"))


@query(
    ctes("connectors") + """ SELECT o_orderkey AS request_id, coalesce(connected_application, 'Unknown') AS connected_application, player_id FROM orders
 LEFT JOIN (SELECT * FROM connectors WHERE user_id % 3 = 0) AS c ON o_custkey = c.user_id"""
)
def primary_app_info(spark, d):
    req = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), F.lit("walk").alias("domain"))
    return connectors.primary_app_info(req, view(spark, d, "connectors").where("user_id % 3 = 0")).select("request_id", "connected_application", "player_id")


# ---- jobs ---------------------------------------------------------------------------------------------------
def _job_requests(spark, d) -> tuple[DataFrame, DataFrame]:
    """Each access-log request as one row, and what the sources hold for it."""
    r = view(spark, d, "requests").withColumn("request_id", F.concat_ws("/", "user_id", "client", "purpose", "tool"))
    r = r.withColumns({"prefer": F.when(F.col("user_id") % 2 == 0, "arena").otherwise("stepcloud"), "prefer_data": F.lit("live"), "start": F.lit("2024-01-05").cast("date"), "end": F.lit("2024-01-25").cast("date")})
    sources = F.array(*[F.struct(F.lit(s).alias("source"), (F.col("user_id") % m != 0).alias("ok")) for s, m in (("arena", 3), ("stepcloud", 4))])
    c = r.select("request_id", F.explode(sources).alias("s")).select("request_id", "s.*", F.lit(1).alias("n_records"), F.lit("upstream_error").alias("error_code"))
    return r, c


def _job_records(spark, d) -> DataFrame:
    a = store.last_write_wins(view(spark, d, "activity"))
    return a.select("source", "user_id", "date", "steps", (F.col("steps") / 20).alias("kcalories"), F.concat(F.lit("p"), "user_id").alias("player_id"))


JOB = (
    POLICY.replace("WITH requests", "WITH activity AS (" + ctes("activity")[len("WITH activity AS (") : -1] + "), requests") + f""",
 day AS (SELECT * FROM {LWW} AS q WHERE n = 1),
 pick AS (SELECT *, CASE WHEN lower(trim(purpose)) NOT IN ('analytics', 'coaching', 'modeling') THEN 'bad_request' WHEN NOT allow THEN 'denied_by_policy' END AS early,
 CASE WHEN user_id % 2 = 0 THEN CASE WHEN user_id % 3 <> 0 THEN 'arena' WHEN user_id % 4 <> 0 THEN 'stepcloud' END
 ELSE CASE WHEN user_id % 4 <> 0 THEN 'stepcloud' WHEN user_id % 3 <> 0 THEN 'arena' END END AS pick FROM resolved)"""
)


@query(
    JOB + """, hits AS (SELECT p.user_id, p.client, p.purpose, p.tool, count(a.steps) AS n, coalesce(CAST(sum(a.steps) AS BIGINT), 0) AS total FROM pick AS p LEFT JOIN day AS a
 ON p.user_id = a.user_id AND p.pick = a.source AND a.date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND p.early IS NULL AND lower(trim(p.purpose)) <> 'modeling' GROUP BY 1, 2, 3, 4)
 SELECT p.user_id, p.client, p.purpose, p.tool, CASE WHEN early IS NOT NULL THEN early WHEN pick IS NULL THEN 'all_sources_failed' WHEN lower(trim(p.purpose)) = 'modeling' THEN 'not_supported' END AS error_code,
 CASE WHEN early IS NULL THEN pick END AS selected_source, h.n AS n_records, h.total AS total_steps FROM pick AS p
 JOIN hits AS h ON p.user_id = h.user_id AND p.client = h.client AND p.purpose = h.purpose AND p.tool = h.tool"""
)
def fetch_walk_batch(spark, d):
    r, c = _job_requests(spark, d)
    out = jobs.fetch_walk_batch(r, view(spark, d, "rules"), c, _job_records(spark, d), live=LIVE)
    total = F.coalesce(F.aggregate("records", F.lit(0).cast("bigint"), lambda a, x: a + x["steps"]), F.lit(0))
    return out.select("user_id", "client", "purpose", "tool", F.col("error.code").alias("error_code"), "selected_source", F.coalesce(F.size("records"), F.lit(0)).cast("bigint").alias("n_records"), total.alias("total_steps"))


@query(
    JOB + """, ask AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN lower(trim(purpose)) <> 'modeling' THEN 'bad_request' WHEN pick IS NULL THEN 'all_sources_failed' END AS error_code FROM pick)
 SELECT p.user_id, p.client, p.purpose, p.tool, p.error_code, CASE WHEN p.error_code IS NULL THEN count(a.steps) END AS days, CASE WHEN p.error_code IS NULL THEN coalesce(CAST(sum(a.steps) AS BIGINT), 0) END AS total_steps,
 CASE WHEN p.error_code IS NULL THEN coalesce(CAST(floor(sum(a.steps) / count(a.steps)) AS BIGINT), 0) END AS avg_steps, min(a.steps) AS min_steps, max(a.steps) AS max_steps,
 CASE WHEN p.error_code IS NULL THEN p.pick END AS source FROM ask AS p LEFT JOIN day AS a ON p.user_id = a.user_id AND p.pick = a.source AND p.error_code IS NULL
 AND a.date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1, 2, 3, 4, 5, p.pick"""
)
def walk_features_batch(spark, d):
    r, c = _job_requests(spark, d)
    out = jobs.walk_features_batch(r, view(spark, d, "rules"), c, _job_records(spark, d), live=LIVE)
    return out.select("user_id", "client", "purpose", "tool", F.col("error.code").alias("error_code"), "days", "total_steps", "avg_steps", "min_steps", "max_steps", F.col("provenance")["source"].alias("source"))


@query(
    JOB + f""", ask AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 4 END AS page, user_id % 3 AS skip FROM pick WHERE early IS NULL AND pick IS NOT NULL AND lower(trim(purpose)) <> 'modeling'),
 hits AS (SELECT p.*, a.steps, row_number() OVER (PARTITION BY p.user_id, p.client, p.purpose, p.tool ORDER BY a.date) AS n FROM ask AS p JOIN day AS a ON p.user_id = a.user_id AND p.pick = a.source
  AND a.date >= CASE WHEN p.user_id % 2 = 0 THEN DATE '{AS_OF}' - INTERVAL 365 DAY ELSE DATE '2024-01-10' END AND a.date <= DATE '{AS_OF}'),
 cut AS (SELECT user_id, client, purpose, tool, count(*) AS n_records, CAST(sum(steps) AS BIGINT) AS total_steps FROM hits WHERE n > skip AND (page IS NULL OR n <= skip + page) GROUP BY 1, 2, 3, 4)
 SELECT p.user_id, p.client, p.purpose, p.tool, coalesce(c.n_records, 0) AS n_records, coalesce(c.total_steps, 0) AS total_steps FROM ask AS p
 LEFT JOIN cut AS c ON p.user_id = c.user_id AND p.client = c.client AND p.purpose = c.purpose AND p.tool = c.tool"""
)
def fetch_pages(spark, d):
    """Pages of records: open windows take the last year, limits may be open or zero."""
    r, c = _job_requests(spark, d)
    u = F.col("user_id")
    r = r.withColumns({"start": F.when(u % 2 != 0, F.lit("2024-01-10").cast("date")), "end": F.lit(None).cast("date"), "limit": F.when(u % 3 != 0, (u % 4).cast("int")), "offset": (u % 3).cast("int")})
    out = jobs.fetch_walk_batch(r, view(spark, d, "rules"), c, _job_records(spark, d), live=LIVE, as_of=AS_OF).where("error IS NULL")
    total = F.aggregate("records", F.lit(0).cast("bigint"), lambda a, x: a + x["steps"])
    return out.select("user_id", "client", "purpose", "tool", F.size("records").cast("bigint").alias("n_records"), total.alias("total_steps"))


CHAIN = (
    ctes("activity", "requests", "rules", "connectors", "secrets", "aliases") + RESOLVED + OVERLAID.replace("resolved", "linked") + f""",
 day AS (SELECT * FROM {LWW} AS q WHERE n = 1), stored AS (SELECT * FROM day WHERE inserted_at % 2 = 0),
 asked AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'arena' ELSE 'stepcloud' END AS prefer, CASE user_id % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'vault' ELSE 'auto' END AS mode,
  CASE WHEN lower(trim(purpose)) NOT IN ('analytics', 'coaching', 'modeling') THEN 'bad_request' WHEN NOT allow THEN 'denied_by_policy' END AS early FROM resolved),
 answers AS (SELECT u.user_id, s.source, CASE WHEN c.c_custkey IS NULL OR u.user_id % 10 = 0 OR coalesce(l.token, '') = '' THEN false ELSE EXISTS (SELECT 1 FROM day AS a WHERE a.user_id = u.user_id AND a.source = s.source) END AS ok
  FROM (SELECT DISTINCT user_id FROM requests) AS u CROSS JOIN (VALUES ('arena'), ('stepcloud')) AS s(source) LEFT JOIN customer AS c ON c.c_custkey = u.user_id LEFT JOIN linked AS l ON l.user_id = u.user_id AND l.source = s.source),
 kept AS (SELECT user_id, prefer, date, steps FROM (SELECT a.user_id, p.prefer, a.date, a.steps, row_number() OVER (PARTITION BY a.user_id, p.prefer, a.date ORDER BY CASE WHEN a.source = p.prefer THEN 0 ELSE 1 END, a.inserted_at DESC, a.source) AS k
  FROM stored AS a CROSS JOIN (VALUES ('arena'), ('stepcloud')) AS p(prefer) WHERE a.date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25') AS q WHERE k = 1),
 chosen AS (SELECT r.*, CASE WHEN mode <> 'live' AND EXISTS (SELECT 1 FROM kept AS k WHERE k.user_id = r.user_id) THEN 'vault' WHEN mode = 'vault' THEN NULL WHEN p.ok THEN r.prefer WHEN o.ok THEN o.source END AS pick
  FROM asked AS r JOIN answers AS p ON p.user_id = r.user_id AND p.source = r.prefer JOIN answers AS o ON o.user_id = r.user_id AND o.source <> r.prefer),
 given AS (SELECT user_id, prefer, 'vault' AS source, date, steps FROM kept UNION ALL SELECT user_id, prefer, source, date, steps FROM day CROSS JOIN (VALUES ('arena'), ('stepcloud')) AS p(prefer)
  WHERE source <> 'manual' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25')"""
)


@query(
    CHAIN + """ SELECT c.user_id, c.client, c.purpose, c.tool, CASE WHEN early IS NOT NULL THEN early WHEN pick IS NULL THEN CASE mode WHEN 'vault' THEN 'vault_empty' ELSE 'all_sources_failed' END
 WHEN lower(trim(c.purpose)) = 'modeling' THEN 'not_supported' END AS error_code, CASE WHEN early IS NULL THEN pick END AS selected_source, count(g.steps) AS n_records, coalesce(CAST(sum(g.steps) AS BIGINT), 0) AS total_steps
 FROM chosen AS c LEFT JOIN given AS g ON g.user_id = c.user_id AND g.prefer = c.prefer AND g.source = c.pick AND c.early IS NULL AND lower(trim(c.purpose)) <> 'modeling' GROUP BY c.user_id, c.client, c.purpose, c.tool, early, pick, mode"""
)
def fetch_walk(spark, d):
    """Policy, connectors, store and live sources in one chain."""
    u = F.col("user_id")
    r = _job_requests(spark, d)[0].withColumn("prefer_data", F.when(u % 4 == 0, "live").when(u % 4 == 1, "vault").otherwise("auto"))
    day = store.last_write_wins(view(spark, d, "activity")).withColumn("kcalories", F.col("steps") / 20)
    live = day.where(F.col("source").isin(*LIVE)).select("source", "user_id", "date", "steps", "kcalories", F.concat(F.lit("p"), "user_id").alias("player_id"))
    users = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id")).where("user_id % 10 <> 0")
    out = jobs.fetch_walk(r, view(spark, d, "rules"), users, _resolved(spark, d), live, day.where("inserted_at % 2 = 0"), live=LIVE)
    total = F.coalesce(F.aggregate("records", F.lit(0).cast("bigint"), lambda a, x: a + x["steps"]), F.lit(0))
    return out.select("user_id", "client", "purpose", "tool", F.col("error.code").alias("error_code"), "selected_source", F.coalesce(F.size("records"), F.lit(0)).cast("bigint").alias("n_records"), total.alias("total_steps"))


@query(
    JOB.replace("requests AS (", "reqs AS (", 1).replace(", rules AS", ", requests AS (SELECT r.user_id, r.client, r.tool, r.purpose AS base, p.purpose FROM reqs AS r CROSS JOIN (VALUES ('analytics'), ('modeling'), ('coaching')) AS p(purpose)), rules AS", 1)
    .replace("SELECT r.user_id, r.client, r.purpose, r.tool, coalesce(t.allow", "SELECT r.user_id, r.client, r.purpose, r.base, r.tool, coalesce(t.allow", 1)
    + """ SELECT concat_ws('/', CAST(user_id AS STRING), client, base, tool) AS request_id, purpose, CASE WHEN early IS NOT NULL THEN early WHEN pick IS NULL THEN 'all_sources_failed' WHEN purpose = 'modeling' THEN 'not_supported' END AS error_code,
 CASE WHEN early IS NULL AND pick IS NOT NULL AND purpose <> 'modeling' THEN CASE purpose WHEN 'coaching' THEN 'player_id,source' ELSE 'source' END END AS provenance_keys FROM pick"""
)
def privacy_lanes(spark, d):
    r, c = _job_requests(spark, d)
    out = jobs.privacy_lanes(r, view(spark, d, "rules"), c, _job_records(spark, d), live=LIVE)
    return out.select("request_id", "purpose", "error_code", F.array_join("provenance_keys", ",").alias("provenance_keys"))


WATCHED = f"{DENIALS} AND client_id = 'AUDIT_APP' AND purpose = 'coaching' AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 2592000 SECOND"


@query(
    ctes("access_log") + f""", d AS (SELECT name, event_id, corr_id, row_number() OVER (PARTITION BY name ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY name) AS n {WATCHED})
 SELECT 'alert' AS part, name, max(n) AS n, CAST(NULL AS STRING) AS corr_id FROM d WHERE n >= 3 GROUP BY name UNION ALL SELECT 'evidence', name, k, corr_id FROM d WHERE n >= 3 AND k <= 5"""
)
def guardian(spark, d):
    """Alerts, and beside them the last denied calls of each alerting tool."""
    log = view(spark, d, "access_log")
    alerts, evidence = jobs.guardian(log, client_id="AUDIT_APP", purpose="coaching", as_of="2024-01-31 00:00:00", lookback_s=2592000)
    shown = alerts.select(F.lit("alert").alias("part"), "name", "n", F.lit(None).cast("string").alias("corr_id"))
    return shown.unionByName(evidence.select(F.lit("evidence").alias("part"), "name", F.col("n").cast("bigint").alias("n"), "corr_id"))


@query(ctes("access_log") + " SELECT event_id, name AS tool, ms FROM access_log WHERE corr_id = 'c17' ORDER BY event_id DESC LIMIT 12")
def trace_report(spark, d):
    none = F.lit(None).cast("string")
    args = F.struct(none.alias("purpose"), none.alias("policy"), F.struct(none.alias("purpose")).alias("args"))
    e = view(spark, d, "access_log").withColumns({"ts": F.col("event_id"), "tool": none, "args": args, "status": none, "policy": none})
    return jobs.trace_report(e, "c17").select(F.col("ts").alias("event_id"), "tool", "ms")


# ---- streams ------------------------------------------------------------------------------------------------
def _stream(spark, d) -> DataFrame:
    """The access log as a stream over the events file."""
    from paceledger.plans.views import ACCESS_LOG

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return spark.sql(ACCESS_LOG, events=events)


def _landed(spark, d, name: str, parts: list, rows=None) -> tuple[DataFrame, str]:
    """(stream of one part a micro-batch, its folder): rows of the access log, landed part by part."""
    rows = view(spark, d, "access_log") if rows is None else rows
    path = f"{streams.folders(spark)}_{name}"
    files = streams.land(rows, parts, path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path), path


@query(
    ctes("access_log") + """, w AS (SELECT epoch_us(ts) AS us, client_id, name, unnest(range(0, 12)) AS k FROM access_log WHERE error_code = 'denied_by_policy'),
 b AS (SELECT CAST(us - us % 300000000 - k * 300000000 AS BIGINT) AS window_start, us, client_id, name FROM w)
 SELECT window_start, client_id, name, count(*) AS n FROM b WHERE us < window_start + 3600000000 GROUP BY 1, 2, 3 HAVING count(*) >= 3"""
)
def stream_denials(spark, d):
    """Alerts in update mode over four micro-batches, those of windows that are still open included; each alert's last state."""
    days = F.dayofmonth("ts")
    events, _ = _landed(spark, d, "denials", [days <= 8, (days > 8) & (days <= 16), (days > 16) & (days <= 24), days > 24])
    changes = streams.run_to_end(streams.stream_denials(events), "update")
    return streams.merged(changes, "window_start", "client_id", "name")


LATE_BATCHES = """, b AS (SELECT *, CASE WHEN event_id % 10 = 3 THEN 2 WHEN extract(day FROM ts) <= 10 THEN 0 WHEN extract(day FROM ts) <= 20 THEN 1 ELSE 3 END AS batch FROM access_log),
 m AS (SELECT batch, max(ts) AS top FROM b GROUP BY batch), h AS (SELECT b.*, (SELECT max(top) FROM m WHERE m.batch < b.batch) AS newest FROM b),
 r AS (SELECT *, coalesce(ts < newest - INTERVAL 600 SECOND, false) AS late FROM h)"""


@query(
    ctes("access_log") + LATE_BATCHES + """ SELECT CAST(batch AS BIGINT) AS batch, name, sum(CASE WHEN late THEN 0 ELSE 1 END)::BIGINT AS on_time, sum(CASE WHEN late THEN 1 ELSE 0 END)::BIGINT AS late,
 sum(CASE WHEN late THEN event_id ELSE 0 END)::BIGINT AS late_ids FROM r GROUP BY 1, 2"""
)
def stream_late_rows(spark, d):
    """A tenth of the log comes after its time: four micro-batches, every row on time or in quarantine, by batch and tool."""
    late, day = F.col("event_id") % 10 == 3, F.dayofmonth("ts")
    rows, path = _landed(spark, d, "late", [~late & (day <= 10), ~late & (day > 10) & (day <= 20), late, ~late & (day > 20)])
    out = f"{path}_routed"
    streams.route_late(rows, out, f"{out}_checkpoint").start().awaitTermination()
    kept, gone = streams.read_routed(spark, out, rows.schema)
    both = kept.withColumn("late", F.lit(False)).unionByName(gone.withColumn("late", F.lit(True)))
    return both.groupBy("batch", "name").agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"), F.sum(F.when(F.col("late"), F.col("event_id")).otherwise(0)).alias("late_ids"))


@query(
    ctes("access_log") + """, c AS (SELECT *, CAST(floor(event_id / 4) AS BIGINT) AS k FROM access_log), g AS (SELECT * FROM c WHERE layer = 'gateway' AND k % 7 > 0), s AS (SELECT * FROM c WHERE layer = 'sources' AND k % 5 > 0)
 SELECT coalesce(g.corr_id, s.corr_id) AS corr_id, g.event_id AS gateway_id, s.event_id AS source_id, g.name AS gateway_tool FROM g FULL JOIN s ON g.corr_id = s.corr_id
 AND s.ts BETWEEN g.ts - INTERVAL 5 MINUTE AND g.ts + INTERVAL 5 MINUTE"""
)
def stream_correlate(spark, d):
    """Two layers as streams, some requests without the other layer; an event of each layer a month later closes them all."""
    log = view(spark, d, "access_log")
    k = F.floor(F.col("event_id") / 4)
    end = log.limit(1).withColumns({"ts": F.lit("2034-01-01 00:00:00").cast("timestamp_ntz"), "corr_id": F.lit("end")})
    sides = []
    for layer, kept in (("gateway", k % 7 > 0), ("sources", k % 5 > 0)):
        rows = log.where((F.col("layer") == layer) & kept).unionByName(end)
        sides.append(_landed(spark, d, layer, [F.col("corr_id") != "end", F.col("corr_id") == "end"], rows)[0])
    out = streams.run_to_end(streams.stream_correlate(*sides, within="5 MINUTES"), "append").where("corr_id <> 'end'")
    return out.select("corr_id", F.col("gateway.event_id").alias("gateway_id"), F.col("sources.event_id").alias("source_id"), F.col("gateway.name").alias("gateway_tool"))


@query(ctes("access_log") + " SELECT CAST(epoch_us(ts) - epoch_us(ts) % 3600000000 AS BIGINT) AS window_start, name, client_id, count(*) AS calls, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS ok_calls FROM access_log WHERE epoch_us(ts) - epoch_us(ts) % 3600000000 + 3600000000 <= (SELECT max(epoch_us(ts)) FROM access_log) - 600000000 GROUP BY 1, 2, 3")
def stream_access_counts(spark, d):
    return streams.run_to_end(streams.stream_access_counts(_stream(spark, d)), "append")


@query(
    ctes("access_log") + """, g AS (SELECT corr_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY corr_id ORDER BY ts) <= 600000000 THEN 0 ELSE 1 END AS new FROM access_log),
 s AS (SELECT corr_id, us, sum(new) OVER (PARTITION BY corr_id ORDER BY us) AS k FROM g) SELECT CAST(min(us) AS BIGINT) AS session_start, corr_id, count(*) AS n_events FROM s GROUP BY corr_id, k
 HAVING max(us) + 600000000 <= (SELECT max(us) FROM s) - 600000000"""
)
def stream_trace_sessions(spark, d):
    return streams.run_to_end(streams.stream_trace_sessions(_stream(spark, d), "10 minutes"), "append")


@query(ctes("access_log") + " SELECT DISTINCT corr_id, CAST(floor(event_id / 4) AS BIGINT) AS trace, client_id IS NOT NULL AS whole FROM access_log")
def stream_dedup(spark, d):
    deduped = streams.stream_dedup(_stream(spark, d), "corr_id", late="40 days")
    return streams.run_to_end(deduped.select("corr_id", F.floor(F.col("event_id") / 4).cast("bigint").alias("trace"), F.col("client_id").isNotNull().alias("whole")), "append")


@query(ctes("access_log") + f" SELECT event_id, substr(sha256(concat('{SALT}:', CAST(user_id AS STRING))), 1, 16) AS subject_hash, '{R.TOKEN}' AS user_id FROM access_log")
def stream_redact(spark, d):
    s = _stream(spark, d).withColumns({"subject_hash": F.lit(None).cast("string"), "args": F.struct(F.col("user_id").cast("string").alias("user_id"), F.struct(F.lit(None).cast("string").alias("user_id")).alias("args"))})
    out = streams.stream_redact(s.select("event_id", "subject_hash", "args"), SALT)
    return streams.run_to_end(out.select("event_id", "subject_hash", F.col("args.user_id").alias("user_id")), "append")


@query(
    ctes("access_log") + """, m AS (SELECT user_id, max(CASE WHEN event_id % 3 = 0 THEN event_id ELSE -1 END) AS a, max(CASE WHEN event_id % 3 = 1 THEN event_id ELSE -1 END) AS b,
  max(CASE WHEN event_id % 3 = 2 THEN event_id ELSE -1 END) AS c FROM access_log GROUP BY user_id)
 SELECT user_id, greatest(a, b, c) AS latest_event_id, CAST(CASE WHEN a >= 0 THEN 1 ELSE 0 END + CASE WHEN b > a THEN 1 ELSE 0 END + CASE WHEN c > greatest(a, b) THEN 1 ELSE 0 END AS BIGINT) AS changes FROM m"""
)
def stream_latest(spark, d):
    """The newest event of each user, from three micro-batches that cover the same days: a row per change, the last one counts."""
    part = F.col("event_id") % 3
    rows, _ = _landed(spark, d, "latest", [part == k for k in range(3)])
    changes = streams.run_to_end(streams.stream_latest(rows, "user_id", "ts", "event_id", ttl=60 * 86400, late="40 days"), "update")
    return streams.merged(changes, "user_id").select("user_id", F.col("latest_event_id"), "changes")
