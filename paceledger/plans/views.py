"""Health-domain views over the driver's tables, written once in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ACTIVITY = """
SELECT user_id, CAST(ts AS DATE) AS date,
       CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'arena' WHEN 1 THEN 'stepcloud' ELSE 'manual' END AS source,
       CAST(floor(value * 100) AS BIGINT) AS steps, value * 10 AS distance_meters, CAST(event_id AS BIGINT) AS inserted_at, CAST(event_id AS BIGINT) AS seq
FROM {events}
"""
ACCESS_LOG = """
SELECT CAST(event_id AS BIGINT) AS event_id, ts, user_id,
       CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'health.walk.fetch.v1' WHEN 1 THEN 'health.walk.features.v1' WHEN 2 THEN 'health.trivia.fetch.v1'
         WHEN 3 THEN 'health.game.fetch.v1' ELSE 'health.telemetry.query.v1' END AS name,
       CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'RESEARCH_APP' WHEN 1 THEN 'AUDIT_APP' ELSE 'COACH_APP' END AS client_id,
       CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'coaching' WHEN 1 THEN 'analytics' WHEN 2 THEN 'modeling' END AS purpose,
       event_type <> 'error' AS ok,
       CASE WHEN event_type = 'error' THEN CASE CAST(event_id % 2 AS INT) WHEN 0 THEN 'denied_by_policy' ELSE 'upstream_error' END END AS error_code,
       CAST(floor(value) AS BIGINT) AS ms, concat('c', CAST(CAST(floor(event_id / 4) AS BIGINT) AS STRING)) AS corr_id,
       CASE CAST(event_id % 2 AS INT) WHEN 0 THEN 'gateway' ELSE 'sources' END AS layer
FROM {events}
"""
#: Purposes as clients write them: in any case and with blanks around.
REQUESTS = f"""
SELECT user_id, client, tool, CASE CAST(user_id % 5 AS INT) WHEN 1 THEN upper(lane) WHEN 2 THEN concat(' ', lane) WHEN 3 THEN concat(upper(left(lane, 1)), substr(lane, 2), '  ') ELSE lane END AS purpose
FROM (SELECT DISTINCT user_id, client_id AS client, coalesce(purpose, 'analytics') AS lane, name AS tool FROM ({ACCESS_LOG}) AS a) AS q
"""
#: Every case of the layers: a default alone, overridden by a client, by a tool, by both; redact lists replaced, also by an empty one; no rule at all.
RULE_ROWS = (
    ("default", None, "analytics", True, "provenance.email"),
    ("default", None, "modeling", False, "provenance.player_id"),
    ("client", "RESEARCH_APP", "modeling", True, ""),
    ("client", "AUDIT_APP", "analytics", False, None),
    ("client", "AUDIT_APP", "modeling", True, "provenance.email"),
    ("client", "COACH_APP", "coaching", True, "records.kcalories,provenance.player_id"),
    ("tool", "health.trivia.fetch.v1", "analytics", True, "records.kcalories,provenance.email"),
    ("tool", "health.trivia.fetch.v1", "coaching", None, ""),
    ("tool", "health.game.fetch.v1", "coaching", False, None),
    ("tool", "health.game.fetch.v1", "modeling", False, None),
    ("tool", "health.walk.features.v1", "modeling", True, None),
    ("tool", "health.telemetry.query.v1", "analytics", None, "provenance.player_id"),
)
#: Example plans by average daily steps (below, tier, message, technique references, rationale).
TIER_ROWS = (
    (3000, "seedling", "Leave the house once before noon and walk to the next corner and back.", "5.1 Information about health consequences", "A first fixed outing a day matters more than its length."),
    (7000, "sapling", "Get off one stop early on the way home three times this week.", "7.1 Prompts/cues|12.1 Restructuring the physical environment|8.3 Habit formation", "Steps tied to errands that happen anyway tend to stay."),
    (None, "tree", "Pick one longer route for the weekend and invite somebody along.", "3.2 Social support (practical)|13.1 Identification of self as role model|6.2 Social comparison|15.3 Focus on past success", "The base is there, so variety and company are what is left to gain."),
)


def _literal(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"


TIERS = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("CAST(NULL AS BIGINT)" if i == 0 and x is None else _literal(x) for i, x in enumerate(r)) + ")" for r in TIER_ROWS) + ") AS t(below, tier, message, refs, rationale)"
RULES = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in RULE_ROWS) + ") AS t(layer, key, purpose, allow, redact)"
GAME_TURNS = """
SELECT user_id, CAST(ts AS DATE) AS date, CAST(event_id AS BIGINT) AS pos, value - 20 * floor(value / 20) AS glucose,
       CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS BIGINT) AS minutes
FROM {events}
"""
ANSWERS = """
SELECT user_id, CAST(ts AS DATE) AS date, CAST(event_id AS BIGINT) AS pos,
       CASE WHEN event_id % 2 = 0 THEN 'THROUGH_HINT' ELSE 'QUESTION_CORRECT' END AS k,
       CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN 'true' ELSE 'false' END AS v
FROM {events}
"""
PLAYS = """
SELECT user_id, CAST(event_id AS BIGINT) AS id, CAST(floor(value) AS BIGINT) AS score, CAST(floor(value / 7) AS BIGINT) AS playtime,
       CAST(event_id % 9 AS BIGINT) AS days, CAST(event_id % 3 AS BIGINT) AS home, CAST(event_id % 4 AS BIGINT) AS outdoors, CAST(event_id % 5 AS BIGINT) AS work,
       CAST(event_id % 100 AS BIGINT) AS accuracy, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS hospital_turns,
       CASE WHEN event_type = 'click' THEN value - 10 * floor(value / 10) END AS response
FROM {events}
"""
CONNECTORS = """
SELECT c_custkey AS user_id, 'walk' AS domain, CAST(0 AS INT) AS pos,
       CASE CAST(c_nationkey % 3 AS INT) WHEN 0 THEN 'Arena' WHEN 1 THEN 'StepCloud' ELSE 'Other' END AS connected_application,
       CASE WHEN c_custkey % 7 <> 0 THEN concat('p', CAST(c_custkey AS STRING)) END AS player_id, CAST(NULL AS STRING) AS auth_bearer
FROM {customer}
"""
SECRETS = """
SELECT c_custkey AS user_id, 'walk' AS domain, CAST(0 AS INT) AS pos,
       CASE CAST(c_nationkey % 3 AS INT) WHEN 0 THEN 'Arena' WHEN 1 THEN 'StepCloud' ELSE 'Other' END AS connected_application,
       CASE WHEN c_custkey % 7 <> 0 THEN concat('p', CAST(c_custkey AS STRING)) END AS player_id,
       CASE WHEN c_custkey % 5 = 0 THEN 'YOUR_TOKEN' ELSE concat('Bearer t', CAST(c_custkey AS STRING)) END AS auth_bearer
FROM {customer} WHERE c_custkey % 2 = 0
"""
ALIASES = "SELECT * FROM (VALUES ('arena', 'arena'), ('arena health', 'arena'), ('stepcloud', 'stepcloud')) AS t(alias, source)"
#: Outcomes of three sources for each order taken as a request.
CANDIDATES = """
SELECT o_orderkey AS request_id, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'arena' WHEN 1 THEN 'stepcloud' WHEN 2 THEN 'any' END AS prefer,
       CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'vault' WHEN 1 THEN 'live' ELSE 'auto' END AS prefer_data, s.source,
       CASE s.source WHEN 'vault' THEN o_custkey % 2 = 0 WHEN 'arena' THEN o_orderkey % 3 = 0 ELSE o_orderkey % 5 < 3 END AS ok,
       CAST(o_custkey % 3 AS BIGINT) AS n_records, CASE WHEN s.source = 'vault' THEN 'empty' ELSE 'upstream_error' END AS error_code
FROM {orders} CROSS JOIN (VALUES ('vault'), ('arena'), ('stepcloud')) AS s(source)
"""
ORDERS_OF = "SELECT o_orderkey AS request_id, o_custkey AS user_id FROM {orders}"
VIEWS = {
    "activity": ACTIVITY, "access_log": ACCESS_LOG, "requests": REQUESTS, "rules": RULES, "game_turns": GAME_TURNS, "answers": ANSWERS,
    "plays": PLAYS, "connectors": CONNECTORS, "secrets": SECRETS, "aliases": ALIASES, "candidates": CANDIDATES, "tiers": TIERS, "orders_of": ORDERS_OF,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "customer", "orders") if f"{{{t}}}" in text}
    out = spark.sql(text, **tables) if tables else spark.sql(text)
    if name == "rules":
        from pyspark.sql import functions as F

        out = out.withColumn("allow", F.col("allow").cast("boolean")).withColumn("redact", F.when(F.col("redact") == "", F.array().cast("array<string>")).otherwise(F.split("redact", ",")))
    return out


def ctes(*names: str) -> str:
    """The views as common table expressions for DuckDB, to be followed by a comma or SELECT."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names).replace("{events}", "events").replace("{customer}", "customer").replace("{orders}", "orders")
