"""Composed jobs: what a user runs, for all users and requests in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceledger.functions import redact
from paceledger.functions import scalars as S
from paceledger.operators import audit, connectors, games, policy, store
from paceledger.sources import landing, writers

REDACTABLE = ["records.kcalories", "provenance.player_id", "provenance.email"]


def decide(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests with their resolved rule and the error that stops them before anything is read."""
    out = policy.deny(policy.resolve_policy(requests, rules))
    return out.withColumn("error", F.coalesce("error", policy.validate_prefer_data(F.col("prefer_data"))))


def fetch(decided: DataFrame, candidates: DataFrame, records: DataFrame, *, live: tuple[str, str], store_name: str = "vault", as_of=None, days: int = 365) -> DataFrame:
    """``decided`` with selected_source, attempts, player and records of the requests without error; failed fetches get theirs.

    One join finds the outcomes of the sources, one the user's rows of the chosen
    source; windows and pages are cut inside the row. With ``as_of``, open windows
    end there and begin ``days`` days before. The requests' outermost dates go to
    the scan of the records, and of these only rows of a (user, source) that some
    request has chosen are gathered. Columns limit and offset of the requests page
    the records by date. Records of the store may have several rows a day, by
    origin and inserted_at: each request gets the one it prefers.
    """
    if as_of is not None:
        upper = F.coalesce("end", F.lit(as_of).cast("date"))
        decided = decided.withColumn("start", F.coalesce("start", F.date_sub(upper, days))).withColumn("end", upper)
    outer = decided.where("error IS NULL").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_if(F.col("start").isNull()).alias("from_ever"), F.count_if(F.col("end").isNull()).alias("to_ever")).first()
    records = store.date_window(records, None if outer["from_ever"] else outer["start"], None if outer["to_ever"] else outer["end"])
    tries = connectors.tries_of(candidates).select("request_id", "_tries")
    none = F.array().cast(connectors.TRIES)
    out = decided.join(tries, "request_id", "left").withColumn("_tries", F.coalesce("_tries", none))
    chosen = F.when(F.col("error").isNull(), connectors.choose(F.col("_tries"), F.col("prefer"), F.col("prefer_data"), live, store_name))
    out = out.withColumn("_chosen", chosen).drop("_tries")
    failed = F.when(F.col("_chosen.error_code").isNotNull(), policy.typed_error(F.col("_chosen.error_code"), F.col("_chosen.error_code")))
    out = out.select(*decided.columns, F.col("_chosen.selected_source").alias("selected_source"), F.col("_chosen.attempts").alias("attempts"), failed.alias("_failed"))
    own = gathered(records, out)
    out = out.join(own, (F.col("user_id") == F.col("_user")) & (F.col("selected_source") == F.col("_source")), "left")
    rows = F.filter("_rows", lambda r: F.coalesce(r["date"] >= F.col("start"), F.col("start").isNull()) & F.coalesce(r["date"] <= F.col("end"), F.col("end").isNull()))
    if "origin" in records.columns:
        rows = F.when(F.col("selected_source") == store_name, store.preferred_in_row(rows, F.coalesce("prefer", F.lit(live[0])))).otherwise(rows)
    rows = F.coalesce(F.transform(rows, lambda r: F.struct(r["date"].alias("date"), r["steps"].alias("steps"), r["kcalories"].alias("kcalories"))), F.array().cast("array<struct<date:date,steps:bigint,kcalories:double>>"))
    if {"limit", "offset"} <= set(decided.columns):
        low = F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)).cast("int")
        rows = F.slice(rows, low + 1, F.greatest(F.coalesce("limit", F.size(rows)), F.lit(0)).cast("int"))
    out = out.withColumn("records", F.when(F.col("selected_source").isNotNull(), rows))
    return out.withColumn("error", F.coalesce("error", "_failed")).drop("_user", "_source", "_rows", "_failed")


def gathered(records: DataFrame, chosen: DataFrame) -> DataFrame:
    """(_user, _source, _rows, player): the records of each (user_id, selected_source) of ``chosen``, and of no others."""
    asked = chosen.where("error IS NULL AND selected_source IS NOT NULL").select(F.col("user_id").alias("_u"), F.col("selected_source").alias("_s")).distinct()
    some = records.join(asked, (F.col("user_id") == F.col("_u")) & (F.col("source") == F.col("_s")), "left_semi")
    row = F.struct(*[c for c in ("date", "steps", "kcalories", "origin", "inserted_at") if c in records.columns])
    return some.groupBy(F.col("user_id").alias("_user"), F.col("source").alias("_source")).agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.max("player_id").alias("player"))


def outcomes(requests: DataFrame, users: DataFrame, resolved: DataFrame, records: DataFrame, *, live: tuple[str, str], store_name: str = "vault", domain: str = "walk") -> DataFrame:
    """(request_id, source, ok, n_records, error_code): what each source would give each request.

    A live source answers if its user is known, connected, has a token and data;
    else its error is the first of these that fails. The store answers if it has
    rows in the request's window. Counts are per user and source, so no rows meet.
    """
    asked = requests.select("request_id", "user_id", F.lit(domain).alias("domain"), F.explode(F.array(*[F.lit(s) for s in live])).alias("source"))
    have = records.groupBy("user_id", "source").agg(F.count("*").alias("n_records"))
    judged = connectors.classify_requests(asked, users, resolved, have).join(have, ["user_id", "source"], "left")
    judged = judged.select("request_id", "source", F.col("error_code").isNull().alias("ok"), F.coalesce("n_records", F.lit(0)).alias("n_records"), "error_code")
    stored = records.where(F.col("source") == store_name).groupBy("user_id", "date").agg(F.count("*").alias("n"))
    inside = (F.col("date") >= F.coalesce("start", "date")) & (F.col("date") <= F.coalesce("end", "date"))
    found = requests.select("request_id", "user_id", "start", "end").join(stored, "user_id").where(inside).groupBy("request_id").agg(F.sum("n").alias("n_records"))
    kept = requests.select("request_id").join(found, "request_id", "left").select("request_id", F.lit(store_name).alias("source"), F.lit(True).alias("ok"), F.coalesce("n_records", F.lit(0)).alias("n_records"))
    return judged.unionByName(kept.withColumn("error_code", F.when(F.col("n_records") == 0, "empty")))


def fetch_walk(requests: DataFrame, rules: DataFrame, users: DataFrame, resolved: DataFrame, live_records: DataFrame, stored: DataFrame, *, live: tuple[str, str], store_name: str = "vault", as_of=None, days: int = 365, **options) -> DataFrame:
    """The whole chain: policy, classification of the sources, the store first or last as asked, one preferred row a day, window and page.

    ``live_records`` (source, user_id, date, steps, kcalories, player_id) is what
    the sources hold, ``stored`` the daily store with its rows' own source.
    """
    if as_of is not None:
        upper = F.coalesce("end", F.lit(as_of).cast("date"))
        requests = requests.withColumn("start", F.coalesce("start", F.date_sub(upper, days))).withColumn("end", upper)
    old = stored.select(F.lit(store_name).alias("source"), "user_id", "date", "steps", "kcalories", F.lit(None).cast("string").alias("player_id"), F.col("source").alias("origin"), "inserted_at")
    records = old.unionByName(live_records.withColumns({"origin": F.col("source"), "inserted_at": F.lit(0).cast("bigint")}))
    found = outcomes(requests, users, resolved, records, live=live, store_name=store_name)
    return fetch_walk_batch(requests, rules, found, records, live=live, store_name=store_name, **options)


def write_through(fetched: DataFrame, path: str, inserted_at: int, live: tuple[str, str]) -> None:
    """Store what live sources gave, as daily rows of that source; denied and failed requests have none. Records must be unmasked, so fetch them with ``paths=[]``."""
    rows = fetched.where(F.col("error").isNull() & F.col("selected_source").isin(*live)).select("user_id", F.col("selected_source").alias("source"), F.explode("records").alias("r"))
    none = {c: F.lit(None).cast(t) for c, t in (("distance_meters", "double"), ("duration_s", "double"), ("raw_json", "string"))}
    rows = rows.select("user_id", "r.date", "source", "r.steps", "r.kcalories").distinct().withColumns({**none, "inserted_at": F.lit(inserted_at).cast("bigint")})
    writers.upsert_daily(fetched.sparkSession, path, rows)


def fetch_walk_batch(requests: DataFrame, rules: DataFrame, candidates: DataFrame, records: DataFrame, *, live: tuple[str, str], store_name: str = "vault", paths: list[str] | None = None, as_of=None) -> DataFrame:
    """Purpose-limited records for a table of requests.

    ``requests``: request_id, user_id, client, purpose, tool, prefer, prefer_data,
    start, end. ``candidates``: request_id, source, ok, n_records, error_code.
    ``records``: source, user_id, date, steps, kcalories, player_id. A request
    reads one source, and none if it is denied.
    """
    out = fetch(decide(requests, rules), candidates, records, live=live, store_name=store_name, as_of=as_of)
    provenance = F.when(F.col("selected_source").isNotNull(), F.create_map(F.lit("source"), F.col("selected_source"), F.lit("player_id"), F.coalesce("player", F.lit(""))))
    shaped = policy.shape_for_purpose(out.withColumn("provenance", provenance).drop("player"))
    return policy.redact_paths(shaped, REDACTABLE if paths is None else paths, when=lambda p: F.col("error").isNull() & F.array_contains("redact", p))


def walk_features_batch(requests: DataFrame, rules: DataFrame, candidates: DataFrame, records: DataFrame, *, live: tuple[str, str], store_name: str = "vault", as_of=None) -> DataFrame:
    """Features for modeling requests: fetched in their window, aggregated inside the row, records dropped.

    Another purpose is a bad request; a fetch that fails gives its error and no features.
    """
    decided = decide(requests, rules)
    wrong = F.when(policy.norm_purpose(F.col("purpose")) != "modeling", policy.typed_error("bad_request", "features need purpose modeling"))
    out = fetch(decided.withColumn("error", F.coalesce("error", wrong)), candidates, records, live=live, store_name=store_name, as_of=as_of)
    steps = F.filter(F.transform("records", lambda r: r["steps"].try_cast("bigint")), lambda n: n.isNotNull())
    out = out.withColumn("_steps", F.when(F.col("error").isNull(), steps))
    days = F.size("_steps").cast("bigint")
    total = F.aggregate("_steps", F.lit(0).cast("bigint"), lambda a, n: a + n)
    mean = F.when(days > 0, (total / days).cast("bigint")).otherwise(F.when(days == 0, 0)).cast("bigint")
    features = [days.alias("days"), total.alias("total_steps"), mean.alias("avg_steps"), F.array_min("_steps").alias("min_steps"), F.array_max("_steps").alias("max_steps")]
    provenance = F.when(F.col("error").isNull(), F.create_map(F.lit("source"), F.col("selected_source")))
    return out.select("request_id", "user_id", "client", "purpose", "tool", "error", *features, "selected_source", "attempts", provenance.alias("provenance"))


def guardian(events: DataFrame, *, client_id: str, purpose: str, as_of, lookback_s: int = 3600, min_denies: int = 3) -> tuple[DataFrame, DataFrame]:
    """(alerts, evidence): tools repeatedly denied to a watched client and purpose within the lookback."""
    watched = audit.filter_audit(events, client_id=client_id, purpose=purpose).where(audit.lookback_bound(F.col("ts"), F.lit(as_of).cast("timestamp"), lookback_s))
    alerts = audit.denial_alerts(watched, min_denies)
    return audit.alert_order(alerts), audit.evidence_per_tool(watched, alerts)


def transparency_report(events: DataFrame, records: DataFrame, rules: DataFrame, clients: DataFrame, purposes: DataFrame, tools: DataFrame, *, subject_hash: str, salt: str, prefix: str, introspection: tuple[str, ...]) -> dict[str, DataFrame]:
    """What is stored of a person, what is allowed, and who looked; ``records`` has user_id, whose salted hash is the subject's."""
    own = audit.exclude_introspection(audit.filter_audit(events, subject_hash=subject_hash), prefix, introspection)
    return {
        "inventory": store.inventory(records.where(redact.subject_hash(F.col("user_id"), salt) == subject_hash)),
        "allowed": policy.policy_matrix(clients, purposes, tools, rules),
        "access": audit.summary_order(audit.access_summary(own)),
        "errors": audit.error_histogram(own),
    }


def literacy_assessment(quiz: DataFrame, playthroughs: DataFrame, engagement: DataFrame) -> DataFrame:
    """Scores and player types of every user with both quiz and game activities."""
    trivia = games.trivia_rates(games.trivia_counts(quiz))
    sessions = games.engagement_sessions(engagement).withColumn("response", games.critical_response(F.col("glucose"), F.col("minutes")))
    metrics = games.join_domains(trivia, games.game_overview(games.playthrough_metrics(playthroughs), sessions))
    return games.player_types(games.literacy_scores(metrics))


def coach_plans(rows: DataFrame, prefer: str, as_of, tiers: DataFrame, days: int = 7) -> DataFrame:
    """A plan per user from the trailing average of the preferred rows; users without recent rows have average 0.

    ``tiers`` (below, tier, message, bct_refs, rationale) is a few rows; a NULL bound holds for all averages above the others.
    """
    best = store.preferred_per_day(rows, prefer)
    avg = store.trailing_avg_steps(best, as_of, days)
    users = rows.select("user_id").distinct().join(avg, "user_id", "left").fillna(0, ["avg_steps", "n_records"])
    plan = F.struct(F.coalesce("below", F.lit(2**62)).alias("at"), "below", "tier", "message", "bct_refs", "rationale")
    every = tiers.agg(F.array_sort(F.collect_list(plan)).alias("_tiers"))
    found = users.crossJoin(every).withColumn("plan", S.coach_tier(F.col("avg_steps"), F.col("_tiers")))
    return found.select("user_id", "avg_steps", F.lit(days).alias("days_considered"), "plan.tier", "plan.message", "plan.bct_refs", "plan.rationale")


def privacy_lanes(requests: DataFrame, rules: DataFrame, candidates: DataFrame, records: DataFrame, **options) -> DataFrame:
    """Every request under each purpose: what the lanes return, side by side."""
    lanes = requests.drop("purpose").withColumn("purpose", F.explode(F.array(*[F.lit(p) for p in policy.PURPOSES])))
    lanes = lanes.withColumn("_base", F.col("request_id")).withColumn("request_id", F.concat_ws("/", "request_id", "purpose"))
    spread = candidates.withColumn("p", F.explode(F.array(*[F.lit(p) for p in policy.PURPOSES]))).withColumn("request_id", F.concat_ws("/", "request_id", "p")).drop("p")
    out = fetch_walk_batch(lanes, rules, spread, records, **options)
    return out.select(F.col("_base").alias("request_id"), "purpose", F.col("error.code").alias("error_code"), F.coalesce(F.size("records"), F.lit(0)).alias("n_records"), F.array_sort(F.map_keys("provenance")).alias("provenance_keys"))


def trace_report(events: DataFrame, corr_id: str) -> DataFrame:
    """The last rows of one request's trace across layers."""
    return audit.last_trace_rows(audit.project_trace(events.where(F.col("corr_id") == corr_id)))


def trace_layers(layers: DataFrame, corr_id: str, order: str = "ts") -> DataFrame:
    """One request's steps through all layers that logged it, from events of several layers: (n, layer, name, ok, layers)."""
    whole = audit.correlate_layers(layers.where(F.col("corr_id") == corr_id), order)
    return whole.select(F.posexplode("steps").alias("n", "s"), F.array_join("layers", ",").alias("layers")).select("n", "s.layer", "s.name", "s.ok", "layers")


def ingest(activities: DataFrame, source: str, inserted_at: int, mode: str = "last") -> DataFrame:
    """Raw activities as daily rows, one per user, day and source: the last one written, or (mode="sum") their sum."""
    walks = store.pivot_activity_properties(activities)
    rows = store.normalize_ingest(walks, source, inserted_at)
    if mode == "sum":
        return store.sum_per_key(rows)
    return store.last_write_wins(rows.withColumn("seq", F.get_json_object("raw_json", "$.activity_id").try_cast("bigint")))


def ingest_to_store(activities: DataFrame, source: str, inserted_at: int, path: str) -> DataFrame:
    """Raw activities to the daily store at ``path``: pivoted, checked, normalised, upserted. Returns the rows that break a rule, which stay out."""
    walks = store.pivot_activity_properties(activities)
    clock = F.floor("duration_s").cast("bigint")
    duration = F.when(clock.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(clock / 3600).cast("bigint"), F.floor(clock % 3600 / 60).cast("bigint"), clock % 60))
    text = lambda c: F.col(c).cast("string")
    bad = store.violations(F.col("date"), text("steps"), {c: text(c) for c in ("distance_meters", "kcalories")}, duration)
    marked = walks.withColumn("violations", bad)
    rows = store.normalize_ingest(marked.where(F.size("violations") == 0).drop("violations"), source, inserted_at)
    rows = rows.withColumn("seq", F.get_json_object("raw_json", "$.activity_id").try_cast("bigint"))
    writers.upsert_daily(activities.sparkSession, path, store.last_write_wins(rows))
    return marked.where(F.size("violations") > 0)


def ingest_new(spark: SparkSession, folder: str, out: str, checkpoint: str, source: str, inserted_at: int, path: str) -> None:
    """Take the dump files of ``folder`` that are new to the store at ``path``; each is read once over all runs.

    What can't be read, and rows that break a rule, are in ``landing.broken``
    with their text and reason. A batch that is repeated changes nothing.
    """

    def to_store(rows: DataFrame, batch_id: int) -> DataFrame:
        line = F.to_json(F.struct(*[c for c in rows.columns if c != "file"]))
        lines = rows.select(F.col("id").alias("activity_id"), "user_id", "file", line.alias("line"))
        refused = ingest_to_store(rows.drop("file"), source, inserted_at, path)
        reason = refused.select("activity_id", "user_id", F.array_join("violations", "; ").alias("reason"))
        return lines.join(reason, ["activity_id", "user_id"]).select("file", "line", "reason")

    landing.land(spark, folder, out, checkpoint, then=to_store).start().awaitTermination()
