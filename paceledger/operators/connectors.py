"""User connectors, request classification and the choice among sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceledger.functions.scalars import strip_bearer

IDENTITY = ("user_id", "domain", "connected_application", "player_id")


def explode_registry(doc: DataFrame) -> DataFrame:
    """A registry document as rows (user_id, domain, pos, connected_application, player_id, auth_bearer)."""
    users = doc.select(F.explode("users").alias("u"))
    rows = None
    for domain in ("walk", "diabetes", "nutrition"):
        own = users.select(F.col("u.user_id").alias("user_id"), F.lit(domain).alias("domain"), F.posexplode(f"u.connected_apps_{domain}_data").alias("pos", "c"))
        own = own.select("user_id", "domain", "pos", "c.*")
        rows = own if rows is None else rows.unionByName(own)
    return rows


def overlay_secrets(public: DataFrame, secrets: DataFrame) -> DataFrame:
    """Public connectors with the secret of the same identity, the first one; a missing key part equals ''. Secret-only rows go."""
    keyed = lambda df: df.withColumns({f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in IDENTITY})
    keys = [f"_{c}" for c in IDENTITY]
    first = Window.partitionBy(*keys).orderBy("pos")
    secret = keyed(secrets).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*keys, F.col("auth_bearer").alias("_secret"))
    out = keyed(public).join(secret, keys, "left")
    return out.withColumn("auth_bearer", F.coalesce("_secret", "auth_bearer")).select(*public.columns)


def resolve_connector(connectors: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per user, domain and source: the first list entry whose application is an alias (alias, source) of the source and that has a player."""
    named = connectors.withColumn("alias", F.lower(F.trim("connected_application"))).join(aliases, "alias").where("player_id IS NOT NULL")
    best = F.min_by(F.struct("connected_application", "player_id", strip_bearer(F.col("auth_bearer")).alias("token"), "pos"), "pos")
    return named.groupBy("user_id", "domain", "source").agg(best.alias("c")).select("user_id", "domain", "source", "c.*")


def resolve_diabetes_connector(resolved: DataFrame, source: str) -> DataFrame:
    """Per user: the diabetes connector, else the walk connector with the first diabetes token, else the walk connector."""
    own = resolved.where((F.col("domain") == "diabetes") & (F.col("source") == source)).select("user_id", F.struct("player_id", "token").alias("own"))
    tokens = resolved.where((F.col("domain") == "diabetes") & F.col("token").isNotNull()).groupBy("user_id").agg(F.min_by("token", "pos").alias("first_token"))
    walk = resolved.where((F.col("domain") == "walk") & (F.col("source") == source)).select("user_id", F.struct("player_id", "token").alias("walk"))
    both = own.join(walk, "user_id", "full").join(tokens, "user_id", "left")
    return both.select("user_id", F.coalesce("own.player_id", "walk.player_id").alias("player_id"), F.coalesce("own.token", F.when(F.col("own").isNull(), F.col("first_token")), "walk.token").alias("token"))


def primary_app_info(requests: DataFrame, connectors: DataFrame) -> DataFrame:
    """The first connector of a request's user and domain, or Unknown."""
    first = connectors.where("pos = 0").select("user_id", "domain", "connected_application", "player_id", "auth_bearer")
    return requests.join(first, ["user_id", "domain"], "left").fillna("Unknown", ["connected_application"])


def connector_status(users: DataFrame, resolved: DataFrame, grid: list[tuple[str, str]]) -> DataFrame:
    """Per user and (domain, source) of the grid: configured, application, player, and whether there is a real token."""
    cells = users.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(s).alias("source")) for d, s in grid])).alias("g")).select("user_id", "g.*")
    out = cells.join(resolved, ["user_id", "domain", "source"], "left")
    token = F.coalesce("token", F.lit(""))
    return out.select("user_id", "domain", "source", F.col("player_id").isNotNull().alias("configured"), "connected_application", "player_id", ((token != "") & ~token.contains("YOUR_")).alias("has_token"))


def classify_requests(requests: DataFrame, users: DataFrame, resolved: DataFrame, with_data: DataFrame) -> DataFrame:
    """``requests`` (user_id, domain, source) with the first error that applies: unknown user, no connector, no token, no data."""
    known = users.select("user_id").distinct().withColumn("_known", F.lit(True))
    data = with_data.select("user_id", "source").distinct().withColumn("_data", F.lit(True))
    own = resolved.select("user_id", "domain", "source", F.lit(True).alias("_connected"), F.col("token").alias("_token"))
    out = requests.join(known, "user_id", "left").join(own, ["user_id", "domain", "source"], "left").join(data, ["user_id", "source"], "left")
    code = F.when(F.col("_known").isNull(), "unknown_user").when(F.col("_connected").isNull(), "not_connected").when(F.coalesce("_token", F.lit("")) == "", "missing_token").when(F.col("_data").isNull(), "upstream_error")
    return out.withColumn("error_code", code).select(*requests.columns, "error_code")


def unknown_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    return requests.join(users.select("user_id").distinct(), "user_id", "left_anti")


def source_rank(source: Column, prefer: Column, prefer_data: Column, live: tuple[str, str], store: str) -> Column:
    """The order in which a request tries its sources; NULL for one that it doesn't try.

    auto: store, the preferred live source, the other one; vault: store only;
    live: live ones only. Any preference but the first live source puts the second first.
    """
    first = F.when(F.coalesce(prefer, F.lit(live[0])) == live[0], live[0]).otherwise(live[1])
    live_rank = F.when(source == first, 2).when(source.isin(*live), 3)
    mode = F.lower(F.trim(F.coalesce(prefer_data, F.lit("auto"))))
    return F.when(source == store, F.when(mode != "live", 1)).otherwise(F.when(mode != "vault", live_rank))


TRIES = "array<struct<source:string,ok:boolean,n_records:bigint,error_code:string>>"


def tries_of(candidates: DataFrame) -> DataFrame:
    """(request_id, _tries, prefer, prefer_data): the outcomes of each request, one per source, as ``choose`` takes them."""
    outcome = F.collect_list(F.struct("source", "ok", F.col("n_records").cast("bigint").alias("n_records"), "error_code")).cast(TRIES)
    asked = [F.max(c).alias(c) for c in ("prefer", "prefer_data") if c in candidates.columns]
    return candidates.groupBy("request_id").agg(outcome.alias("_tries"), *asked)


def select_source(candidates: DataFrame, live: tuple[str, str], store: str = "vault") -> DataFrame:
    """Per request the first source that succeeds, from (request_id, prefer, prefer_data, source, ok, n_records, error_code).

    A store without records counts as failed; a live success without records
    still wins. ``attempts`` has what was tried up to it, in order.
    """
    rows = tries_of(candidates).withColumn("_chosen", choose(F.col("_tries"), F.col("prefer"), F.col("prefer_data"), live, store))
    return rows.where(F.size("_chosen.attempts") > 0).select("request_id", "_chosen.selected_source", "_chosen.error_code", "_chosen.attempts")


def choose(tries: Column, prefer: Column, prefer_data: Column, live: tuple[str, str], store: str = "vault") -> Column:
    """The choice inside a row: (selected_source, error_code, attempts) from an array of (source, ok, n_records, error_code)."""
    tried = F.transform(
        tries,
        lambda t: F.struct(source_rank(t["source"], prefer, prefer_data, live, store).alias("rank"), t["source"].alias("source"), (t["ok"] & ((t["source"] != store) | (t["n_records"] > 0))).alias("ok"), t["error_code"].alias("error_code")),
    )
    ranked = F.array_sort(F.filter(tried, lambda t: t["rank"].isNotNull()))
    best = F.get(F.filter(ranked, lambda t: t["ok"]), F.lit(0))
    failed = F.when(F.lower(F.trim(F.coalesce(prefer_data, F.lit("auto")))) == "vault", "vault_empty").otherwise("all_sources_failed")
    made = F.filter(ranked, lambda t: best.isNull() | (t["rank"] <= best["rank"]))
    return F.struct(best["source"].alias("selected_source"), F.when(best.isNull(), failed).alias("error_code"), made.alias("attempts"))


def attempt_trace(attempts: DataFrame) -> DataFrame:
    """Per request the ordered attempts (rank, source, ok, error_code)."""
    return attempts.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "ok", "error_code"))).alias("attempts"))


def stamp_provenance(records: DataFrame, as_of) -> DataFrame:
    """Add the provenance map of fetched records: player and time of retrieval."""
    stamp = F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return records.withColumn("provenance", F.create_map(F.lit("player_id"), F.col("player_id").cast("string"), F.lit("retrieved_at"), stamp))
