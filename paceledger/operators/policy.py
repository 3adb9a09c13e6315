"""Purpose policies over whole tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceledger.functions.redact import minimize_provenance, redact_paths

PURPOSES = ("analytics", "modeling", "coaching")
PREFERENCES = ("auto", "vault", "live")
REQUEST = ("client", "purpose", "tool")


def norm_purpose(purpose: Column) -> Column:
    """A purpose as the lanes name it: without white space around, in lower case."""
    return F.lower(F.trim(F.coalesce(purpose, F.lit("")), F.lit(" \t\n\r\x0b\x0c")))


def typed_error(code: str | Column, message: str | Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(code).alias("code"), as_column(message).alias("message"))


def validate_purpose(purpose: Column) -> Column:
    """An error struct for a purpose that isn't one of the lanes, else NULL."""
    return F.when(~norm_purpose(purpose).isin(*PURPOSES), typed_error("bad_request", "purpose must be analytics, modeling or coaching"))


def validate_prefer_data(prefer: Column) -> Column:
    return F.when(~F.lower(F.trim(F.coalesce(prefer, F.lit("auto")))).isin(*PREFERENCES), typed_error("bad_request", "prefer_data must be auto, vault or live"))


def flatten_policy(doc: DataFrame) -> DataFrame:
    """A policy document (defaults, clients, tools) as rows (layer, key, purpose, allow, redact).

    A default has a null key; a NULL allow or redact counts as absent.
    """
    defaults = doc.select(F.lit("default").alias("layer"), F.lit(None).cast("string").alias("key"), F.explode("defaults").alias("purpose", "rule"))
    layers = [defaults]
    for layer, column in (("client", "clients"), ("tool", "tools")):
        by_key = doc.select(F.explode(column).alias("key", "rules"))
        layers.append(by_key.select(F.lit(layer).alias("layer"), "key", F.explode("rules").alias("purpose", "rule")))
    rows = layers[0].unionByName(layers[1]).unionByName(layers[2])
    return rows.select("layer", "key", "purpose", F.col("rule.allow").alias("allow"), F.col("rule.redact").alias("redact"))


def explain_policy(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """``requests`` (client, purpose, tool, ...) with each layer's rule and the resolved allow and redact.

    Purposes meet trimmed and in lower case on both sides, as they are validated;
    the request's own text stays in the result. Later layers win per field:
    default, client, tool. Redact lists replace each other. ``allow`` is true and
    ``redact`` empty where no layer says otherwise. Of several rules of one layer,
    key and purpose a denial holds, then the longest redact list. The join
    strategy follows the rule table's size.
    """
    strict = F.struct(F.coalesce("allow", F.lit(True)), -F.coalesce(F.size("redact"), F.lit(0)), F.coalesce(F.array_join("redact", ","), F.lit("")))

    def side(layer: str, *keys: str) -> DataFrame:
        named = {"default": "default_rule", "client": "client_rule", "tool": "tool_rule"}[layer]
        own = rules.where(F.col("layer") == layer).groupBy(norm_purpose(F.col("purpose")).alias("_purpose"), *[F.col("key").alias(k) for k in keys])
        return own.agg(F.min_by(F.struct("allow", "redact"), strict).alias(named))

    out = requests.withColumn("_purpose", norm_purpose(F.col("purpose")))
    out = out.join(side("default"), "_purpose", "left").join(side("client", "client"), ["_purpose", "client"], "left").join(side("tool", "tool"), ["_purpose", "tool"], "left")
    pick = lambda f, other: F.coalesce(F.col(f"tool_rule.{f}"), F.col(f"client_rule.{f}"), F.col(f"default_rule.{f}"), other)
    return out.withColumn("allow", pick("allow", F.lit(True))).withColumn("redact", pick("redact", F.array().cast("array<string>"))).drop("_purpose")


def explain_policy_at(requests: DataFrame, rules: DataFrame, ts: str = "ts") -> DataFrame:
    """``explain_policy`` with the rules that held at each request's time, so past decisions can be explained.

    ``rules`` has valid_from and valid_to besides: a rule holds from the first until
    before the second, a NULL bound is open. Of rules of one layer, key and purpose
    that overlap, the one that began last holds. The versions of a rule are gathered
    beside it, so requests are joined by equality, and not shuffled for the time;
    a request without a time meets only rules without bounds.
    """
    version = F.struct("valid_from", "valid_to", F.coalesce("allow", F.lit(True)).alias("_strict"), "allow", "redact")
    lasting = lambda v: (v["valid_from"].isNull() | (v["valid_from"] <= F.col(ts))) & (v["valid_to"].isNull() | (v["valid_to"] > F.col(ts)))

    def side(layer: str, *keys: str) -> DataFrame:
        own = rules.where(F.col("layer") == layer).groupBy(norm_purpose(F.col("purpose")).alias("_purpose"), *[F.col("key").alias(k) for k in keys])
        return own.agg(F.array_sort(F.collect_list(version), newest_first).alias(f"_{layer}"))

    out = requests.withColumn("_purpose", norm_purpose(F.col("purpose")))
    out = out.join(side("default"), "_purpose", "left").join(side("client", "client"), ["_purpose", "client"], "left").join(side("tool", "tool"), ["_purpose", "tool"], "left")
    for layer in ("default", "client", "tool"):
        held = F.get(F.filter(f"_{layer}", lambda v: F.coalesce(lasting(v), F.lit(False))), F.lit(0))
        out = out.withColumn(f"{layer}_rule", F.when(held.isNotNull(), F.struct(held["allow"].alias("allow"), held["redact"].alias("redact"), held["valid_from"].alias("valid_from"))))
    pick = lambda f, other: F.coalesce(F.col(f"tool_rule.{f}"), F.col(f"client_rule.{f}"), F.col(f"default_rule.{f}"), other)
    out = out.withColumn("allow", pick("allow", F.lit(True))).withColumn("redact", pick("redact", F.array().cast("array<string>")))
    return out.drop("_purpose", "_default", "_client", "_tool")


def newest_first(a: Column, b: Column) -> Column:
    """Order of rule versions: the latest start first, an open start last; of equal starts a denial first."""
    start = lambda v: F.coalesce(F.unix_micros(v["valid_from"]), F.lit(-(2**63)))
    return F.when(start(a) > start(b), -1).when(start(a) < start(b), 1).when(a["_strict"] < b["_strict"], -1).when(a["_strict"] > b["_strict"], 1).otherwise(0)


def resolve_policy(requests: DataFrame, rules: DataFrame) -> DataFrame:
    return explain_policy(requests, rules).drop("default_rule", "client_rule", "tool_rule")


def policy_matrix(clients: DataFrame, purposes: DataFrame, tools: DataFrame, rules: DataFrame) -> DataFrame:
    """All combinations of three small name tables, resolved."""
    return explain_policy(clients.crossJoin(purposes).crossJoin(tools), rules)


def deny(resolved: DataFrame) -> DataFrame:
    """Add ``error``: a bad purpose first, then a denial, else NULL."""
    denied = F.when(~F.col("allow"), typed_error("denied_by_policy", "the policy denies this purpose"))
    return resolved.withColumn("error", F.coalesce(validate_purpose(F.col("purpose")), denied))


def enforce_policy(payloads: DataFrame, rules: DataFrame, paths: list[str]) -> DataFrame:
    """Payload rows with error set where denied, and the resolved paths masked where allowed; denied payloads stay as they are."""
    rows = deny(resolve_policy(payloads, rules))
    return redact_paths(rows, paths, when=lambda p: F.col("error").isNull() & F.array_contains("redact", p))


def shape_for_purpose(rows: DataFrame) -> DataFrame:
    """What a purpose may see of (records, provenance, error): coaching all, modeling nothing, others records with less provenance."""
    lane = norm_purpose(F.col("purpose"))
    failed = F.col("error").isNotNull()
    raw = (lane == "modeling") & ~failed
    error = F.when(raw, typed_error("not_supported", "raw records are not available for modeling")).otherwise(F.col("error"))
    records = F.when(raw, None).otherwise(F.col("records"))
    provenance = F.when(raw, None).when(failed | (lane == "coaching"), F.col("provenance")).otherwise(minimize_provenance(F.col("provenance")))
    return rows.withColumns({"error": error, "records": records, "provenance": provenance})
