"""Scalar expressions: dates and times, text, coercions, scores. All are native Columns; bad input gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Amsterdam"


def millis_to_local(ms: Column, zone: str = ZONE) -> Column:
    """Milliseconds since the epoch as local text ``yyyy-MM-dd HH:mm:ss`` (session zone UTC)."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), "yyyy-MM-dd HH:mm:ss")


def millis_to_utc(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def nanos_to_local(ns: Column, zone: str = ZONE) -> Column:
    """Nanoseconds since the epoch, number or digits, as local text."""
    micros = F.floor(ns.try_cast("decimal(38,0)") / 1000).cast("bigint")
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros(micros), zone), "yyyy-MM-dd HH:mm:ss")


def to_nanos(ts: Column) -> Column:
    return F.unix_micros(ts) * 1000


def seconds_to_hms(s: Column) -> Column:
    """Seconds as ``H:MM:SS``, with ``N day(s), `` before it from a day on."""
    whole = F.floor(s).cast("bigint")
    days = F.floor(whole / 86400).cast("bigint")
    rest = whole - days * 86400
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600).cast("bigint"), F.floor(rest % 3600 / 60).cast("bigint"), rest % 60)
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), F.when(days == 1, " day, ").otherwise(" days, "), clock))


def hms_to_seconds(text: Column) -> Column:
    """``H:MM:SS`` (any number of hour digits, days before it) or plain seconds as seconds."""
    days = F.coalesce(F.regexp_extract(text, "^(\\d+) days?, ", 1).try_cast("double"), F.lit(0.0))
    clock = F.split(F.regexp_replace(text, "^\\d+ days?, ", ""), ":")
    part = lambda i: F.get(clock, F.lit(i)).try_cast("double")
    return F.coalesce(text.try_cast("double"), days * 86400 + part(0) * 3600 + part(1) * 60 + part(2))


def norm_date(text: Column) -> Column:
    """The first ten characters before any ``T``; blank gives NULL."""
    return F.nullif(F.substring(F.split_part(F.trim(text), F.lit("T"), F.lit(1)), 1, 10), F.lit(""))


def parse_ts(text: Column) -> Column:
    """ISO date and time, with or without zone and fraction."""
    return F.try_to_timestamp(F.trim(text))


def loose_date(text: Column) -> Column:
    return F.to_date(parse_ts(text))


def local_times(local: Column, zone: str) -> Column:
    """What a local time (a timestamp without zone, read as UTC) may mean: (earlier, later, kind), in UTC.

    The offsets are those of the zone a day before and a day after. A time that the
    clocks repeat (``repeated``) has two meanings; one that they skip (``skipped``)
    has none, and is read with the offset from before the change, so it lies as far
    after the change as it would have; else (``plain``) both are the same.
    """
    day = F.expr("INTERVAL 1 DAY")
    guess = F.to_utc_timestamp(local, zone)
    offset = lambda at: F.unix_micros(F.from_utc_timestamp(at, zone)) - F.unix_micros(at)
    before, after = offset(guess - day), offset(guess + day)
    meaning = lambda o: F.timestamp_micros(F.unix_micros(local) - o)
    holds = lambda at: F.from_utc_timestamp(at, zone) == local
    first, second = F.least(meaning(before), meaning(after)), F.greatest(meaning(before), meaning(after))
    kind = F.when((before == after) | (holds(first) != holds(second)), "plain").when(holds(first), "repeated").otherwise("skipped")
    one = F.when(kind == "plain", guess).otherwise(F.when(kind == "skipped", meaning(before)).otherwise(first))
    return F.struct(one.alias("earlier"), F.when(kind == "repeated", second).otherwise(one).alias("later"), F.when(local.isNotNull(), kind).alias("kind"))


def loose_ts(text: Column, zone: str, later: bool = False) -> Column:
    """A timestamp; text without an offset is local to ``zone``: of a repeated hour the first pass is meant, or with ``later`` the second."""
    offset = text.rlike("(Z|[+-]\\d{2}:?\\d{2})$") & text.contains("T")
    meant = local_times(parse_ts(text), zone)
    return F.when(offset, parse_ts(text)).otherwise(meant["later" if later else "earlier"])


def day_month_year(text: Column) -> Column:
    """``DD-MM-YYYY`` in UTC; text already of that form passes."""
    return F.when(text.rlike("^\\d{2}-\\d{2}-\\d{4}$"), text).otherwise(F.date_format(parse_ts(text), "dd-MM-yyyy"))


def day_bound(text: Column, end: bool = False) -> Column:
    """A bare date as the start (or end) of its day in ISO form; other text passes."""
    return F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.concat(text, F.lit("T23:59:59Z" if end else "T00:00:00Z"))).otherwise(text)


def strict_iso(text: Column) -> Column:
    """ISO date and time without offset, normalised; NULL for anything else."""
    plain = ~text.rlike("(Z|[+-]\\d{2}:?\\d{2})$") & text.rlike("^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?)?$")
    return F.when(plain, F.date_format(parse_ts(text), "yyyy-MM-dd'T'HH:mm:ss"))


def default_window(start: Column, end: Column, as_of: Column, days: int = 365) -> tuple[Column, Column]:
    """Bounds with the last ``days`` days before ``as_of`` where they are open."""
    upper = F.coalesce(end, as_of)
    return F.coalesce(start, F.date_sub(upper.cast("date"), days).cast("timestamp")), upper


def strip_bearer(token: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(token), "(?i)^bearer\\s+", ""))


def as_json(text: Column, schema: str) -> Column:
    """(value, text): JSON text as a struct of the schema; text that isn't an object of it stays text."""
    parsed = F.when(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{"), F.from_json(text, schema))
    return F.struct(parsed.alias("value"), F.when(parsed.isNull(), text).alias("text"))


def whole(text: Column, least: int = 0) -> Column:
    """Whole number of ``least`` at least, else NULL."""
    n = text.try_cast("bigint")
    return F.when(n >= least, n)


def minmax_row(columns: dict[str, Column]) -> dict[str, Column]:
    """Each column scaled by the least and greatest of the row; a constant row gives 0."""
    values = [c.cast("double") for c in columns.values()]
    low, high = F.least(*values), F.greatest(*values)
    return {k: F.when(high == low, F.lit(0.0)).otherwise((c.cast("double") - low) / (high - low)) for k, c in columns.items()}


def weighted(weights: dict[str, float], values: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + F.lit(float(w)) * values[k]
    return total


# The scores' weights.
TRIVIA_WEIGHTS = {"avg_hint": -0.15, "avg_correct": 1.0, "avg_incorrect": -0.85}
GAME_WEIGHTS = {"avg_response": 0.15, "trips_per_game": -1.0, "avg_accuracy": 0.85}
FINAL_WEIGHTS = {"trivia": 0.6, "game": 0.4}
PLAYER_TYPES = {
    "socializer": {"total_home_path": 0.5, "total_outdoors_path": 0.5},
    "competitive": {"avg_score": 0.3, "sd_score": 0.05},
    "explorer": {"avg_playtime": 0.3, "avg_days": 0.15},
}
# Glucose ranges, inclusive.
RED = ((0.0, 2.6), (15.0, 20.0))
GREEN = ((4.5, 8.0),)


def in_ranges(value: Column, ranges: tuple[tuple[float, float], ...]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | value.between(low, high)
    return out


def glucose_colour(value: Column) -> Column:
    return F.when(in_ranges(value, RED), "red").when(in_ranges(value, GREEN), "green").otherwise("other")


def coach_tier(avg_steps: Column, tiers: Column) -> Column:
    """The first of ``tiers``, an array of structs with ``below`` in ascending order, whose bound is above the average or NULL."""
    return F.get(F.filter(tiers, lambda t: t["below"].isNull() | (avg_steps < t["below"])), F.lit(0))
