"""Redaction: expressions generated by walking a schema, and a walk of the tokens of schemaless JSON text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceledger.session import ship_package

TOKEN = "***redacted***"
# Names whose values are secrets or identify a person.
SECRET_KEYS = ("authorization", "auth_bearer", "access_token", "token", "api_key", "apikey")
PII_KEYS = ("user_id", "email", "player_id", "account_user_id", "external_user_id")
PROVENANCE_KEYS = ("player_id", "account_user_id", "external_user_id", "user_id", "email")


def secret_value(value: Column) -> Column:
    """The mask of a secret; a bearer token keeps its scheme."""
    return F.when(F.lower(F.trim(value.cast("string"))).startswith("bearer "), F.lit(f"Bearer {TOKEN}")).otherwise(F.lit(TOKEN))


def _mask(value: Column, kind: T.DataType) -> Column:
    return F.lit(TOKEN)


def _mask_secret(value: Column, kind: T.DataType) -> Column:
    return secret_value(value) if isinstance(kind, T.StringType) else F.lit(TOKEN)


def nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def redact_keys(df: DataFrame, keys: tuple[str, ...], mask: Callable[[Column, T.DataType], Column] = _mask) -> DataFrame:
    """Mask every field and map key named in ``keys`` (trimmed, any case) at any depth, through arrays and maps.

    A masked field becomes a string, and so do the values of a map of scalars. A map's
    values share a type, so a struct, array or map under a named key becomes NULL.
    """

    def walk(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            if not touched(kind):
                return value
            fields = [(mask(value[f.name], f.dataType) if named(f.name) else walk(value[f.name], f.dataType)).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.ArrayType) and touched(kind.elementType):
            return F.transform(value, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType):
            hit = lambda k: F.lower(F.trim(k.cast("string"))).isin(*keys)
            if nested(kind.valueType):
                return F.transform_values(value, lambda k, v: F.when(~hit(k), walk(v, kind.valueType)))
            return F.transform_values(value, lambda k, v: F.when(hit(k), mask(v, kind.valueType)).otherwise(v.cast("string")))
        return value

    def named(name: str) -> bool:
        return name.strip().lower() in keys

    def touched(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(named(f.name) or touched(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return touched(kind.elementType)
        return isinstance(kind, T.MapType)

    return df.select(*[(mask(F.col(f.name), f.dataType) if named(f.name) else walk(F.col(f.name), f.dataType)).alias(f.name) for f in df.schema.fields])


def redact_secrets(df: DataFrame) -> DataFrame:
    return redact_keys(df, SECRET_KEYS, _mask_secret)


def redact_pii(df: DataFrame) -> DataFrame:
    return redact_keys(df, PII_KEYS)


def redact_paths(df: DataFrame, paths: list[str | None], when: Callable[[str], Column] | None = None) -> DataFrame:
    """Mask dotted paths through structs, arrays and maps; unknown, blank or non-text paths do nothing.

    A masked value and its siblings in a map become strings; nested ones in a map become JSON text.

    ``when`` gives a condition per path, for frames whose rows redact different paths.
    """
    for path in paths:
        if not isinstance(path, str) or not path.strip():
            continue
        parts = path.split(".")
        if not exists(df.schema, parts):
            continue
        kind = df.schema[parts[0]].dataType
        masked = _at(F.col(parts[0]), kind, parts[1:], when(path) if when else None)
        df = df.withColumn(parts[0], masked)
    return df


def _at(value: Column, kind: T.DataType, parts: list[str], cond: Column | None) -> Column:
    if not parts:
        text = F.to_json(value) if nested(kind) else value.cast("string")
        return F.lit(TOKEN) if cond is None else F.when(cond, F.lit(TOKEN)).otherwise(text)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _at(x, kind.elementType, parts, cond))
    if isinstance(kind, T.MapType):
        wanted = F.lit(True) if cond is None else cond
        return F.transform_values(value, lambda k, v: _at(v, kind.valueType, parts[1:], wanted & (k.cast("string") == parts[0])))
    inner = kind[parts[0]].dataType
    return F.when(value.isNotNull(), value.withField(f"`{parts[0]}`", _at(value[parts[0]], inner, parts[1:], cond)))


def exists(kind: T.DataType, parts: list[str]) -> bool:
    if not parts:
        return True
    if isinstance(kind, T.ArrayType):
        return exists(kind.elementType, parts)
    if isinstance(kind, T.MapType):
        return exists(kind.valueType, parts[1:])
    return isinstance(kind, T.StructType) and parts[0] in kind.names and exists(kind[parts[0]].dataType, parts[1:])


def redaction_count(df: DataFrame, paths: list[str | None]) -> Column:
    """How many nodes ``redact_paths`` masks in a row: one per path, or one per array element that it reaches."""

    def count(value: Column, kind: T.DataType, parts: list[str]) -> Column:
        if isinstance(kind, T.ArrayType) and parts:
            return F.coalesce(F.aggregate(value, F.lit(0), lambda a, x: a + count(x, kind.elementType, parts)), F.lit(0))
        if not parts:
            return F.lit(1)
        if isinstance(kind, T.MapType):
            return F.when(F.map_contains_key(value, F.lit(parts[0]).cast(kind.keyType)), count(value[F.lit(parts[0]).cast(kind.keyType)], kind.valueType, parts[1:])).otherwise(0)
        return F.when(value.isNotNull(), count(value[parts[0]], kind[parts[0]].dataType, parts[1:])).otherwise(0)

    total = F.lit(0)
    for path in paths:
        if isinstance(path, str) and path.strip() and exists(df.schema, parts := path.split(".")):
            total = total + count(F.col(parts[0]), df.schema[parts[0]].dataType, parts[1:])
    return total


def redact_json_keys(text: Column, keys: tuple[str, ...] = SECRET_KEYS, bearer: bool = True) -> Column:
    """JSON text with every value under a key of ``keys`` masked, at any depth; all other characters stay as they are.

    Keys count unescaped, trimmed and in any case. A masked value may be of any
    kind, objects and arrays included, and becomes a string; with ``bearer`` a
    bearer token keeps its scheme. Of a key that occurs twice both values are
    masked. Text that isn't JSON, or is nested too deeply to be read, is masked
    whole; NULL stays NULL. A value's place in schemaless text has no column
    expression, so this is one Arrow function; typed columns have ``redact_keys``.
    """
    ship_package(SparkSession.active())
    mask = F.udf(lambda t: mask_json(t, frozenset(keys), bearer), "string", useArrow=True)
    return mask(text)


#: A string, a bracket, or a run of anything else that is neither.
_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s"\[\]{},:]+', re.DOTALL)


def mask_json(text: str | None, keys: frozenset[str], bearer: bool = True) -> str | None:
    """``redact_json_keys`` of one text: its tokens are walked once, and what lies between masked values is copied."""
    if text is None:
        return None
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return TOKEN
    out: list[str] = []
    copied = 0
    tokens = _JSON_TOKEN.finditer(text)
    before = None
    for token in tokens:
        if token[0] == ":" and json.loads(before[0], strict=False).strip().lower() in keys:
            value = next(tokens)
            start, end, depth = value.start(), value.end(), value[0] in ("{", "[")
            while depth:
                inner = next(tokens)
                depth += (inner[0] in ("{", "[")) - (inner[0] in ("}", "]"))
                end = inner.end()
            plain = json.loads(value[0]) if value[0].startswith('"') else ""
            kept = "Bearer " if bearer and plain.strip().lower().startswith("bearer ") else ""
            out += [text[copied:start], f'"{kept}{TOKEN}"']
            copied = end
            token = value
        before = token
    return "".join(out) + text[copied:]


def minimize_provenance(provenance: Column, keys: tuple[str, ...] = PROVENANCE_KEYS) -> Column:
    return F.map_filter(provenance, lambda k, v: ~k.isin(*keys))


def sanitize_args(args: Column) -> Column:
    """Mask a flat map's secret keys."""
    return F.transform_values(args, lambda k, v: F.when(F.lower(F.trim(k)).isin(*SECRET_KEYS), F.lit(TOKEN)).otherwise(v))


def find_first(value: Column, kind: T.DataType, name: str) -> Column | None:
    """The first scalar named ``name`` (trimmed, any case), as text: a struct's or map's own before those of its children, in order; None if the type has no place for one."""
    same = lambda key: key.strip().lower() == name
    found: list[Column] = []
    if isinstance(kind, T.StructType):
        found = [value[f.name].cast("string") for f in kind.fields if same(f.name) and not nested(f.dataType)]
        found += [c for f in kind.fields if (c := find_first(value[f.name], f.dataType, name)) is not None]
    elif isinstance(kind, T.MapType):
        if not nested(kind.valueType):
            hits = F.filter(F.map_entries(value), lambda e: F.lower(F.trim(e["key"])) == name)
            return F.get(hits, F.lit(0))["value"].cast("string") if isinstance(kind.keyType, T.StringType) else None
        return find_first(F.map_values(value), T.ArrayType(kind.valueType), name)
    elif isinstance(kind, T.ArrayType):
        if find_first(F.lit(None), kind.elementType, name) is None:
            return None
        hits = F.filter(F.transform(value, lambda x: find_first(x, kind.elementType, name)), lambda x: x.isNotNull())
        return F.get(hits, F.lit(0))
    return F.coalesce(*found) if found else None


def subject_hash(user_id: Column, salt: str) -> Column:
    """Sixteen hex digits of a salted hash; NULL without salt or id, or if the id is masked already."""
    uid = user_id.cast("string")
    if not salt.strip():
        return F.lit(None).cast("string")
    return F.when(uid != TOKEN, F.substring(F.sha2(F.concat(F.lit(f"{salt.strip()}:"), uid), 256), 1, 16))
