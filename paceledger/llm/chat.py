"""Chat formatting by schema fingerprints.

Records come as JSON in any of several layouts (rows of messages, prompt and
completion, instruction and output, ...). Of a record's nested field paths those
that any mapping refers to are hashed to its fingerprint, whatever the values'
types and the other fields are; the fingerprint selects a declarative mapping,
which says where turns, roles and texts lie. Mappings are data: a mapping's own
paths give its fingerprint by the same expression. The canonical turns are
rendered with a template that marks turns and escapes its control strings inside
roles and texts, so the output can be read back exactly, and the loss mask spans
the assistant texts.

Tables of turns become struct records, whose layout is chosen once from their
schema; they are formatted without a JSON text between, so no size limit of the
JSON parser applies.

Only DataFrame functions are used; each record is formatted where it lies.

Nulls, empties, ties: null roles and texts are empty; an empty array of turns
has no turns; invalid JSON, null, a record that lacks a path of every mapping or
has those of two, and one whose array holds anything but objects have null layout
and no turns, and ``quarantined`` returns them; a message that lacks a field that
others have is empty there; JSON that the parser may have refused for its length raises an error; a
conversation is one record, so its rows meet in one task; rows with equal turn
numbers are ordered by role and text. Input columns named layout, turns,
formatted or loss_mask are replaced by the results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: an array at ``turns`` with ``role`` and ``text`` fields, or one field per turn in ``fields``."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> list[str]:
        return [f for _, f in self.fields] or [f"{self.turns}[]", f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]


MAPPINGS = (
    Mapping("turns", "turns", "role", "text"),
    Mapping("messages", "messages", "role", "content"),
    Mapping("from_value", "conversations", "from", "value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("dialogue", "dialogue", "speaker", "utterance"),
    Mapping("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("system_prompt_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction_output", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input_output", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question_answer", fields=(("user", "question"), ("assistant", "answer"))),
)


#: A text above this length makes the JSON parser give NULL, and so does a record above 128 MiB.
JSON_CHARS = 20_000_000


def _has(value: Column, name: str) -> Column:
    """True where an object has the field, whatever its value is."""
    return F.try_variant_get(value, f"$.{name}", "variant").isNotNull()


def known_paths(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Those nested field paths of a JSON record that a mapping refers to; none for invalid JSON.

    The record's variant is asked for each path, so names are compared as they are.
    An array with an element that isn't an object has a path of its own, which no
    mapping has.
    """
    v = F.try_parse_json(record)
    none = F.array().cast("array<string>")
    held = lambda condition, path: F.when(condition, F.array(F.lit(path))).otherwise(none)
    parts = [held(_has(v, f), f) for f in dict.fromkeys(f for m in mappings for _, f in m.fields)]
    for name in dict.fromkeys(m.turns for m in mappings if m.turns):
        rows = F.try_variant_get(v, f"$.{name}", "array<variant>")
        objects = F.forall(rows, lambda e: F.coalesce(F.schema_of_variant(e).startswith("OBJECT<"), F.lit(False)))
        parts += [held(objects, f"{name}[]"), held(~objects, f"{name}[] of other things")]
        parts += [held(F.exists(rows, lambda e: _has(e, w)), f"{name}[].{w}") for w in dict.fromkeys(f for m in mappings if m.turns == name for f in (m.role, m.text))]  # noqa: B023
    return F.array_sort(F.concat(*parts))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def layouts(spark: SparkSession, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(_print, _layout): a row per mapping, and one more for an empty array of turns; bounded by the mappings."""
    rows = [(m.name, m.paths) for m in mappings] + [(m.name, [f"{m.turns}[]"]) for m in mappings if m.turns]
    return spark.createDataFrame(rows, "_layout string, paths array<string>").select(fingerprint(F.col("paths")).alias("_print"), "_layout")


def typed_mapping(schema: StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """The mapping of struct records of this schema, by the same nested field paths."""
    found = set()
    for f in schema.fields:
        if isinstance(f.dataType, ArrayType):
            inner = f.dataType.elementType
            found |= {f"{f.name}[]", *(f"{f.name}[].{x}" for x in (inner.names if isinstance(inner, StructType) else ()))}
        else:
            found.add(f.name)
    known = {p for m in mappings for p in m.paths}
    return next((m for m in mappings if found & known == set(m.paths)), None)


def _turns(m: Mapping, record: Column, typed: bool = False) -> Column:
    if typed:
        return _canonical(m, lambda f: record[f].cast("string"), record[m.turns] if m.turns else None)
    v = F.try_parse_json(record)
    rows = F.try_variant_get(v, f"$.{m.turns}", f"array<struct<`{m.role}`:string,`{m.text}`:string>>") if m.turns else None
    return _canonical(m, lambda f: F.try_variant_get(v, f"$.{f}", "string"), rows)


def _canonical(m: Mapping, at: Callable[[str], Column], rows: Column | None) -> Column:
    if m.fields:
        return F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(at(f), F.lit("")).alias("text")) for r, f in m.fields])

    def turn(x: Column) -> Column:
        role = F.coalesce(x[m.role], F.lit(""))
        for old, new in m.roles.items():
            role = F.when(role == old, new).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text"))

    return F.coalesce(F.transform(rows, turn), F.array().cast(f"array<{TURN}>"))


def canonical(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records``, of JSON texts or structs, with layout and turns, an array of (role, text)."""
    none = F.array().cast(f"array<{TURN}>")
    others = [c for c in records.columns if c not in ("layout", "turns")]
    if isinstance(schema := records.schema[record].dataType, StructType):
        m = typed_mapping(schema, mappings)
        held = F.col(record).isNotNull()
        turns = F.when(held, _turns(m, F.col(record), True) if m else none).otherwise(none)
        return records.select(*others, F.when(held, F.lit(m.name if m else None).cast("string")).alias("layout"), turns.alias("turns"))
    refused = F.col(record).isNotNull() & (F.length(record) > JSON_CHARS) & F.try_parse_json(record).isNull()
    why = F.concat(F.lit("a JSON record doesn't parse, maybe for its length, of characters: "), F.length(record))
    parsed = F.when(refused, F.raise_error(why)).otherwise(fingerprint(known_paths(F.col(record), mappings)))
    found = records.select(*others, parsed.alias("_fp")).join(F.broadcast(layouts(records.sparkSession, mappings)), F.col("_fp") == F.col("_print"), "left")
    turns = none
    for m in mappings:
        turns = F.when(F.col("_layout") == m.name, _turns(m, F.col(record))).otherwise(turns)
    return found.select(*others, F.col("_layout").alias("layout"), turns.alias("turns"))


OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"


def escape(text: Column) -> Column:
    """Backslash, #, < and : become two characters, so neither a turn's opening nor its end can occur inside."""
    for plain, code in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Undo ``escape``: doubled backslashes are set apart first, from the left, then the other codes are replaced."""

    def plain(part: Column) -> Column:
        for code, char in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            part = F.replace(part, F.lit(code), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, "\\\\\\\\"), plain), "\\")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE))), "")


def format_chats(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS, trained: str = "assistant") -> DataFrame:
    """``records`` with layout, turns, formatted and loss_mask: spans (start, length), in code points of formatted, of the trained role's texts."""
    return rendered(canonical(records, record, mappings), trained)


def quarantined(formatted: DataFrame) -> DataFrame:
    """The records that no mapping fits, of what ``format_chats`` returned."""
    return formatted.where("layout IS NULL")


def rendered(canonical_chats: DataFrame, trained: str = "assistant") -> DataFrame:
    """Canonical chats (turns, ...) with formatted and loss_mask."""
    out = canonical_chats.withColumn("formatted", render(F.col("turns")))
    sizes = F.transform("turns", lambda t: F.struct((t["role"] == trained).alias("on"), (F.length(escape(t["role"])) + len(OPEN) + len(MIDDLE)).alias("head"), F.length(escape(t["text"])).alias("body")))
    out = out.withColumn("_sizes", sizes)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, s: F.struct(
        (a["at"] + s["head"] + s["body"] + len(CLOSE)).alias("at"),
        F.when(s["on"], F.concat(a["spans"], F.array(F.struct((a["at"] + s["head"]).alias("start"), s["body"].alias("length"))))).otherwise(a["spans"]).alias("spans"),
    )
    return out.withColumn("loss_mask", F.aggregate("_sizes", zero, step, lambda a: a["spans"])).drop("_sizes")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    rows = F.split(formatted, CLOSE)
    rows = F.slice(rows, F.lit(1), F.size(rows) - 1)
    return F.transform(
        rows,
        lambda r: F.struct(
            unescape(F.substring_index(F.substr(r, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
            unescape(F.substr(r, F.locate(MIDDLE, r) + len(MIDDLE))).alias("text"),
        ),
    )


def masked(formatted: Column, spans: Column) -> Column:
    """All text under a loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def from_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, record): conversations given by turn (conv_id, turn, role, text) as struct records of layout ``turns``."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(turn))
    turns = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(F.struct(turns.alias("turns")).alias("record"))


def mixed_layouts(chats: DataFrame) -> DataFrame:
    """(conv_id, record, json): struct records of layout ``turns``, those of most conversations as JSON of a layout that their id picks.

    Conversations of a user's and an assistant's turn may be one prompt with its
    response; fields that no mapping knows come along. What is too long for the
    JSON parser stays a struct. Just one of record and json isn't null.
    """
    turns = F.col("record.turns")
    named = lambda role, text: F.transform(turns, lambda t: F.struct(t["role"].alias(role), t["text"].alias(text), F.lit(1).alias("weight")))
    pick = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    asked = (F.size(turns) == 2) & (turns[0]["role"] == "user") & (turns[1]["role"] == "assistant")
    made = (
        F.when(asked & (pick < 2), F.to_json(F.struct(F.col("conv_id").alias("id"), turns[0]["text"].alias("prompt"), turns[1]["text"].alias("response"))))
        .when(pick == 0, F.to_json(F.struct(F.col("conv_id").alias("id"), named("role", "content").alias("messages"))))
        .when(pick == 1, F.to_json(F.struct(named("speaker", "utterance").alias("dialogue"), F.struct(F.lit("chat").alias("kind")).alias("meta"))))
        .when(pick == 2, F.to_json(F.struct(named("role", "text").alias("turns"))))
    )
    long = F.aggregate(turns, F.lit(0).cast("bigint"), lambda a, t: a + F.length(t["text"]) + F.length(t["role"])) > JSON_CHARS // 4
    return chats.withColumn("json", F.when(~long, made)).select("conv_id", F.when(F.col("json").isNull(), F.col("record")).alias("record"), "json")


PLANTED = (-7, "\\### Assistant: </turn> ok")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as records of several layouts, which their fingerprints tell apart, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(PLANTED[0], i, role, PLANTED[1]) for i, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    records = mixed_layouts(from_rows(rows.unionByName(extra)))
    typed = canonical(records, "record").withColumnsRenamed({"layout": "_typed_layout", "turns": "_typed"})
    chats = canonical(typed, "json").withColumn("turns", F.when(F.col("json").isNull(), F.col("_typed")).otherwise(F.col("turns")))
    out = rendered(chats.select("conv_id", "turns"))
    out = out.select("conv_id", "formatted", "loss_mask").withColumn("back", read_back(F.col("formatted"))).withColumn("loss", masked(F.col("formatted"), F.col("loss_mask")))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
t AS (
  SELECT *, length(role) + length(role) - length(translate(role, '\#<:', '')) + length(text) + length(text) - length(translate(text, '\#<:', '')) + 15 AS chars FROM r
),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, sum(chars) AS chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
