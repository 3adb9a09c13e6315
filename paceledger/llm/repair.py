"""Conversation structure repair: the cheapest edits that give alternating turns, and of equal ones the least audit.

Rows of a conversation are read in order of turn. A row is faulty if it is blank,
repeats the role and text of an earlier one, or is cut off before a sentence's
end. Edits keep, re-role or delete a row or insert an empty turn; the repaired
roles must read ``(s?(ua)+)?`` by their initials. The edits' initials in order
are the audit, and of all cheapest audits the ASCII-least is taken.

1. Cost: a dynamic programme over (rows read, state of the role pattern).
2. Path ranking by prefix doubling: each node's optimal arcs carry their edit's
   initial. Nodes are ranked by the least initial first, then by least audits of
   2, 4, 8, ... letters: a node's rank and that of the node its pointer leads to
   give the rank of twice the length, and pointers double alike. The arcs that
   leave a node have different letters, so the least arc is decided by rank, and
   the doubled pointers put the least path together from its halves.

A conversation of any length is split: rows are ordered by range over all tasks,
numbered, and cut into segments of SEGMENT rows at most. A segment's cost matrix
(from state to state) is computed where it lies; one pass over these matrices,
from the last to the first, gives every segment the costs ahead of it. Then each
segment finds its least path for each state that it may be entered in, and a pass
from the first to the last picks one. The two passes see a matrix or four short
audits per segment, never the rows. Texts meet their edits by a join on the row's
number. So no conversation is gathered; only the digest of one conversation's
whole text must be made in order, which one task does as a stream.

Nulls, empties, ties: null roles and texts are one space; null turns come first;
rows with equal turns are ordered by role and the text's hash, and of equal rows
the first is the original and the others repeat it; null conv_ids are one
conversation; a role without an s, u or a in front can't be kept; a conversation
without rows is the empty audit. Texts are compared by SHA-256, and no text is
gathered, however long. Other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceledger.session import discard, materialize

FILLED = "[^\\x20\\x09-\\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
SEGMENT = 8192
#: Nodes that are solved together: segments are grouped until they hold so many.
TOGETHER = 1 << 20
#: States of the role pattern: nothing yet, after s, after u, after a; it may end in the first and the last.
START, S, U, A = range(4)
FAR = np.int64(1 << 40)
ENDS = np.array([0, FAR, FAR, 0])
#: The state after a re-roled or inserted turn, which is a user's unless a user has just spoken, and that after a kept row by its initial; -1: not allowed.
STEP = np.array([U, U, A, U])
KEEP = np.array([[S, -1, -1, -1], [U, U, -1, U], [-1, -1, A, -1], [-1, -1, -1, -1]])
#: Bits of a row's code: its initial (s, u, a, other), must be deleted, cut off.
INITIAL, GONE, SHORT = 3, 4, 8
LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)


# ---- rows -----------------------------------------------------------------------------------------------------
def classify(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) in order, numbered by ``pos``, with their fault (blank, duplicate, truncated or null) and code."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    work = rows.select("conv_id", "turn", space("role"), space("text")).withColumn("hash", F.sha2("text", 256)).withColumn("row", F.monotonically_increasing_id())
    work = materialize(work, "turns")
    # of the rows of one role and text the first in order is the original
    first = work.groupBy("conv_id", "role", "hash").agg(F.min(F.struct("turn", "row")).alias("first")).select(F.col("first.row").alias("_row"))
    marked = work.join(first, F.col("row") == F.col("_row"), "left")
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(~F.col("text").rlike(FILLED), "blank").when(F.col("_row").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    head = F.substring("role", 1, 1)
    initial = F.when(head == "s", 0).when(head == "u", 1).when(head == "a", 2).otherwise(INITIAL)
    flags = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", SHORT).otherwise(0)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "hash", "row"]
    marked = marked.withColumn("fault", fault).withColumn("code", (initial + flags).cast("tinyint"))
    placed = marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    ordered = materialize(placed.select("conv_id", "turn", "role", "text", "fault", "code", "pos"), "ordered")
    discard(work)
    return ordered


def segments(ordered: DataFrame) -> DataFrame:
    """(conv_id, seg, pos, codes): runs of at most SEGMENT rows of a conversation; pos is the first row's number, and those after it follow one by one."""
    row = F.struct("pos", "code")
    runs = ordered.groupBy("conv_id", (F.col("pos") - F.col("pos") % SEGMENT).alias("seg")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return runs.select("conv_id", "seg", F.col("rows")[0]["pos"].alias("pos"), F.transform("rows", lambda r: r["code"]).alias("codes"))


# ---- the programme inside segments ----------------------------------------------------------------------------
def _inserts(dist: np.ndarray) -> np.ndarray:
    """Costs after up to two inserted turns; a third would lead back."""
    one = np.minimum(dist, INSERT + dist[..., STEP])
    return np.minimum(dist, INSERT + one[..., STEP])


def costs(codes: np.ndarray, sizes: np.ndarray, ends: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least costs (row, segment, state) to the segments' ends, of codes (segment, row); segments come longest first.

    ``ends`` are the costs from the segments' ends on; turns are inserted there if the segment is its conversation's last.
    """
    n, rows = codes.shape
    dist = np.full((rows + 1, n, 4), FAR, dtype=np.int64)
    dist[sizes, np.arange(n)] = np.where(last[:, None], _inserts(ends), ends)
    for i in range(rows - 1, -1, -1):
        m = int(np.searchsorted(-sizes, -i))
        code, ahead = codes[:m, i], dist[i + 1, :m]
        extra = np.where(code & SHORT, CUT_OFF, 0)[:, None] + np.where(code & GONE, FAR, 0)[:, None]
        to = KEEP[code & INITIAL]
        kept = np.where(to >= 0, np.take_along_axis(ahead, np.maximum(to, 0), 1) + extra, FAR)
        best = np.minimum(np.minimum(ahead + DELETE, kept), ahead[:, STEP] + REROLE + extra)
        dist[i, :m] = _inserts(np.minimum(best, FAR))
    return dist


def arcs(codes: np.ndarray, sizes: np.ndarray, last: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letter, target) of each node's optimal arc with the least letter; 0 and the node itself at a path's end. Nodes are numbered (row, segment, state)."""
    n, rows = codes.shape
    own = np.arange((rows + 1) * n * 4).reshape(rows + 1, n, 4)
    inside = np.zeros((rows + 1, n, 1), dtype=bool)
    inside[:rows, :, 0] = np.arange(rows)[:, None] < sizes[None, :]
    code = np.zeros((rows + 1, n), dtype=np.int64)
    code[:rows] = codes.T
    extra = (np.where(code & SHORT, CUT_OFF, 0) + np.where(code & GONE, FAR, 0))[..., None]
    ahead, next_row = np.full_like(dist, FAR), own + n * 4
    ahead[:-1] = dist[1:]
    to = KEEP[code & INITIAL]
    keep_to = np.maximum(to, 0)
    at_end = (np.arange(rows + 1)[:, None] == sizes[None, :])[..., None] & last[None, :, None]
    q = np.arange(4)
    choices = [  # by letter: deleted, inserted, kept, re-roled
        (inside & (ahead + DELETE == dist), next_row),
        ((inside | at_end) & (dist[..., STEP] + INSERT == dist), own + (STEP - q)),
        (inside & (to >= 0) & (np.take_along_axis(ahead, keep_to, 2) + extra == dist), next_row + (keep_to - q)),
        (inside & (ahead[..., STEP] + REROLE + extra == dist), next_row + (STEP - q)),
    ]
    letter, target = np.zeros(dist.shape, dtype=np.int64), own.copy()
    for k in range(len(choices), 0, -1):
        optimal, where = choices[k - 1]
        optimal = optimal & (dist < FAR)
        letter, target = np.where(optimal, k, letter), np.where(optimal, where, target)
    return letter.reshape(-1), target.reshape(-1)


def least_paths(letter: np.ndarray, target: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least path's nodes from each start, (start, step): ranks of audits of 1, 2, 4, ... letters with pointers as far ahead."""
    rank, pointer, path = letter, target, starts[:, None]
    while letter[path[:, -1]].any():
        path = np.concatenate([path, pointer[path]], axis=1)
        _, rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)
        pointer = pointer[pointer]
    return path


def solve(codes: list[np.ndarray], ends: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[str], np.ndarray]]:
    """(segment, exit states, least audits, costs), each by the state that the segment is entered in."""
    for group, padded, sizes in _groups(codes):
        dist = costs(padded, sizes, ends[group], last[group])
        letter, target = arcs(padded, sizes, last[group], dist)
        path = least_paths(letter, target, np.arange(len(group) * 4))
        text = LETTERS[letter[path]].reshape(len(group), 4, -1)
        out = path[:, -1].reshape(len(group), 4) % 4
        for k, segment in enumerate(group):
            yield segment, out[k], [t.tobytes().rstrip(b"\0").decode() for t in text[k]], dist[0, k] - np.where(last[segment], 0, ends[segment][out[k]])


def _groups(codes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of like length as (their numbers, padded codes, lengths), longest first."""
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    order, at = np.argsort(-sizes, kind="stable"), 0
    while at < len(order):
        n = max(1, TOGETHER // (4 * (int(sizes[order[at]]) + 1)))
        group = order[at : at + n]
        padded = np.zeros((len(group), int(sizes[group[0]])), dtype=np.int64)
        for k, s in enumerate(group):
            padded[k, : sizes[s]] = codes[s]
        yield group, padded, sizes[group]
        at += n


# ---- from segment to segment ----------------------------------------------------------------------------------
def _codes(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.asarray(c.values.to_numpy(zero_copy_only=False), dtype=np.int64) for c in batch["codes"]]


def _added(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def with_matrix(runs: DataFrame) -> DataFrame:
    """Segments with ``matrix``: least costs from each state at the start to each at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(batch)
            found = np.zeros((len(codes), 4, 4), dtype=np.int64)
            for group, padded, sizes in _groups(codes):
                for to in range(4):
                    ends = np.full((len(group), 4), FAR, dtype=np.int64)
                    ends[:, to] = 0
                    found[group, :, to] = np.minimum(costs(padded, sizes, ends, np.zeros(len(group), dtype=bool))[0], FAR)
            yield _added(batch, {"matrix": pa.array(list(found.reshape(-1, 16)), pa.list_(pa.int64()))})

    return runs.mapInArrow(run, "conv_id bigint, seg bigint, pos bigint, codes array<tinyint>, matrix array<bigint>")


def with_ahead(runs: DataFrame) -> DataFrame:
    """Segments with ``ends``, the costs from their end on, and whether they are the last: one pass per conversation from its last segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ahead = object(), ENDS
        for batch in batches:
            ends, last = [], []
            for own, matrix in zip(batch["conv_id"].to_pylist(), batch["matrix"], strict=True):
                last.append(own != conv)
                ahead = ENDS if own != conv else ahead
                ends.append(ahead)
                begin = _inserts(ahead[None, :])[0] if own != conv else ahead
                ahead = np.minimum((np.array(matrix.as_py()).reshape(4, 4) + begin[None, :]).min(axis=1), FAR)
                conv = own
            rest = pa.RecordBatch.from_arrays(batch.columns[:4], batch.schema.names[:4])
            yield _added(rest, {"ends": pa.array(ends, pa.list_(pa.int64())), "last": pa.array(last, pa.bool_())})

    ordered = runs.repartition("conv_id").sortWithinPartitions("conv_id", F.col("seg").desc())
    return ordered.mapInArrow(run, "conv_id bigint, seg bigint, pos bigint, codes array<tinyint>, ends array<bigint>, last boolean")


def with_audits(runs: DataFrame) -> DataFrame:
    """Segments with exits, audits and costs, by the state they are entered in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, n = _codes(batch), batch.num_rows
            ends = np.asarray(batch["ends"].flatten().to_numpy(), dtype=np.int64).reshape(n, 4)
            last = np.array(batch["last"].to_pylist(), dtype=bool)
            found = {s: (out.tolist(), audits, cost.tolist()) for s, out, audits, cost in solve(codes, ends, last)}
            exits, audits, cost = (pa.array([found[s][k] for s in range(n)], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.string(), pa.int64())))
            rest = pa.RecordBatch.from_arrays(batch.columns[:4], batch.schema.names[:4])
            yield _added(rest, {"exits": exits, "audits": audits, "costs": cost})

    return runs.repartition("conv_id", "seg").mapInArrow(run, "conv_id bigint, seg bigint, pos bigint, codes array<tinyint>, exits array<int>, audits array<string>, costs array<bigint>")


def chained(runs: DataFrame) -> DataFrame:
    """Segments with the audit and cost of the state they are entered in, that state, and their pairs of initials that aren't allowed: one pass from the first."""
    legal = np.zeros((4, 4), dtype=bool)
    legal[[0, 1, 2], [1, 2, 1]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, before = object(), START, None
        for batch in batches:
            chosen: dict[str, list] = {"entry": [], "audit": [], "cost": [], "illegal": []}
            rows = zip(batch["conv_id"].to_pylist(), _codes(batch), batch["exits"].to_pylist(), batch["audits"], batch["costs"].to_pylist(), strict=True)
            for own, codes, exits, audits, cost in rows:
                if own != conv:
                    conv, state, before = own, START, None
                initials = codes & INITIAL
                bad = int((~legal[initials[:-1], initials[1:]]).sum()) + (before is not None and not legal[before, initials[0]])
                for k, v in (("entry", state), ("audit", audits[state].as_py()), ("cost", cost[state]), ("illegal", bad)):
                    chosen[k].append(v)
                state, before = exits[state], initials[-1]
            rest = pa.RecordBatch.from_arrays(batch.columns[:4], batch.schema.names[:4])
            kinds = {"entry": pa.int32(), "audit": pa.string(), "cost": pa.int64(), "illegal": pa.int64()}
            yield _added(rest, {k: pa.array(v, kinds[k]) for k, v in chosen.items()})

    ordered = runs.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return ordered.mapInArrow(run, "conv_id bigint, seg bigint, pos bigint, codes array<tinyint>, entry int, audit string, cost bigint, illegal bigint")


def plan(ordered: DataFrame) -> DataFrame:
    """(conv_id, seg, pos, codes, entry, audit, cost, illegal): the least audit of every segment, on the cheapest way through its conversation."""
    return materialize(chained(with_audits(with_ahead(with_matrix(segments(ordered))))), "audits")


# ---- edits ----------------------------------------------------------------------------------------------------
def edits(ordered: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, seg, step, edit, turn, role, text), in order of seg and step: each edit with the row as it leaves it; an inserted row has no turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "seg", "step", "edit", "_pos", "_role"]
        for batch in batches:
            for conv, seg, pos, codes, entry, audit in zip(batch["conv_id"], batch["seg"], batch["pos"].to_pylist(), _codes(batch), batch["entry"].to_pylist(), batch["audit"].to_pylist(), strict=True):
                if not audit:
                    continue
                state, row, places, roles = entry, 0, [], []
                for letter in audit:
                    places.append(None if letter == "I" else pos + row)
                    roles.append(("assistant" if STEP[state] == A else "user") if letter in "IR" else None)
                    if letter != "D":
                        state = STEP[state] if letter in "IR" else KEEP[codes[row] & INITIAL, state]
                    row += letter != "I"
                n = len(audit)
                columns = [pa.array([x.as_py()] * n, pa.int64()) for x in (conv, seg)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(n), pa.int32()), pa.array(list(audit)), pa.array(places, pa.int64()), pa.array(roles, pa.string())], names)

    made = planned.mapInArrow(run, "conv_id bigint, seg bigint, step int, edit string, _pos bigint, _role string")
    rows = ordered.select("pos", "turn", "role", "text")
    out = made.where("edit <> 'I'").join(rows, F.col("_pos") == F.col("pos"))
    out = out.select("conv_id", "seg", "step", "edit", "turn", F.coalesce("_role", "role").alias("role"), "text")
    none = made.where("edit = 'I'").select("conv_id", "seg", "step", "edit", F.lit(None).cast("bigint").alias("turn"), F.col("_role").alias("role"), F.lit("").alias("text"))
    return out.unionByName(none)


def digests(made: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text`` of the rows that stay, newline-joined: each conversation streams through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            ids, hashes = [], []
            for own, line in zip(batch["conv_id"].to_pylist(), batch["line"], strict=True):
                if state is None or own != conv:
                    if state is not None:
                        ids.append(conv)
                        hashes.append(state.hexdigest())
                    conv, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    stay = made.where("edit <> 'D'").select("conv_id", "seg", "step", F.concat_ws(":", "role", "text").alias("line"))
    return stay.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "step").mapInArrow(run, "conv_id bigint, sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, faults per conversation) of rows (conv_id, turn, role, text). The repaired rows are the edits other than D."""
    ordered = classify(rows)
    planned = plan(ordered)
    return edits(ordered, planned), report(ordered, planned)


def report(ordered: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)."""
    fault = lambda name: F.count_if(F.col("fault") == name).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint")
    faults = ordered.groupBy("conv_id").agg(gaps.alias("gaps"), fault("blank"), fault("duplicate"), fault("truncated"))
    parts = F.array_sort(F.collect_list(F.struct("seg", "audit")))
    audit = F.array_join(F.transform(parts, lambda p: p["audit"]), "")
    ways = planned.groupBy(F.col("conv_id").alias("_conv")).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    return faults.join(ways, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


# ---- the query ------------------------------------------------------------------------------------------------
def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with one row in twenty each dropped, emptied, left without sentence ends, repeated or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    out = rows.select("conv_id", "turn", F.when(pick == 4, "user").otherwise(text("role")).alias("role"), _damaged_text(pick, text("text")).alias("text"), pick.alias("_pick"))
    copies = F.when(F.col("_pick") == 0, 0).when(F.col("_pick") == 3, 2).otherwise(1)
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("_copy", "_pick")


def _damaged_text(pick: Column, text: Column) -> Column:
    return F.when(pick == 1, "").when(pick == 2, F.translate(text, ".!?", "")).otherwise(text)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    made, found = repair(damaged(rows))
    hashes = digests(made).withColumnRenamed("conv_id", "_conv")
    every = rows.select(F.col("conv_id").alias("_id")).distinct()
    out = every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return out.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256"))


def _sql() -> str:
    """The damage, the faults and the programme by a recursion over rows; a state is (cost, audit, repaired lines), so the least of two is the better one."""

    def edit(state: str, cost: str, letter: str, line: str | None) -> str:
        lines = f"{state}.o" if line is None else f"list_append({state}.o, {line})"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {lines}}}"

    def least(*states: str) -> str:
        return f"list_sort([{', '.join(states)}])[1]"

    def allowed(state: str, letter: str, cost: str, line: str, when: str) -> str:
        return edit(state, f"{cost} + CASE WHEN {when} THEN 0 ELSE 1000000000 END", letter, line)

    keep = lambda state, initial: allowed(state, "K", "short", "line", f"NOT gone AND initial = '{initial}'")
    rerole = lambda state, role: allowed(state, "R", f"{REROLE} + short", f"'{role}:' || text", "NOT gone")
    insert = lambda state, role: edit(state, str(INSERT), "I", f"'{role}:'")
    drop = lambda state: edit(state, str(DELETE), "D", None)
    closed = f"""s0, s1, {least('s2', insert('s0', 'user'), insert('s1', 'user'), insert('s3', 'user'))} AS s2,
    {least('s3', insert('s2', 'assistant'), edit(insert('s0', 'user'), str(INSERT), 'I', "'assistant:'"), edit(insert('s1', 'user'), str(INSERT), 'I', "'assistant:'"))} AS s3"""
    far = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}"
    return rf"""
WITH RECURSIVE tbl AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) AS r(i)) AS q),
picked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS pick FROM conversations, tbl),
harmed AS (
  SELECT conv_id, turn, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role, CASE pick WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE pick WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM picked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM harmed),
judged AS MATERIALIZED (
  SELECT conv_id, turn, text, i, role || ':' || text AS line, left(role, 1) AS initial, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following,
    CASE WHEN cut = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
coded AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {CUT_OFF} ELSE 0 END AS short FROM judged),
ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {closed} FROM (
    SELECT DISTINCT conv_id, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM coded) AS q
  UNION ALL
  SELECT conv_id, i, {closed} FROM (
    SELECT c.conv_id, c.i, {drop('s0')} AS s0, {least(drop('s1'), keep('s0', 's'))} AS s1,
      {least(drop('s2'), *[keep(x, 'u') for x in ('s0', 's1', 's3')], *[rerole(x, 'user') for x in ('s0', 's1', 's3')])} AS s2,
      {least(drop('s3'), keep('s2', 'a'), rerole('s2', 'assistant'))} AS s3
    FROM ways AS w JOIN coded AS c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND c.i = w.i + 1) AS q),
ended AS (SELECT conv_id, {least('s0', 's3')} AS way FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM ways) AS q WHERE k = 1),
found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(way.c, 0) AS cost, coalesce(way.a, '') AS audit, sha256(coalesce(array_to_string(way.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN found AS f ON a.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN ended AS e ON a.conv_id IS NOT DISTINCT FROM e.conv_id"""


OP11_SQL = _sql()
