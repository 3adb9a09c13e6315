"""Vector code compression by product quantisation with active-entry Lloyd rounds.

Components become integers floor(1024 * x) and a vector is cut into PARTS equal
consecutive parts, each with a codebook of ENTRIES entries that starts as that
part of the vectors with the smallest ids. A Lloyd round assigns every part to
its nearest entry (squared distance, ties to the lower index) and replaces each
entry by the floor of its parts' mean; entries without parts stay.

Active entries: a part's entry and exact distance are kept from round to round.
Where that entry stayed fixed in the last replacement, no other fixed entry can
have come nearer, so only the entries that moved are compared with the stored
distance; where it moved, the part is compared with all. Both ways give the
entry that a full comparison gives, ties included.

A vector is compared where it lies, in Arrow batches; nothing is shuffled but
one row of sums per task and entry. The driver sees the codebooks alone (PARTS
times ENTRIES rows). A round's state is a table in the shared folder, so lost
executors only repeat tasks, and the state before it is deleted.

Nulls, empties, ties: vectors that are null or hold null or non-finite
components take no part; vectors of another length than that of the smallest id,
and those too short to be cut, have no code either, as no entry has their length;
where PARTS doesn't divide the length, the first parts are shorter. Null ids come
last among the starting vectors and repeated rows are vectors of their own. Fewer
vectors than ENTRIES make a smaller codebook; an empty table gives no rows.
Components so large that distances could pass 2**62 raise an error. Other columns
may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceledger.session import discard, materialize

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows that are compared with the entries at a time.
SLICE_ROWS = 4096
STATE = "vec_id bigint, label int, q array<bigint>, code array<int>, dist array<bigint>"


@dataclass
class Codebook:
    """Entries of one part position, and which of them moved when they were last replaced."""

    entries: np.ndarray
    moved: np.ndarray


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(fine(x.cast("double")), F.lit(False)))


def cuts(dim: int) -> list[tuple[int, int]]:
    return [(dim * p // PARTS, dim * (p + 1) // PARTS) for p in range(PARTS)]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, (rows, entries): in floating point where every sum is below 2**53, else in integers."""
    top = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    bound = 4 * top * top * max(1, x.shape[1])
    if bound >= 1 << 62:
        raise OverflowError("vector components are too large for exact distances")
    if bound < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T)) + (entries * entries).sum(axis=1)[None, :]


def nearest(x: np.ndarray, book: Codebook, code: np.ndarray | None, dist: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of each part, by the active entries where a part's former entry stayed."""
    if code is None:
        d = distances(x, book.entries)
        best = d.argmin(axis=1)
        return best, d[np.arange(len(x)), best]
    code, dist = code.copy(), dist.copy()
    lost = book.moved[code]
    if lost.any():
        d = distances(x[lost], book.entries)
        best = d.argmin(axis=1)
        code[lost], dist[lost] = best, d[np.arange(len(best)), best]
    active = np.flatnonzero(book.moved)
    stay = np.flatnonzero(~lost)
    if len(active) and len(stay):
        d = distances(x[stay], book.entries[active])
        best = d.argmin(axis=1)
        near, entry = d[np.arange(len(best)), best], active[best]
        better = (near < dist[stay]) | ((near == dist[stay]) & (entry < code[stay]))
        code[stay[better]], dist[stay[better]] = entry[better], near[better]
    return code, dist


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(len(column), width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1), kind), rows.shape[1]).cast(pa.list_(kind))


def assign(state: DataFrame, books: list[Codebook]) -> DataFrame:
    """``state`` with code and dist by ``books``; those of the round before, where there are any, are built on."""
    dim = sum(b.entries.shape[1] for b in books)
    first = "code" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                q = _matrix(batch["q"], dim)
                code = dist = None
                if not first:
                    code, dist = _matrix(batch["code"], PARTS), _matrix(batch["dist"], PARTS)
                found = [nearest(q[:, a:b], books[p], None if first else code[:, p], None if first else dist[:, p]) for p, (a, b) in enumerate(cuts(dim))]
                new_code, new_dist = (np.stack(x, axis=1) for x in zip(*found, strict=True))
                columns = [batch["vec_id"], batch["label"], batch["q"], _lists(new_code, pa.int32()), _lists(new_dist, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "q", "code", "dist"])

    return state.mapInArrow(run, STATE)


def totals(state: DataFrame, dim: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): sums of the parts of each entry; a task sends a row per entry at most."""
    width = max(b - a for a, b in cuts(dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((PARTS, ENTRIES), dtype=np.int64)
        sums = np.zeros((PARTS, ENTRIES, width), dtype=np.int64)
        for batch in batches:
            q, code = _matrix(batch["q"], dim), _matrix(batch["code"], PARTS)
            for p, (a, b) in enumerate(cuts(dim)):
                n[p] += np.bincount(code[:, p], minlength=ENTRIES)
                np.add.at(sums[p, :, : b - a], code[:, p], q[:, a:b])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), _lists(sums[part, entry], pa.int64())], ["part", "entry", "n", "sums"])

    partial = state.select("q", "code").mapInArrow(run, "part bigint, entry bigint, n bigint, sums array<bigint>")
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])


def replaced(books: list[Codebook], sums: DataFrame) -> list[Codebook]:
    """The codebooks after each entry with parts has become the floor of their mean; PARTS * ENTRIES rows come to the driver at most."""
    new = [Codebook(b.entries.copy(), np.zeros(len(b.entries), dtype=bool)) for b in books]
    for row in sums.collect():
        book = new[row["part"]]
        mean = np.array([row[f"s{i}"] // row["n"] for i in range(book.entries.shape[1])], dtype=np.int64)
        book.moved[row["entry"]] = bool((mean != book.entries[row["entry"]]).any())
        book.entries[row["entry"]] = mean
    return new


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, q) of the usable vectors, with integer components."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    return vectors.where(usable(F.col(vector))).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("int").alias("label"), whole.alias("q"))


def compress(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[Codebook]]:
    """((vec_id, label, code, dist) of every vector with a code, codebooks): entry and squared distance of each part."""
    base = materialize(integers(vectors, vec_id, vector, label), "vectors")
    start = base.where(F.size("q") >= PARTS).orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()
    dim = len(start[0]["q"]) if start else 0
    same = [r["q"] for r in start if len(r["q"]) == dim]
    rows = np.array(same, dtype=np.int64).reshape(len(same), dim)
    books = [Codebook(rows[:, a:b].copy(), np.ones(len(rows), dtype=bool)) for a, b in cuts(dim)]
    if not start:
        return base.sparkSession.createDataFrame([], STATE).drop("q"), books
    state, old = base.where(F.size("q") == dim), base
    for _ in range(rounds):
        state = materialize(assign(state, books), "codes")
        discard(old)
        old = state
        books = replaced(books, totals(state, dim))
    final = materialize(assign(state, books).drop("q"), "codes")
    discard(old)
    return final, books


def decoded(codes: DataFrame, books: list[Codebook]) -> DataFrame:
    """``codes`` with ``vector``, the components that the codebooks give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _matrix(batch["code"], PARTS)
            q = np.concatenate([b.entries[code[:, p]] for p, b in enumerate(books)], axis=1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["code"], _lists(q / SCALE, pa.float64())], ["vec_id", "label", "code", "vector"])

    return codes.select("vec_id", "label", "code").mapInArrow(run, "vec_id bigint, label int, code array<int>, vector array<double>")


def digest(books: list[Codebook]) -> str:
    """Hash of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.entries.reshape(-1)).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    error = F.aggregate("dist", F.lit(0).cast("bigint"), lambda a, d: a + d)
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    rows = codes.select("vec_id", "label", hexed.alias("code"), error.alias("error"))
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    rows = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out: parts and entries as rows of components, distances by a join on position, ties by entry."""
    steps = [f"""
v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0 AND len(embedding) >= {PARTS}),
x AS MATERIALIZED (SELECT r, i * {PARTS} // len(e) AS p, i, CAST(floor({SCALE} * CAST(e[i + 1] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, e, unnest(range(len(e))) AS i FROM v) AS q),
c0 AS MATERIALIZED (SELECT p, k - 1 AS c, i, x FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, r) AS k FROM v) AS o USING (r) WHERE k <= {ENTRIES})"""]  # fmt: skip
    for n in range(ROUNDS + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT r, p, c, d FROM (
  SELECT r, p, c, d, row_number() OVER (PARTITION BY r, p ORDER BY d, c) AS k FROM (
    SELECT r, x.p, c, CAST(sum((x.x - b.x) * (x.x - b.x)) AS BIGINT) AS d FROM x JOIN c{n} AS b USING (i) GROUP BY r, x.p, c) AS q) AS q WHERE k = 1)""")
        if n < ROUNDS:
            steps.append(f"""
m{n} AS (SELECT x.p, c, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM x JOIN a{n} USING (r, p) GROUP BY x.p, c, i),
c{n + 1} AS MATERIALIZED (SELECT b.p, b.c, b.i, coalesce(m.x, b.x) AS x FROM c{n} AS b LEFT JOIN m{n} AS m ON b.p = m.p AND b.c = m.c AND b.i = m.i)""")
    return f"""
WITH {",".join(steps)},
s AS (SELECT r, string_agg(lower(lpad(hex(c), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, c, i)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN s USING (r) CROSS JOIN h"""


OP12_SQL = _sql()
