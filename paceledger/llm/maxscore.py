"""Exact top-k search by MaxScore over sharded postings.

A vector's components are a document's terms with integer impacts. Rows are
dealt into shards of about SHARD_ROWS, one partition each; a shard's partition
gets its rows first and every query after them, as plain rows, so nothing is
broadcast or packed and a task holds one shard and one block of queries. Blocks
of up to BLOCK_QUERIES queries run MaxScore together, over the shard's rows in
steps by ascending id:

* a term's bound is the highest contribution that any row of the shard can get
  from it (contributions below zero bound to zero);
* a query's floor is the k-th score it has found in the steps so far; a later
  row must be above it, as at equal scores the smaller id is first;
* terms with small bounds, together not above the floor of any query of the
  block, are non-essential: rows that get nothing from the essential terms can't
  pass the floor;
* all rows of a step get their essential terms' sums; while many of them are
  still competitive (sum and bounds left above the floor) the strongest terms
  left are added for all, then the rest is probed for the competitive ones only.

Shards return their k best, ties to smaller ids, and the shards' results are
merged. Nothing is approximate: impacts and scores are whole numbers that
floating point holds (single where the sums stay below 2^23, else double), a
query whose sums may reach 2^52 is scored in 64-bit integers against all rows of
the shard, and sums that may leave 64 bits, or components of 2^53 and more,
raise an error.

Nulls, empties, ties: vectors that are null or empty or hold null or non-finite
values, and rows with null id, take no part; a query meets vectors of its own
length only and no row with its own id; of repeated ids each row is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceledger.session import materialize

SHARD_ROWS = 8192
BLOCK_QUERIES = 512
#: Rows of a block's first step, which finds the first floors, and of the later ones.
FIRST_ROWS = 256
STEP_ROWS = 2048
PROBE = 8
#: With fewer competitive rows than this share the rest is probed row by row.
FEW = 1 / 64
#: With more than this share, as in the first step, each query's k best of the step are picked before hits are merged.
MANY = 1 / 8

Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


class Shard:
    """Rows of one shard by ascending id, and their terms' highest and lowest impacts."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], values[order]
        self.high, self.low = self.rows.max(axis=0), self.rows.min(axis=0)
        self.terms: dict[type, np.ndarray] = {}

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Hits:
        """(position of the query, id, score) of each query's k best rows."""
        largest = np.abs(queries) @ np.maximum(np.abs(self.high), np.abs(self.low))
        fits = largest < 2**52
        found = [self.exact(i, queries[i], int(own[i]), k, float(largest[i])) for i in np.flatnonzero(~fits)]
        if fits.any():
            at, ids, scores = self.scan(queries[fits], own[fits], k, np.float32 if largest[fits].max() < 2**23 else np.float64)
            found.append((np.flatnonzero(fits)[at], ids, scores))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def scan(self, queries: np.ndarray, own: np.ndarray, k: int, kind: type) -> Hits:
        """MaxScore for a block of queries, with impacts as ``kind``."""
        if kind not in self.terms:
            self.terms[kind] = np.ascontiguousarray(self.rows.T, dtype=kind)
        dim, n = queries.shape[1], len(self.ids)
        bound = np.maximum(0.0, np.maximum(queries * self.high, queries * self.low))
        order = np.argsort(-bound.sum(axis=0), kind="stable")
        left = np.zeros((len(queries), dim + 1))  # the bounds of the terms from each place on
        left[:, :dim] = np.cumsum(bound[:, order[::-1]], axis=1)[:, ::-1]
        impacts = queries[:, order].astype(kind)
        floor = np.full(len(queries), -np.inf)
        best: Hits = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        begin, end = 0, min(n, max(FIRST_ROWS, 2 * k))
        while begin < end:
            below = (left <= floor[:, None]).all(axis=0)
            used = int(below.argmax()) if below.any() else dim
            partial = impacts[:, :used] @ self.terms[kind][order[:used], begin:end]
            first, last = (np.searchsorted(self.ids[begin:end], own, side=x) for x in ("left", "right"))
            for i in np.flatnonzero(first < last):
                partial[i, first[i] : last[i]] = -np.inf
            stay = partial > (floor - left[:, used])[:, None].astype(kind)
            while used < dim and np.count_nonzero(stay) > FEW * stay.size:
                more = slice(used, used + PROBE)
                partial += impacts[:, more] @ self.terms[kind][order[more], begin:end]
                used = min(dim, used + PROBE)
                stay = partial > (floor - left[:, used])[:, None].astype(kind)
            if used == dim and np.count_nonzero(stay) > MANY * stay.size:
                top = np.zeros_like(stay)
                np.put_along_axis(top, np.argsort(-partial, axis=1, kind="stable")[:, :k], True, axis=1)
                stay &= top
            at, row = np.divmod(np.flatnonzero(stay), end - begin)
            scores = partial[at, row].astype(np.float64)
            rest = order[used:]
            if len(rest):
                scores += np.einsum("ij,ij->i", queries[at[:, None], rest], self.rows[begin + row[:, None], rest])
            above = scores > floor[at]
            at, ids, scores = (np.concatenate(x) for x in zip(best, (at[above], self.ids[begin + row[above]], scores[above]), strict=True))
            by = np.lexsort((ids, -scores, at))
            place = np.arange(len(by)) - np.searchsorted(at[by], at[by], side="left")
            by, place = by[place < k], place[place < k]
            best = at[by], ids[by], scores[by]
            floor[best[0][place == k - 1]] = best[2][place == k - 1]
            begin, end = end, min(n, end + STEP_ROWS)
        return best[0], best[1], best[2].astype(np.int64)

    def exact(self, at: int, query: np.ndarray, own: int, k: int, largest: float) -> Hits:
        """One query, with all rows' scores in 64-bit whole numbers."""
        if largest >= 2**62:
            raise OverflowError(f"a score of query {own} may not fit into 64 bits")
        rows = np.flatnonzero(self.ids != own)
        scores = self.rows[rows].astype(np.int64) @ query.astype(np.int64)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return np.full(len(best), at), self.ids[rows[best]], scores[best]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) from (id bigint, v array<double> of whole numbers)."""
    rows = materialize(vectors.withColumn("q", is_query).withColumn("dim", F.size("v")), "vectors").where("dim > 0 AND id IS NOT NULL")
    n_shards = max(1, -(-rows.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("id", "v"), F.lit(n_shards)).cast("int").alias("shard")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard")
    dealt = rows.select(shard, F.lit(False).alias("asks"), "dim", "id", "v").union(rows.where("q").select(every, F.lit(True), "dim", "id", "v"))
    met = dealt.repartitionById(n_shards, "shard").sortWithinPartitions("dim", "asks").select("asks", "dim", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for batch in batches:
            asks, dims = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((asks[1:] != asks[:-1]) | (dims[1:] != dims[:-1])) + 1), len(dims)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                dim = int(dims[begin])
                ids = batch.column(2)[begin:end].to_numpy()
                values = batch.column(3)[begin:end].flatten().to_numpy().reshape(-1, dim)
                if not asks[begin]:
                    at, held, shard = dim, [*(held if at == dim else []), (ids, values)], None
                elif at == dim:
                    shard = shard or Shard(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                    for i in range(0, len(ids), BLOCK_QUERIES):
                        own = ids[i : i + BLOCK_QUERIES]
                        asked, found, scores = shard.search(values[i : i + BLOCK_QUERIES], own, k)
                        yield pa.RecordBatch.from_arrays([pa.array(own[asked]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    hits = met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    merged = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(merged).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """(id, v): floor(256 * x) of each component x as double; unfit vectors and null ids go; components too large for whole doubles raise an error."""
    x = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("e")).where("id IS NOT NULL AND e IS NOT NULL")
    whole = lambda c: F.when(F.abs(c) * 256 < 2.0**53, F.floor(c * 256).cast("double")).otherwise(F.raise_error(F.lit("a vector's component is 2^45 or more")).cast("double"))
    fit = x.where(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))))
    return fit.select("id", F.transform("e", whole).alias("v"))


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(whole_numbers(embeddings), F.col("id") % 50 == 0)


OP9_SQL = """
WITH ok AS (
  SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), u AS (
  SELECT vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM ok
), bad AS (
  SELECT DISTINCT vec_id FROM u WHERE x IS NULL OR isnan(x) OR isinf(x)
), v AS (
  SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u WHERE vec_id NOT IN (SELECT vec_id FROM bad)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id
), r AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
