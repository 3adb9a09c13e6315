"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source gets a target number of words: the total shared by weight, no
   source above ``MAX_REPEATS`` times its own size, the excess shared again.
2. A source's documents fall into blocks of about ``shard_words`` / BLOCKS_A_SHARD
   words by a keyed hash, so blocks are small beside the shards whatever the
   corpus is. A source's exact quota is whole passes over all blocks and then
   blocks in permuted order as long as they fit, ROUNDS times among those that may
   still fit. Blocks of more than 1 / GIANT of what is to be taken, as very long
   documents are, go first with the chance of any other block and else last. What then lacks to the target is filled with single documents, the
   largest first, and a last one that goes beyond if that is nearer: documents are taken whole or not at all, and the words taken
   come as near as the documents allow.
3. The quotas of all sources are split recursively between halves of the output
   shards: at each node of the tree the left half draws its blocks from the
   node's quotas by a multivariate hypergeometric draw, which leaves every shard
   with exact quotas and the mix of the whole in expectation. The tree is as deep
   as shards of about ``shard_words`` words ask for.
4. Each source's draws, permuted again, go to the shards in disjoint runs of
   those lengths; inside a shard rows are ordered by a keyed hash.

Running sums over a source's blocks and the places of its draws are made by
range: rows are dealt by (source, hash), summed inside each range, and one row
per range and source carries the sums before it, so a source of any size is
spread over all tasks. Only sources (a row each) and, of the documents that may
fill a source's last gap, FILL_A_CLASS per power of two of size meet in a group.
Documents find their block's draws by a join and are never gathered. All draws
are seeded, so reruns agree.

Nulls, empties, ties: null text has size 0 and takes 0; the null source sorts
last; empty tables give no rows; repeated rows are documents of their own, drawn
together; a very long document is a block of its own or fills nothing it doesn't
fit; other columns may have any name, but ``_shard`` and ``_order`` are the
result's.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceledger.session import discard, materialize

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SHARD_WORDS = 1 << 20
BLOCKS_A_SHARD = 64
#: Times that a source's further blocks are tried for what the blocks before have left of its target.
ROUNDS = 4
GIANT = 8
#: Documents of each power of two of size that may fill what a source's blocks leave of its target.
FILL_A_CLASS = 8
#: Levels of the tree that one task splits at a time.
LEVELS = 6
#: The largest population of one hypergeometric draw of numpy's.
MOST_DRAWN = 900_000_000
#: Tables of blocks and sources of at most so many rows are broadcast.
BROADCAST_ROWS = 100_000
SEED = 20240611


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, block_words: int) -> DataFrame:
    """(source, source_size, target, n_blocks) from rows (source, size).

    The windows below run over one row per source, not over documents.
    Sources are capped in order of (cap / weight); source number p is capped
    if the level that the p - 1 before it leave would lift it above its cap.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int")))
    sources = sources.withColumn("cap", F.col("source_size") * float(MAX_REPEATS)).withColumn("at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    zero = F.lit(0.0)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero))
    sources = sources.withColumn("capped", level > F.col("at"))
    free = lambda c: F.sum(F.when(F.col("capped"), zero).otherwise(F.col(c))).over(every)
    rest = F.sum("source_size").over(every) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(zero)).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(rest * F.col("weight") / free("weight"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("bigint")
    return sources.select("source", "source_size", F.least(target, F.col("cap")).alias("target"), n_blocks.alias("n_blocks"))


def left_half(quota: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw of half of the blocks; above what numpy draws at once, in equal parts of every source."""
    parts = 1 + int(quota.sum()) // MOST_DRAWN
    left, seen = np.zeros_like(quota), 0
    for k in range(parts):
        part = quota * (k + 1) // parts - quota * k // parts
        seen += int(part.sum())
        left += rng.multivariate_hypergeometric(part, seen // 2 - int(left.sum()), method="marginals")
    return left


def halves(quota: np.ndarray, node: int, levels: int, seed: int) -> list[tuple[int, np.ndarray]]:
    """(node, quotas) of the nodes ``levels`` below ``node``; node n has the children 2n and 2n + 1."""
    if not levels:
        return [(node, quota)]
    left = left_half(quota, np.random.default_rng([seed, node]))
    return halves(left, 2 * node, levels - 1, seed) + halves(quota - left, 2 * node + 1, levels - 1, seed)


def split(nodes: DataFrame, levels: int, seed: int) -> DataFrame:
    """(node, source, quota) ``levels`` further down the tree; a node's sources meet in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last")
        found = halves(pdf["quota"].to_numpy(dtype=np.int64), int(pdf["node"].iloc[0]), levels, seed)
        return pd.concat([pdf.assign(node=n, quota=q)[q > 0] for n, q in found])[["node", "source", "quota"]]

    return nodes.groupBy("node").applyInPandas(run, "node bigint, source string, quota bigint")


def leaves(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(shard, source, quota) of the 2**depth shards, from (source, quota)."""
    nodes = quotas.where("quota > 0").select(F.lit(1).cast("bigint").alias("node"), "source", "quota")
    for level in range(0, depth, LEVELS):
        nodes = split(nodes, min(LEVELS, depth - level), seed)
    return nodes.select((F.col("node") - 2**depth).cast("int").alias("shard"), "source", "quota")


def depth_for(goal: DataFrame, shard_words: int = SHARD_WORDS) -> int:
    """Levels of the tree for shards of about ``shard_words`` words, from (target)."""
    words = goal.agg(F.sum("target")).first()[0] or 0
    return max(1, math.ceil(math.log2(max(1.0, words / shard_words))))


def running(rows: DataFrame, value: Column, *order: str) -> DataFrame:
    """``rows`` (source, ...) with ``place``, their number in their source by ``order``, and ``upto``, the sum of ``value`` as far as there."""
    placed = rows.withColumn("_value", value).repartitionByRange(F.col("source").asc_nulls_last(), *order).withColumn("_part", F.spark_partition_id())
    placed = materialize(placed, "ranges")
    inside = Window.partitionBy("_part", "source").orderBy(*order)
    local = placed.withColumns({"_place": F.row_number().over(inside), "_upto": F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part", "source").agg(F.count("*").alias("_n"), F.sum("_value").alias("_words"))
    sums = sums.select(F.col("_part").alias("_p"), F.col("source").alias("_s"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_words")])
    out = local.join(sums, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    out = materialize(out.select(*rows.columns, (F.col("_place") + F.col("_n")).alias("place"), (F.col("_upto") + F.col("_words")).alias("upto")), "running")
    discard(placed)
    return out


def with_block(rows: DataFrame, goal: DataFrame) -> DataFrame:
    goal = small(goal.withColumnRenamed("source", "_source"))
    return rows.join(goal, rows["source"].eqNullSafe(goal["_source"])).drop("_source").withColumn("block", F.pmod("key", "n_blocks"))


def small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def fill(sized: DataFrame, rest: DataFrame) -> DataFrame:
    """(source, key): of documents (source, key, size) those that fill ``rest`` (source, lack) best: the largest first that fits, and at last the least that doesn't if it comes nearer."""
    rest = small(rest.withColumnRenamed("source", "_source"))
    fits = sized.where("size > 0").join(rest, sized["source"].eqNullSafe(rest["_source"])).where("size < 2 * lack")
    # rows of one key are drawn together
    fits = fits.groupBy("source", "key", "lack").agg(F.sum("size").alias("words")).where("words < 2 * lack")
    of_class = Window.partitionBy("source", F.floor(F.log2("words"))).orderBy(F.xxhash64(F.lit("fill"), "key"), "key")
    few = fits.withColumn("_n", F.row_number().over(of_class)).where(F.col("_n") <= FILL_A_CLASS)
    every = few.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("words", "key")), asc=False).alias("docs"), F.max("lack").alias("lack"))
    none = F.struct(F.col("lack").cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("keys"))
    take = lambda a, d: F.when(d["words"] <= a["left"], F.struct((a["left"] - d["words"]).alias("left"), F.concat(a["keys"], F.array(d["key"])).alias("keys"))).otherwise(a)
    every = every.withColumn("got", F.aggregate("docs", none, take))
    over = F.array_min(F.filter("docs", lambda d: (d["words"] > F.col("got.left")) & ~F.array_contains("got.keys", d["key"])))
    last = F.when(over["words"] - F.col("got.left") < F.col("got.left"), F.array(over["key"])).otherwise(F.array().cast("array<bigint>"))
    return every.select("source", F.explode(F.concat("got.keys", last)).alias("key"))


def chosen(blocks: DataFrame) -> DataFrame:
    """(source, block, words) of the blocks (source, block, words, lack, _band, _order) that fit into ``lack`` in permuted order."""
    took, left, old = blocks.select("source", "block", "words").limit(0), blocks, []
    for _ in range(ROUNDS):
        fits = left.where("words > 0 AND words <= lack")
        if not fits.take(1):
            break
        ranked = running(fits, F.col("words"), "_band", "_order", "block")
        old.append(ranked)
        took = took.unionByName(ranked.where("upto <= lack").select("source", "block", "words"))
        rest = ranked.groupBy(F.col("source").alias("_s")).agg((F.max("lack") - F.coalesce(F.max(F.when(F.col("upto") <= F.col("lack"), F.col("upto"))), F.lit(0))).alias("_rest"))
        left = ranked.where("upto > lack").join(rest, F.col("source").eqNullSafe(F.col("_s"))).select("source", "block", "words", F.col("_rest").alias("lack"), "_band", "_order")
    out = materialize(took, "chosen")
    discard(*old)
    return out


def plan(sized: DataFrame, seed: int = SEED, depth: int | None = None, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(goal, blocks, singles): targets by source; the draws of each block and of each single document (key), arrays of (copy, shard).

    ``sized`` has source, size and key, a document hash.
    """
    goal = materialize(targets(sized, max(1, shard_words // BLOCKS_A_SHARD)), "targets")
    depth = depth_for(goal, shard_words) if depth is None else depth
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    goal = goal.withColumn("passes", passes).withColumn("lack", F.round("target").cast("bigint") - F.col("passes") * F.col("source_size"))
    placed = with_block(sized.select("source", "size", "key"), goal)
    blocks = placed.groupBy("source", "block", "passes", "lack", "source_size").agg(F.sum("size").alias("words"))
    drawn_first = F.pmod(F.xxhash64(F.lit(seed), F.lit("giant"), "source", "block"), F.lit(1 << 20)) * F.col("source_size") < F.col("lack") * (1 << 20)
    band = F.when(F.col("words") * GIANT <= F.col("lack"), 1).when(drawn_first, 0).otherwise(2)
    order = F.xxhash64(F.lit(seed), F.lit("order"), "source", "block")
    blocks = materialize(blocks.withColumns({"_band": band, "_order": order}).drop("source_size"), "blocks")
    last = chosen(blocks.drop("passes"))
    taken = last.groupBy(F.col("source").alias("_s")).agg(F.sum("words").alias("_words"))
    lacks = goal.join(taken, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", (F.col("lack") - F.coalesce("_words", F.lit(0))).alias("lack")).where("lack > 0")
    shut = last.select(F.col("source").alias("_s"), F.col("block").alias("_b"))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))
    single = fill(placed.join(shut, same, "left_anti").select("source", "key", "size"), lacks)
    single = single.join(small(goal.select(F.col("source").alias("_s"), "passes")), F.col("source").eqNullSafe(F.col("_s")))
    times = (F.col("passes") + F.when(F.col("_b").isNotNull(), 1).otherwise(0)).cast("int")
    copies = F.explode(F.when((F.col("words") > 0) & (times > 0), F.transform(F.sequence(F.lit(1), times), lambda i: (i - 1).cast("bigint"))))
    draws = blocks.join(shut, same, "left").select("source", "block", F.lit(None).cast("bigint").alias("key"), copies.alias("copy"))
    draws = draws.unionByName(single.select("source", F.lit(None).cast("bigint").alias("block"), "key", F.col("passes").alias("copy")))
    draws = running(draws.withColumn("_order", F.xxhash64(F.lit(seed), F.lit("draw"), "block", "key", "copy")), F.lit(1), "_order", "block", "key", "copy")
    places = leaves(draws.groupBy("source").agg(F.count("*").alias("quota")), depth, seed)
    upto = F.sum("quota").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    places = places.withColumn("_upto", upto).select(F.col("source").alias("_s"), "shard", F.explode(F.sequence(F.col("_upto") - F.col("quota") + 1, F.col("_upto"))).alias("_k"))
    dealt = materialize(draws.join(places, F.col("source").eqNullSafe(F.col("_s")) & (F.col("place") == F.col("_k"))).select("source", "block", "key", "copy", "shard"), "dealt")
    drawn = F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("draws")
    out = goal, dealt.where("block IS NOT NULL").groupBy("source", "block").agg(drawn), dealt.where("block IS NULL").groupBy("source", "key").agg(drawn)
    discard(blocks, last, draws)
    return out


def placed_rows(rows: DataFrame, goal: DataFrame, blocks: DataFrame, singles: DataFrame) -> DataFrame:
    """``rows`` (source, key, ...) with source_size, target and draws, an array of (copy, shard) of all draws that take the row."""
    rows = with_block(rows, goal.select("source", "n_blocks", "source_size", "target")).drop("n_blocks")
    blocks = small(blocks.select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("draws").alias("_whole")))
    singles = small(singles.select(F.col("source").alias("_s2"), F.col("key").alias("_k2"), F.col("draws").alias("_single")))
    out = rows.join(blocks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
    out = out.join(singles, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("key") == F.col("_k2")), "left")
    none = F.array().cast("array<struct<copy:bigint,shard:int>>")
    return out.withColumn("draws", F.concat(F.coalesce("_whole", none), F.coalesce("_single", none))).drop("block", "_s", "_b", "_whole", "_s2", "_k2", "_single")


def takes(sized: DataFrame, seed: int = SEED, depth: int | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``sized`` with source_size, target and draws, an array of (copy, shard); documents without words have none."""
    docs = placed_rows(sized, *plan(sized, seed, depth, shard_words))
    return docs.withColumn("draws", F.when(F.col("size") > 0, F.col("draws")).otherwise(F.array().cast("array<struct<copy:bigint,shard:int>>")))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = SEED, depth: int | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mixed rows: ``docs`` repeated as drawn, unchanged; adds _shard and _order (a keyed shuffle inside the shard)."""
    key = F.xxhash64(F.col(doc_id), F.col(text))
    sized = materialize(docs.select(F.col(source).alias("source"), size_of(F.col(text)).alias("size"), key.alias("key")), "sizes")
    work = docs.select(F.struct("*").alias("_row"), F.col(source).alias("source"), key.alias("key"))
    rows = placed_rows(work, *plan(sized, seed, depth, shard_words)).where(F.col(f"_row.{text}").rlike(WORD))
    discard(sized)
    out = rows.select("_row", "key", F.explode("draws").alias("d"))
    order = F.xxhash64(F.lit(seed), F.col("d.copy"), F.col("key"))
    names = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("_shard", "_order")]
    return out.select(*names, F.col("d.shard").alias("_shard"), order.alias("_order"))


def sharded(mixed: DataFrame) -> DataFrame:
    """Mixed rows dealt by shard and shuffled inside it: rows of a shard are neighbours, in the order of _order."""
    return mixed.repartition("_shard").sortWithinPartitions("_shard", "_order")


#: The query's shards are small, so that its tree has levels on small tables too.
QUERY_SHARD_WORDS = 1 << 15


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("doc_id").alias("key"))
    sized = materialize(sized, "sizes")
    taken = F.size("draws").cast("bigint") * F.col("size")
    shards = F.transform(F.array_sort("draws"), lambda d: d["shard"])
    return takes(sized, shard_words=QUERY_SHARD_WORDS).select("doc_id", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))
