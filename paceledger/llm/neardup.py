"""Near-duplicate detection by bottom-k sketches of one hash function.

1. Every document's set of word shingles is hashed once; the K lowest values
   are its sketch. Documents with equal sets (size and a 128-bit sum) form a
   class and go on as their smallest document.
2. The retained values go to inverted lists. Values that only one document
   retains are void; of the others a document enters the lists of its rarest
   ones only, as many as two sketches that share LEAST_SHARED values cannot
   both miss (prefix filtering, rarest first). Values that very many documents
   retain are thus hardly ever used. Two sets with similarity 0.8 share fewer
   than LEAST_SHARED of 64 values with probability below 1e-11.
3. Of the documents in any list, the shingles that no other of them has are
   counted. A pair with similarity 0.8 can't have more than a ninth of both
   sizes of them together, so documents made of their own shingles go.
4. Each list has a pivot, the document whose retained values most others
   retain, and all documents of the list are compared with it. The confirmed
   links are contracted to components, so a large family of copies is not
   expanded into pairs.
5. Documents of a list that are then in different components are described by
   their edits: the shingles they have and the pivot hasn't, or the reverse.
   Two sets differ exactly where their edits differ, and sets that differ from
   the pivot by more than the threshold are only similar to others if both
   share about half of their edits. The edits are inverted lists in turn, rarest
   first: a pair is formed only at an edit after which both still have enough
   edits left to share. This loses no link, as the first edit that a similar
   pair shares always passes, and edits of few documents alone form no pair.
   Each of these lists is compared with a pivot first, too.
6. Compared pairs are filtered by the similarity that the bottom-k sketch of
   their union shows (cut at CUT, 7 standard deviations below 0.8), and
   confirmed on the full shingle sets.
7. Components of the confirmed links give the result.

Nulls, empties, ties: a null document id takes no part (its rows are returned
with null component, kept); null or blank text has no shingles and no links;
fewer words than a shingle has are one shingle; rows with one id are one node.
``dedup`` returns its input's columns, whatever their names, and of rows with
equal id and text one. A very long text's shingle set is held whole in its task,
at 8 bytes a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceledger.llm import words
from paceledger.llm.graph import components
from paceledger.session import discard, materialize

SHINGLE = 5
PERCENT = 80
K = 64
LEAST_SHARED = 26
CUT = 0.39


def shingle_sets(sl: words.Slice, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): each document's distinct shingle hashes, ascending, as non-negative 63-bit integers."""
    h = sl.hashes(0, lower=True)
    counts = sl.counts
    doc_of = np.repeat(np.arange(len(counts)), counts)
    ok = words.fits(counts, shingle)
    values, docs = words.windows(h, shingle)[ok], doc_of[: len(ok)][ok]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    starts = sl.word_offsets[:-1]
    for n in np.unique(counts[short]):
        at = starts[short[counts[short] == n]]
        values = np.concatenate([values, words.windows(h, int(n))[at]])
        docs = np.concatenate([docs, doc_of[at]])
    values = (values >> np.uint64(1)).astype(np.int64)
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    values, docs = values[first], docs[first]
    return values, np.searchsorted(docs, np.arange(len(counts) + 1))


def sketches(docs: DataFrame, shingle: int, k: int = K) -> DataFrame:
    """(doc_id, n, c1, c2, sketch) from (doc_id, text): set size, two sums over the set, its k lowest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sl in words.slices(batch.column(1)):
                values, offsets = shingle_sets(sl, shingle)
                n = np.diff(offsets)
                sums = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(values.astype(np.uint64) ^ np.uint64(salt)), dtype=np.uint64)])
                    sums.append((upto[offsets[1:]] - upto[offsets[:-1]]).view(np.int64))
                low = np.arange(len(values)) - np.repeat(offsets[:-1], n) < k
                ends = np.concatenate([[0], np.cumsum(np.minimum(n, k))]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(values[low]))
                ids = batch.column(0).slice(sl.first, len(n))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(sums[0]), pa.array(sums[1]), sketch], names=["doc_id", "n", "c1", "c2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, c1 bigint, c2 bigint, sketch array<bigint>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, members): the whole shingle set, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sl in words.slices(batch.column(1)):
                values, offsets = shingle_sets(sl, shingle)
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(sl.first, len(sets)), sets], names=["doc_id", "members"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, members array<bigint>")


def own_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, own): set size and how many of the shingles no other document of ``sets`` has; documents that can't link go."""
    single = sets.select("doc_id", F.explode("members").alias("v")).groupBy("v").agg(F.count("*").alias("times"), F.min("doc_id").alias("doc_id")).where("times = 1")
    own = single.groupBy("doc_id").agg(F.count("*").alias("own"))
    sized = sets.select("doc_id", F.size("members").cast("bigint").alias("n")).join(own, "doc_id", "left").select("doc_id", "n", F.coalesce("own", F.lit(0)).alias("own"))
    return sized.where(F.col("own") * percent <= F.col("n") * (100 - percent))


def sizes_fit(n1: Column, n2: Column, percent: int) -> Column:
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def lists(reps: DataFrame) -> DataFrame:
    """Inverted lists (v, doc_id, central) of the rarest retained values each document needs, from (doc_id, n, sketch).

    ``central`` tells how many documents retain a value of the document's, in thousandths on average.
    """
    listed = reps.select("doc_id", "n", F.explode("sketch").alias("v"))
    shared = materialize(listed.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "values")
    ranked = listed.join(shared, "v").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # sets whose partners fit into the lists whole must share 80 % of the set itself
    need = F.when(F.col("n") * 100 <= (K - 1) * PERCENT, F.ceil(F.col("n") * PERCENT / 100)).otherwise(LEAST_SHARED)
    enter = F.greatest(F.lit(0), F.size("vs") - F.greatest(F.lit(1), need) + 1).cast("int")
    central = F.aggregate("vs", F.lit(0).cast("bigint"), lambda a, e: a + e["df"]) * 1000 / F.least("n", F.lit(K))
    entered = ranked.where(enter > 0).select("doc_id", central.cast("bigint").alias("central"), F.explode(F.slice("vs", F.lit(1), enter)).alias("e"))
    out = materialize(entered.select(F.col("e.v").alias("v"), "doc_id", "central"), "lists")
    discard(shared)
    return out


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose union sketch shows a similarity of CUT at least."""
    side = lambda c, s: reps.select(F.col("doc_id").alias(c), F.col("sketch").alias(s))
    both = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b")
    lowest = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    both = both.withColumn("low", lowest)
    shared = F.size(F.array_intersect("low", F.array_intersect("sa", "sb")))
    return both.where(shared >= CUT * F.size("low")).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs with 100 * |A and B| >= percent * |A or B| on full sets."""
    side = lambda c, m: sets.select(F.col("doc_id").alias(c), F.col("members").alias(m))
    both = pairs.join(side("a", "ma"), "a").join(side("b", "mb"), "b")
    size = lambda c: F.size(c).cast("bigint")
    return both.where(size(F.array_intersect("ma", "mb")) * (100 + percent) >= (size("ma") + size("mb")) * percent).select("a", "b")


def edits(frames: DataFrame, sets: DataFrame) -> DataFrame:
    """``frames`` (p, doc_id, ...) with n, p_n and edits: shingles of the document that the pivot hasn't, and (as -v - 1) the reverse."""
    side = lambda c, m: sets.select(F.col("doc_id").alias(c), F.col("members").alias(m))
    both = frames.join(side("doc_id", "own"), "doc_id").join(side("p", "base"), "p")
    gone = F.transform(F.array_except("base", "own"), lambda v: -v - 1)
    return both.select(*frames.columns, F.size("own").cast("bigint").alias("n"), F.size("base").cast("bigint").alias("p_n"), F.concat(F.array_except("own", "base"), gone).alias("edits"))


def edit_lists(edited: DataFrame, percent: int) -> DataFrame:
    """Inverted lists (p, e, doc_id, c, n, m, left) of the edits that a link between components may need.

    m is the number of a document's edits, ``left`` how many of those that others
    have too remain from this one on, rarest first. With s = 100 + percent and
    t = 100 - percent, sets link if they differ in (n1 + n2) * t / s shingles at
    most, so they share half of m1 + m2 less that. A document that links with the
    pivot only needs partners that don't, and the reverse, which gives the bounds.
    """
    s, t = 100 + percent, 100 - percent
    rows = edited.withColumn("m", F.size("edits").cast("bigint"))
    listed = rows.select("p", "doc_id", F.explode("edits").alias("e"))
    shared = listed.groupBy("p", "e").agg(F.count("*").alias("df")).where("df > 1")
    ranked = listed.join(shared, ["p", "e"]).groupBy("p", "doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    ranked = rows.drop("edits").join(ranked, ["p", "doc_id"])
    placed = ranked.select("p", "doc_id", "c", "n", "p_n", "m", F.size("es").alias("k"), F.posexplode("es").alias("pos", "x"))
    placed = placed.select("p", F.col("x.e").alias("e"), "doc_id", "c", "n", "p_n", "m", (F.col("k") - F.col("pos")).cast("bigint").alias("left"))
    linked = F.col("m") * s <= (F.col("n") + F.col("p_n")) * t
    enough = F.when(linked, F.col("left") * 2 * s > F.col("m") * (s - t)).otherwise(F.col("left") * 2 * s >= F.col("m") * s - (F.col("n") + F.col("p_n")) * t + (s - t))
    return placed.where(enough).drop("p_n")


def share_enough(percent: int) -> Column:
    """Of two documents at an edit both have (n, m, left and b_n, b_m, b_left): their sizes fit, and enough edits are left for a link."""
    s, t = 100 + percent, 100 - percent
    n, m, left = (F.col(c) for c in ("n", "m", "left"))
    b_n, b_m, b_left = (F.col(f"b_{c}") for c in ("n", "m", "left"))
    return sizes_fit(n, b_n, percent) & (F.least(left, b_left) * 2 * s >= (m + b_m) * s - (n + b_n) * t)


def placed(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with c, each document's component under ``links``."""
    parts = components(links).withColumnsRenamed({"node": "_n", "component": "_c"})
    rows = rows.drop("c")
    return rows.join(parts, F.col("doc_id") == F.col("_n"), "left").select(*rows.columns, F.coalesce("_c", "doc_id").alias("c"))


def apart(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose group holds more than one component."""
    mixed = rows.groupBy(*keys).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select(*keys)
    return rows.join(mixed, list(keys), "left_semi")


def links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sketch table, class table (n, c1, c2, component): the smallest doc_id reachable from each class of equal sets)."""
    known = materialize(sketches(docs.where("doc_id IS NOT NULL"), shingle), "sketches")
    classes = materialize(known.where("n > 0").groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = classes.select(F.col("rep").alias("doc_id")).distinct()
    reps = materialize(known.where("n > 0").select("doc_id", "n", "sketch").join(firsts, "doc_id", "left_semi"), "reps")
    entries = lists(reps)
    involved = materialize(entries.select("doc_id").distinct(), "involved")
    sets = materialize(full_sets(docs.select("doc_id", "text").join(involved, "doc_id", "left_semi"), shingle), "sets")
    fit = materialize(own_shingles(sets, percent), "own-shingles")
    sketched = materialize(reps.join(fit, "doc_id", "left_semi"), "involved-sketches")
    discard(reps, involved)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def check(pairs: DataFrame) -> DataFrame:
        likely_pairs = materialize(likely(pairs, sketched), "likely")
        out = materialize(confirmed(likely_pairs, sets, percent), "confirmed")
        discard(likely_pairs)
        return out

    # each list's documents against its pivot
    fitting = entries.join(fit, "doc_id")
    pivots = fitting.groupBy("v").agg(F.max(F.struct("central", F.xxhash64("doc_id").alias("h"), "doc_id")).alias("p"), F.count("*").alias("k"))
    pivots = materialize(pivots.where("k > 1").select("v", F.col("p.doc_id").alias("p")), "pivots")
    frames = materialize(fitting.join(pivots, "v").where("doc_id <> p").select("p", "doc_id").distinct(), "frames")
    discard(entries, pivots)
    own = fit.select(F.col("doc_id").alias("p"), F.col("n").alias("p_n"), F.col("own").alias("p_own"))
    near = sizes_fit(F.col("n"), F.col("p_n"), percent) & ((F.col("own") + F.col("p_own")) * (100 + percent) <= (F.col("n") + F.col("p_n")) * (100 - percent))
    star = materialize(frames.join(fit, "doc_id").join(own, "p").where(near).select(*pair("doc_id", "p")).distinct(), "star")
    found = check(star)
    # then the documents of a list that are still apart, at the edits they share: first each edit's pivot, then the rest
    left = materialize(apart(placed(frames, found), "p"), "apart")
    edited = materialize(edits(left, sets), "edits")
    shared = materialize(apart(edit_lists(edited, percent), "p", "e"), "edit-lists")
    discard(frames, left, edited)
    side = ("doc_id", "c", "n", "m", "left")
    second = shared.groupBy("p", "e").agg(F.min(F.struct("m", F.xxhash64("doc_id").alias("h"), *[c for c in side if c != "m"])).alias("b"))
    second = second.select("p", "e", *[F.col(f"b.{c}").alias(f"b_{c}") for c in side])
    differ = F.col("c") != F.col("b_c")
    again = shared.join(second, ["p", "e"]).where(differ & share_enough(percent)).select(*pair("doc_id", "b_doc_id")).distinct()
    again = materialize(again.join(star, ["a", "b"], "left_anti"), "edit-star")
    more = check(again)
    rest = materialize(apart(placed(shared, found.union(more)), "p", "e"), "rest")
    other = rest.select("p", "e", *[F.col(c).alias(f"b_{c}") for c in side])
    pairs = rest.join(other, ["p", "e"]).where((F.col("doc_id") < F.col("b_doc_id")) & differ & share_enough(percent))
    pairs = pairs.select(*pair("doc_id", "b_doc_id")).distinct().join(star, ["a", "b"], "left_anti").join(again, ["a", "b"], "left_anti")
    last = check(pairs)
    # rows with one id are one document, whatever classes their texts are of
    often = known.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    same = in_class(known.join(often, "doc_id", "left_semi"), classes).where("rep IS NOT NULL").select(*pair("doc_id", "rep"))
    parts = components(found.union(more).union(last).union(same))
    out = classes.join(parts, F.col("rep") == F.col("node"), "left").select("n", "c1", "c2", F.coalesce("component", "rep").alias("component"))
    out = materialize(out, "class-components")
    discard(classes, sets, fit, sketched, star, found, shared, again, more, rest, last)
    return known, out


def in_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (n, c1, c2, ...) with the columns of their class."""
    keys = {c: f"_{c}" for c in ("n", "c1", "c2")}
    classes = classes.withColumnsRenamed(keys)
    return rows.join(classes, (F.col("n") == F.col("_n")) & (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2")), "left").drop(*keys.values())


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document row (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is it)."""
    known, classes = links(docs, shingle, percent)
    component = F.coalesce("component", "doc_id")
    out = in_class(known.select("doc_id", "n", "c1", "c2"), classes)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    void = sketches(docs.where("doc_id IS NULL"), shingle).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(void)


def dedup(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest doc_id, and once where rows repeat it."""
    drop = materialize(near_duplicates(docs.select("doc_id", "text"), shingle=shingle, percent=percent).where("NOT kept").select("doc_id").distinct(), "dropped")
    left = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    often = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated-ids")
    once = left.join(often, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(left.join(often, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=4)
