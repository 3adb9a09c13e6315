"""Substring dedup by level-wise doubling.

A window is a run of consecutive words of one document. Lengths go up level by
level, each about twice the one before, and only windows that repeat at one
length are extended to the next, until no candidate survives or the length
asked for is reached:

* Level one has about FIRST_WORDS words, a half of a half of the length asked
  for. Of its windows only the winnowed ones count, the lowest hash of each run,
  chosen so that every window of the length asked for holds at least one. That
  is one window in fourteen, and two equal long windows always hold equal ones.
* The next levels double that up to the length asked for: all windows around a
  repeated one of the level before.
* Further levels double the length asked for, if ``longest`` says so. They tell how long the
  repeats are, and can't change which words repeats of ``min_words`` cover.

To find repeats, windows meet by hash in one shuffle. Before it, each task
settles the windows that it meets twice itself: their places need no answer
any more, and a single row stands for all of them. So a window that a third of
all documents hold sends one row per block of text, not one per document.

Results are exact but for collisions of 64-bit window hashes.

Nulls, empties, ties: null text has no words; documents shorter than a window
keep all words; a repeat inside one document counts; equal rows are documents
of their own and repeat each other. Rows with null ids are treated alike. A very
long text is hashed as one slice in one task, about 100 bytes a word. Input
columns named n_words, n_removed or kept_sha256 are replaced; others are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceledger.llm import words
from paceledger.session import discard, materialize

MIN_WORDS = 35
#: Level one has at most so many words, unless half of the length asked for is less.
FIRST_WORDS = 9
#: Text that a task gathers before it settles its own repeats.
BLOCK_BYTES = 8 << 20


def _run(values: np.ndarray, size: int, pick: np.ufunc, ahead: bool) -> np.ndarray:
    """The pick (minimum or maximum) over each value and the size - 1 after it (or before it), by doubling."""
    have, out = 1, values
    while have < size:
        step = min(have, size - have)
        moved = out.copy()
        if step < len(out):
            if ahead:
                moved[:-step] = pick(out[:-step], out[step:])
            else:
                moved[step:] = pick(out[step:], out[:-step])
        out = moved
        have += step
    return out


def winnowed(sl: words.Slice, half: int, full: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the chosen windows of ``half`` words; every window of ``full`` words holds one."""
    h = words.windows(sl.hashes(0), half)
    fit = words.fits(sl.counts, full)
    if not fit.any():
        return np.zeros(0, np.int64), h[:0]
    span = full - half + 1
    lowest = np.zeros(len(h), dtype=np.uint64)
    lowest[: len(fit)] = np.where(fit, _run(h, span, np.minimum, True)[: len(fit)], 0)
    chosen = np.flatnonzero(_run(lowest, span, np.maximum, False) == h)
    # a place beyond the last full window of its document may equal a value of another's by chance only
    return chosen, h[chosen]


def candidates(sl: words.Slice, places: list, length: int, reach: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows of ``length`` words around the repeated places of each document.

    ``both``: the window's halves must both be repeated (places are all
    repeated windows of half the length); otherwise windows that hold a place.
    """
    total = int(sl.counts.sum())
    fit = words.fits(sl.counts, length)
    mark = np.zeros(total + 1, dtype=np.int64)
    offsets, counts = sl.word_offsets, sl.counts
    for i, ps in enumerate(places):
        if ps is not None and len(ps):
            at = ps[(ps >= 0) & (ps < counts[i])]
            if both:
                mark[at + offsets[i]] = 1
            else:
                np.add.at(mark, np.maximum(at - reach, 0) + offsets[i], 1)
                np.add.at(mark, at + 1 + offsets[i], -1)
    if both:
        half = length // 2
        hit = mark[:total].astype(bool)
        good = hit[: len(fit)] & hit[half : half + len(fit)] & fit
    else:
        good = (np.cumsum(mark)[: len(fit)] > 0) & fit
    at = np.flatnonzero(good)
    return at, words.windows(sl.hashes(0), length)[at]


def _settled(block: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (w, doc_id, k, pos, known) of a block's windows; windows found twice here are known, and one void row stands for them."""
    w, doc, k, pos = (np.concatenate([x[i] for x in block]) for i in range(4))
    values, inverse, times = np.unique(w, return_inverse=True, return_counts=True)
    known = times[inverse] > 1
    repeats = values[times > 1]
    void = np.zeros(len(repeats), dtype=bool)
    key = np.concatenate([np.where(known, words.mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64)), w), repeats]).view(np.int64)
    stands = np.concatenate([np.zeros(len(w), bool), np.ones(len(repeats), bool)])
    pad = lambda a, kind: pa.array(np.concatenate([a, np.zeros(len(repeats), a.dtype)]), kind, mask=stands)
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pad(doc, pa.int64()), pad(k, pa.int64()), pad(pos, pa.int32()), pa.array(np.concatenate([known, void]))], names=["w", "doc_id", "k", "pos", "known"]
    )


def repeated(docs: DataFrame, length: int, earlier: DataFrame | None, earlier_length: int, full: int) -> DataFrame:
    """(doc_id, k, places): where in each document a candidate window of ``length`` words is repeated anywhere.

    ``docs`` has (doc_id, k, text); ``earlier`` is the result for the length before, None at level one.
    """
    first = earlier is None
    rows = docs if first else docs.join(earlier, ["doc_id", "k"]).select("doc_id", "k", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for sl in words.slices(batch.column(2)):
                if first:
                    at, hashes = winnowed(sl, length, full)
                else:
                    places = [None if p is None else np.asarray(p) for p in batch.column(3).slice(sl.first, len(sl.counts)).to_numpy(zero_copy_only=False)]
                    at, hashes = candidates(sl, places, length, length - earlier_length, length > full)
                doc = np.searchsorted(sl.word_offsets, at, side="right") - 1
                block.append((hashes, ids[sl.first + doc], keys[sl.first + doc], (at - sl.word_offsets[doc]).astype(np.int32)))
                size += len(sl.data)
                if size >= BLOCK_BYTES:
                    yield _settled(block)
                    block, size = [], 0
        if block:
            yield _settled(block)

    found = rows.mapInArrow(run, "w bigint, doc_id bigint, k bigint, pos int, known boolean")
    times = F.count("*").over(Window.partitionBy("w"))
    found = found.withColumn("times", times).where("doc_id IS NOT NULL AND (known OR times > 1)")
    return found.groupBy("doc_id", "k").agg(F.collect_list("pos").alias("places"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, k, text) for the levels: k tells rows with one id apart, a null id becomes a number of its own."""
    return docs.select(row_id(F.col(doc_id)).alias("doc_id"), F.xxhash64(F.col(text)).alias("k"), F.col(text).alias("text"))


def row_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(-(2**63)))


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, longest: int | None = None) -> list[tuple[int, DataFrame]]:
    """[(length, (doc_id, k, places))]: the repeated windows of ``min_words`` words and of each doubled length up to ``longest`` (0: until none survive)."""
    keyed = _keyed(docs, doc_id, text)
    ladder = [(min_words + 1) // 2, min_words]
    while ladder[0] > FIRST_WORDS:
        ladder.insert(0, (ladder[0] + 1) // 2)
    found = materialize(repeated(keyed, ladder[0], None, 0, min_words), "level-one")
    for have, want in zip(ladder, ladder[1:], strict=False):
        before, found = found, materialize(repeated(keyed, want, found, have, min_words), "repeated")
        discard(before)
    out, length = [(min_words, found)], min_words
    while longest is not None and (longest == 0 or 2 * length <= longest) and found.take(1):
        found = materialize(repeated(keyed, 2 * length, found, length, min_words), "longer")
        length *= 2
        out.append((length, found))
    return out


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without each word that a repeated window of ``min_words`` words covers.

    ``text`` holds the kept words, one space between; n_words, n_removed and
    kept_sha256 (of that text) are added, in place of input columns so named.
    """
    found = repeats(docs, doc_id=doc_id, text=text, min_words=min_words)[0][1].withColumnsRenamed({"doc_id": "_repeats_id", "k": "_repeats_k", "places": "_repeats_places"})
    others = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "kept_sha256")]
    rows = docs.join(found, (row_id(F.col(doc_id)) == F.col("_repeats_id")) & (F.xxhash64(F.col(text)) == F.col("_repeats_k")), "left").select(*others, "_repeats_places", text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema] + [f"`{text}` string", "n_words bigint", "n_removed bigint", "kept_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sl in words.slices(batch.column(len(others) + 1)):
                n = len(sl.counts)
                kept, removed, digests = [], [], []
                offsets = sl.word_offsets
                places = batch.column(len(others)).slice(sl.first, n).to_numpy(zero_copy_only=False)
                for i in range(n):
                    a, b = offsets[i], offsets[i + 1]
                    stay = np.ones(b - a, dtype=bool)
                    if places[i] is not None:
                        cover = np.zeros(b - a + 1, dtype=np.int64)
                        at = np.unique(np.asarray(places[i]))
                        cover[at] += 1
                        cover[at + min_words] -= 1
                        stay = np.cumsum(cover)[:-1] == 0
                    body = _joined(sl, a, b, stay)
                    kept.append(body)
                    removed.append(int(b - a - stay.sum()))
                    digests.append(hashlib.sha256(body).hexdigest())
                rest = [batch.column(c).slice(sl.first, n) for c in range(len(others))]
                made = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sl.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=[*others, text, "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, schema)


def _joined(sl: words.Slice, a: int, b: int, stay: np.ndarray) -> bytes:
    """The kept ones of words a to b, one space between."""
    starts, ends = sl.starts[a:b][stay], sl.ends[a:b][stay]
    if not len(starts):
        return b""
    base = starts[0]
    size = ends[-1] - base
    mark = np.zeros(size + 2, dtype=np.int8)
    mark[starts - base] += 1
    mark[ends - base + 1] -= 1
    inside = np.cumsum(mark[: size + 1], dtype=np.int8) > 0
    inside[size] = False
    data = sl.data[base : base + size + 1]
    if len(data) < size + 1:
        inside = inside[: len(data)]
    out = data[inside]
    out = np.where(words._SPACE[out], np.uint8(0x20), out)
    return out.tobytes()


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
