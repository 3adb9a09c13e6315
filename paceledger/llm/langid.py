"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is then
parsed greedily against each automaton: every phrase is the longest match that
starts where the phrase before ended. Text in the automaton's language needs
few, long phrases; the language with the lowest phrases * log2(sample) / length
wins. The automata become dense transition tables, in which a failing step
ends the phrase and starts the next, and all texts of a slice are parsed side
by side, one vector operation a step.

The MAX_LETTERS most frequent letters of the samples are a symbol each; every
other letter of the samples is written as two symbols, the digits of its rank,
so the tables' width grows with the square root of the number of letters.

The sample is bounded: per language the SAMPLE_DOCS documents that come first
by a hash of their id, of 100 to SAMPLE_DOC_CHARS characters, up to SAMPLE_CHARS
characters together. A language that these leave short is filled up from the
beginnings of longer documents, then from shorter ones. Languages with less than
SAMPLE_MIN_CHARS characters of labelled text aren't learned. Prediction covers every whole text: texts are parsed in
segments of SEGMENT characters, a phrase ending at a segment's end at the latest.

Nulls, empties, ties: null text or text without a letter is ``und`` with score
0; of languages with equal entropy the first by code point wins; null labels
teach nothing; without any labelled text everything is ``und``; repeated rows
are predicted alike; columns besides doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceledger.llm import words

SAMPLE_DOCS = 64
SAMPLE_DOC_CHARS = 4000
SAMPLE_CHARS = 24_000
SAMPLE_MIN_CHARS = 100
SEGMENT = 1024
SLICE_BYTES = 4 << 20
MAX_LETTERS = 120


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> pd.DataFrame:
    """The bounded sample: (lang, n, text), at most 2 * SAMPLE_DOCS rows a language, in the order of the ids' hashes."""
    fit = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    usual = F.length("text").between(100, SAMPLE_DOC_CHARS)

    def first(rows: DataFrame, *order: str) -> pd.DataFrame:
        window = Window.partitionBy("lang").orderBy(*order, F.xxhash64("doc_id"), "doc_id", "text")
        return rows.withColumn("n", F.row_number().over(window)).where(F.col("n") <= SAMPLE_DOCS).select("lang", "n", "text").toPandas()

    rows = first(fit.where(usual))
    chars = rows["text"].str.len().groupby(rows["lang"]).sum()
    short = [r.lang for r in fit.select("lang").distinct().collect() if chars.get(r.lang, 0) < SAMPLE_CHARS]
    if short:
        others = fit.where(F.col("lang").isin(short) & ~usual).select("lang", "doc_id", (F.length("text") < 100).alias("_short"), F.substring("text", 1, SAMPLE_DOC_CHARS).alias("text"))
        more = first(others, "_short")
        rows = pd.concat([rows, more.assign(n=more["n"] + SAMPLE_DOCS)])
        chars = rows["text"].str.len().groupby(rows["lang"]).sum()
        rows = rows[rows["lang"].map(chars) >= SAMPLE_MIN_CHARS]
    return rows.sort_values(["lang", "n"])


def automaton(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix automaton of a symbol sequence as a table of next states, -1 where no match goes on."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    table = np.full((len(nexts), alphabet), -1, dtype=np.int64)
    for s, edges in enumerate(nexts):
        for c, t in edges.items():
            table[s, c] = t
    return table


def learn(docs: DataFrame) -> dict | None:
    """The model: symbols of code points, one flat table for all languages, each language's root and weight."""
    rows = sample(docs)
    if rows.empty:
        return None
    texts = {}
    for lang, own in rows.groupby("lang"):
        upto = own["text"].str.len().cumsum()
        texts[lang] = " ".join(own["text"][(upto <= SAMPLE_CHARS) | (own["n"] == own["n"].min())])
    langs = sorted(texts)
    chars = pd.Series(list("".join(texts.values()).lower()))
    seen = list(chars[chars.str.isalpha()].value_counts().index)
    number = {c: (i + 2, 0) for i, c in enumerate(seen[:MAX_LETTERS])}
    rare, digits = seen[MAX_LETTERS:], len(number) + 2
    base = int(np.ceil(np.sqrt(len(rare))))
    number |= {c: (digits + i // base, digits + base + i % base) for i, c in enumerate(rare)}
    # symbol 0: a letter that no sample has; 1: anything that is no letter
    codes = [number.get(c.lower()[0], (0, 0)) if (c := chr(i)).isalpha() else (1, 0) for i in range(0x110000)]
    symbols, seconds = (np.fromiter((c[k] for c in codes), dtype=np.uint16, count=0x110000) for k in (0, 1))
    width = digits + 2 * base
    tables, roots, weights, states = [], [], [], 0
    for lang in langs:
        own, _ = coded(np.frombuffer(texts[lang].encode("utf-32-le", "surrogatepass"), np.uint32), symbols, seconds)
        keep = np.ones(len(own), dtype=bool)
        keep[1:] = (own[1:] != 1) | (own[:-1] != 1)
        own = own[keep]
        own = np.append(own[own > 0], 1)
        table = automaton(own, width)
        failed = table < 0
        again = np.where(table[0] < 0, 0, table[0])
        table = np.where(failed, again, table)
        fits = (states + len(table)) * width * 2 < 2**31
        tables.append(((table + states) * width * 2 + failed).astype(np.int32 if fits else np.int64))
        roots.append(states * width)
        weights.append(np.log2(len(own) + 1))
        states += len(table)
    flat = np.concatenate(tables).ravel()
    return {"langs": langs, "symbols": symbols, "seconds": seconds, "table": flat, "roots": np.array(roots, flat.dtype), "weights": np.array(weights)}


def coded(codes: np.ndarray, symbols: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of code points, and the number of symbols of each."""
    s, second = symbols[codes], seconds[codes]
    two = second > 0
    sizes = 1 + two.astype(np.int64)
    if two.any():
        s = np.repeat(s, sizes)
        s[(np.cumsum(sizes) - 1)[two]] = second[two]
    return s, sizes


def entropies(texts: list[str], model: dict) -> np.ndarray:
    """Phrases * log2(sample) / length of each text (rows) against each language (columns)."""
    lens = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    s, sizes = coded(codes, model["symbols"], model["seconds"])
    doc = np.repeat(np.repeat(np.arange(len(texts)), lens), sizes)
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != 1) | (s[:-1] != 1) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    count = np.bincount(doc, minlength=len(texts))
    start = np.cumsum(count) - count
    pieces = (count + SEGMENT - 1) // SEGMENT
    seg_doc = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(seg_doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    seg_start = start[seg_doc] + nth * SEGMENT
    seg_len = np.minimum(SEGMENT, count[seg_doc] - nth * SEGMENT)
    order = np.argsort(-seg_len, kind="stable")
    seg_doc, seg_start, seg_len = seg_doc[order], seg_start[order], seg_len[order]
    k = len(model["langs"])
    at = np.repeat(model["roots"][None, :], len(seg_doc), axis=0)
    phrases = np.ones((len(seg_doc), k), dtype=np.int32)
    live = np.searchsorted(-seg_len, -np.arange(int(seg_len.max(initial=0))), side="left")
    table = model["table"]
    for j, n in enumerate(live.tolist()):
        step = table.take(at[:n] + s[seg_start[:n] + j][:, None])
        phrases[:n] += step & 1
        at[:n] = step >> 1
    total = np.zeros((len(texts), k))
    np.add.at(total, seg_doc, phrases)
    return total * model["weights"] / np.maximum(count, 1)[:, None]


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of (doc_id, text)."""
    lettered = docs.select("doc_id", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("lettered"), "text")
    if model is None:
        return lettered.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array(model["langs"], dtype=object)
        for batch in batches:
            for sl in words.slices(batch.column(2), SLICE_BYTES):
                n = len(sl.counts)
                texts = [t or "" for t in batch.column(2).slice(sl.first, n).to_pylist()]
                found = entropies(texts, model)
                best = found.argmin(axis=1)
                ranked = np.sort(found, axis=1)
                rest = ranked[:, 1] if len(langs) > 1 else np.inf
                score = np.clip(1 - ranked[:, 0] / np.maximum(rest, 1e-12), 0, 1)
                ok = batch.column(1).slice(sl.first, n).to_numpy(zero_copy_only=False).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(sl.first, n), pa.array(np.where(ok, langs[best], "und"), pa.string()), pa.array(np.where(ok, score, 0.0))], names=["doc_id", "lang_pred", "score"]
                )

    return lettered.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
