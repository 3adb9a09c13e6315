"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text's bytes cuts every document at content-defined
places, so passages that documents share fall into equal chunks. A chunk's
core, from its first to its last white space, depends on the chunk alone and
is encoded once per worker process, however many documents and tasks share it.
The cuts may fall inside words: each join between two cores is repaired by
encoding the run of characters between them anew. A repaired run is accepted
once the tokenizer, given the run with a word on either side, agrees with the
pieces put together; otherwise the window takes one word more on either side,
then two, four and so on, to the whole document in the end.

Inside a new core, words that the worker has met are looked up, and the rest go
to the tokenizer in batches. A worker process keeps its encoder with both memos
for all its tasks. The memos are bounded by the parameters below and only save
work: what they forget is encoded again. Documents are encoded where they are
read; nothing is shuffled, and a lost task is simply rerun. Sharing cores
between workers would move all text for less than it saves.

The word memo rests on what is checked when a tokenizer is loaded: white space
separates words and is dropped, and decoding joins the tokens' names. Texts of
any other tokenizer are encoded and decoded whole by the library.

Nulls, empties, ties: null text is encoded as the empty text: no tokens; ids,
lang or any other column may be null; repeated rows are encoded alike. Input
columns named like an asked output are replaced by it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from paceledger.llm import words

TOKENIZER = "word_bpe_49k.json"
#: Bytes the rolling hash sees; a cut follows where its low bits are zero, every MEAN_CHUNK bytes on average.
ROLL = 16
MEAN_CHUNK = 512
#: Limits of a worker's memos: entries of words, bytes of chunk cores with their tokens.
WORD_MEMO = 400_000
CHUNK_MEMO_BYTES = 32 << 20
SLICE_BYTES = 1 << 19
#: Short texts that share one call of the tokenizer.
TOGETHER = 512
#: Punctuation that is a token run of its own after a letter or digit, where it ends a word.
STOPS = b"!#$%&()*+,./:;<=>?@[]^_`{|}~\""

Piece = tuple[bytes, bytes]


def tokenizer_path(name: str) -> str:
    """``name`` if it is a path, else the place of that public tokenizer file."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoder(name: str) -> Encoder:
    """This process's encoder of a tokenizer; Python workers keep it from task to task."""
    return Encoder(name)


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class Encoder:
    """A worker's tokenizer with its memos of words and chunk cores: ids (little-endian uint32) and decoded text of each."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized}
        self.mark, self.mark_id = next(iter(specials.items()), (None, -1))
        self.by_words = self.drops_spaces()
        self.lower = self.by_words and self.encode([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]) == self.encode([b"abcdefghijklmnopqrstuvwxyz"])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.names[i] = token.encode("utf-8")
        ends = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
        #: Whether a token ends a run of letters; tokens of words without any other character are told apart by it.
        self.last = np.array([bool(ends) and n.endswith(ends.encode()) for n in self.names])
        self.ids: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}
        self.cores: dict[bytes, Piece] = {}
        self.core_bytes = 0
        self.new_cores = 0
        self.agreed: set[bytes] = set()

    def drops_spaces(self) -> bool:
        """True for tokenizers that split at white space and punctuation, drop the space and decode by joining tokens' names."""
        made = json.loads(self.tokenizer.to_str())
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "[^\\s\\p{L}\\p{N}]+" in str(steps[0].get("pattern", {}).get("Regex"))
        kinds = {n["type"] for n in (made.get("normalizer") or {}).get("normalizers", [])}
        return bool(split) and made.get("decoder") is None and made.get("post_processor") is None and kinds <= {"NFC", "Replace", "Lowercase"} and self.mark is not None

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """Token ids of each text; many short texts share a call, told apart by a special token between them."""
        mark = self.mark.encode() if self.mark else None
        apart = [i for i, t in enumerate(texts) if not self.by_words or len(t) > 1024 or mark[:2] in t]
        out: list[list[int]] = [[]] * len(texts)
        if apart:
            for i, e in zip(apart, self.tokenizer.encode_batch_fast([texts[i].decode("utf-8") for i in apart], add_special_tokens=False), strict=True):
                out[i] = e.ids
        alone = set(apart)
        together = [i for i in range(len(texts)) if i not in alone]
        for k in range(0, len(together), TOGETHER):
            group = together[k : k + TOGETHER]
            ids = np.asarray(self.tokenizer.encode(self.mark.join(texts[i].decode("utf-8") for i in group), add_special_tokens=False).ids)
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            flat, at = ids.tolist(), 0
            for i, end in zip(group, ends, strict=True):
                out[i] = flat[at:end]
                at = end + 1
        return out

    def decode(self, ids: list[int]) -> bytes:
        """As the library's decode, which for tokenizers without a decoder joins the tokens' names by spaces."""
        if not self.by_words:
            return self.tokenizer.decode(list(ids), skip_special_tokens=False).encode("utf-8")
        return b" ".join([self.names[i] for i in ids])

    def learn(self, new: list[bytes]) -> None:
        """Put words into the memo; punctuation that ends a word after a letter or digit is a token run of its own, so both parts are learned alone."""
        bare, tails = [], {}
        for w in new:
            base = w.rstrip(STOPS)
            if len(base) < len(w) and base[-1:].isalnum() and b"<|" not in w:
                tails[w] = base, w[len(base) :]
            else:
                bare.append(w)
        bare = [w for w in {*bare, *chain.from_iterable(tails.values())} if w not in self.ids]
        plain = [w for w in bare if w.decode("utf-8").isalpha()]
        for k in range(0, len(plain), TOGETHER):
            self.learn_letters(plain[k : k + TOGETHER])
        rest = [w for w in bare if w not in self.ids]
        for word, ids in zip(rest, self.encode(rest), strict=True):
            self.ids[word] = packed(ids)
            self.decoded[word] = self.decode(ids)
        for w, (base, tail) in tails.items():
            self.ids[w] = self.ids[base] + self.ids[tail]
            self.decoded[w] = self.decoded[base] + b" " + self.decoded[tail]

    def learn_letters(self, group: list[bytes]) -> None:
        """Learn words of letters from one text of them all: each ends with the first token that ends a run, if there are as many such tokens as words."""
        ids = np.asarray(self.tokenizer.encode(b" ".join(group).decode("utf-8"), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(group) or ends[-1] != len(ids):
            return
        raw, flat, at = ids.tobytes(), ids.tolist(), 0
        names = self.names
        for word, end in zip(group, ends.tolist(), strict=True):
            self.ids[word] = raw[4 * at : 4 * end]
            self.decoded[word] = names[flat[at]] if end == at + 1 else b" ".join([names[i] for i in flat[at:end]])
            at = end

    def join(self, ws: list[bytes]) -> Piece:
        return b"".join(map(self.ids.__getitem__, ws)), b" ".join(filter(None, map(self.decoded.__getitem__, ws)))

    def whole(self, text: bytes) -> Piece:
        ids = self.encode([text])[0]
        return packed(ids), self.decode(ids)

    def plain(self, text: bytes) -> bytes:
        """Text as the memo has it: the tokenizer lower-cases everything but its special tokens."""
        return text if b"<|" in text or not self.lower else text.lower()

    def slice(self, sl: words.Slice) -> Iterator[list[Piece]]:
        """The pieces of each document of a slice, in order."""
        raw = sl.data.tobytes()
        if not self.by_words:
            for i in range(len(sl.counts)):
                yield [self.whole(raw[sl.offsets[i] : sl.offsets[i + 1]])]
            return
        doc_parts = [parts(sl, raw, i) for i in range(len(sl.counts))]
        cores = {p for ps in doc_parts for p, run in ps if run is None}
        runs = {p: run for ps in doc_parts for p, run in ps if run is not None}
        if self.core_bytes > CHUNK_MEMO_BYTES:
            self.cores = {p: self.cores[p] for p in cores if p in self.cores}
            self.core_bytes = sum(len(p) + len(i) + len(d) for p, (i, d) in self.cores.items())
        split = {p: self.plain(p).split() for p in cores if p not in self.cores}
        wanted = set(chain.from_iterable(split.values()))
        wanted.update(runs)
        missing = wanted.difference(self.ids)
        if len(self.ids) + len(missing) > WORD_MEMO:
            kept = wanted.intersection(self.ids)
            self.ids = {w: self.ids[w] for w in kept}
            self.decoded = {w: self.decoded[w] for w in kept}
            self.agreed &= kept
        self.learn(list(missing))
        for p, ws in split.items():
            piece = self.cores[p] = self.join(ws)
            self.core_bytes += len(p) + len(piece[0]) + len(piece[1])
        self.new_cores += len(split)
        wrong = self.disagreeing(raw, sl, runs)
        for i, ps in enumerate(doc_parts):
            places = [run for p, run in ps if run is not None and p in wrong] if wrong else []
            if places:
                start, end = int(sl.offsets[i]), int(sl.offsets[i + 1])
                yield self.widened(raw[start:end], [(s - start, e - start) for s, e in places])
            else:
                yield [self.cores[p] if run is None else (self.ids[p], self.decoded[p]) for p, run in ps]

    def disagreeing(self, raw: bytes, sl: words.Slice, runs: dict[bytes, tuple[int, int]]) -> set[bytes]:
        """Of repaired runs, those where the tokenizer gives other tokens if a word stands on either side."""
        todo = [p for p in runs if p not in self.agreed]
        around = [context(raw, sl, *runs[p]) for p in todo]
        sides = {w for pair in around for w in pair if w and w not in self.ids}
        self.learn(list(sides))
        whole = self.encode([b" ".join(filter(None, (left, p, right))) for p, (left, right) in zip(todo, around, strict=True)])
        wrong = set()
        for p, (left, right), ids in zip(todo, around, whole, strict=True):
            if packed(ids) == self.ids.get(left, b"") + self.ids[p] + self.ids.get(right, b""):
                self.agreed.add(p)
            else:
                wrong.add(p)
        return wrong

    def widened(self, text: bytes, places: list[tuple[int, int]]) -> list[Piece]:
        """The pieces of a document around places whose runs disagree: each window of words grows until the tokenizer agrees with its neighbours' tokens."""
        ws = [self.plain(w) for w in text.split()]
        self.learn([w for w in set(ws) if w not in self.ids])
        pieces: list[Piece] = []
        done = 0
        for s, e in places:
            first, last = len(text[:s].split()), len(text[:e].split())
            if last <= done:
                continue
            step = 1
            while True:
                lo, hi = max(done, first - step), min(len(ws), last + step)
                window = self.whole(b" ".join(ws[lo:hi]))
                left, right = ws[lo - 1 : lo] if lo else [], ws[hi : hi + 1]
                known = self.join(left)[0] + window[0] + self.join(right)[0]
                if (lo == 0 and hi == len(ws)) or self.whole(b" ".join([*left, *ws[lo:hi], *right]))[0] == known:
                    break
                if lo == done and hi == len(ws):
                    return [self.whole(text)]
                step *= 2
            pieces += [self.join(ws[done:lo]), window]
            done = hi
        return [*pieces, self.join(ws[done:])]


def parts(sl: words.Slice, raw: bytes, i: int) -> list[tuple[bytes, tuple[int, int] | None]]:
    """A document as repaired runs and chunk cores in turn: (bytes, None for a core, else the run's place)."""
    start, end = int(sl.offsets[i]), int(sl.offsets[i + 1])
    lo, hi = np.searchsorted(sl.first_space, (start, end))
    out: list[tuple[bytes, tuple[int, int] | None]] = []
    at = start
    for s, e in zip(sl.first_space[lo:hi].tolist(), sl.after_space[lo:hi].tolist(), strict=True):
        if s > at:
            out.append((raw[at:s], (at, s)))
        if e - s > 1:
            out.append((raw[s:e], None))
        at = e
    if end > at:
        out.append((raw[at:end], (at, end)))
    return out


def context(raw: bytes, sl: words.Slice, s: int, e: int, near: int = 64) -> tuple[bytes, bytes]:
    """The whole words of less than ``near`` bytes before and after the run raw[s:e] of a document; empty if there is none."""
    doc = int(np.searchsorted(sl.offsets, s, side="right")) - 1
    before = raw[max(int(sl.offsets[doc]), s - near) : s].split()
    after = raw[e : min(int(sl.offsets[doc + 1]), e + near)].split()
    return before[-1] if len(before) > 1 else b"", after[0] if len(after) > 1 else b""


def chunked(sl: words.Slice) -> words.Slice:
    """Add the first and the place after the last white space of each content-defined chunk that has any."""
    spaces = np.flatnonzero(words._SPACE[sl.data])
    rolled = words.windows(words._BYTE[0][sl.data], ROLL)
    cuts = np.flatnonzero((rolled & np.uint64(MEAN_CHUNK - 1)) == 0) + ROLL
    doc = np.searchsorted(sl.offsets, cuts, side="left") - 1
    cuts = cuts[cuts - ROLL >= sl.offsets[doc]]
    edges = np.union1d(cuts, sl.offsets)
    first = np.searchsorted(spaces, edges[:-1], side="left")
    last = np.searchsorted(spaces, edges[1:], side="left") - 1
    filled = first <= last
    sl.first_space = spaces[first[filled]]
    sl.after_space = spaces[last[filled]] + 1
    return sl


OUTPUTS = {"ids": "array<bigint>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, *, text: str = "text", tokenizer: str = TOKENIZER, outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """``docs`` without ``text`` but with the asked outputs: token ids, the text decoded from them, their number and digests."""
    others = [c for c in docs.columns if c != text and c not in outputs]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema] + [f"{c} {OUTPUTS[c]}" for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made_by = encoder(tokenizer)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for sl in words.slices(column, SLICE_BYTES):
                made: dict[str, list] = {c: [] for c in outputs}
                for pieces in made_by.slice(chunked(sl)):
                    ids = b"".join([p for p, _ in pieces])
                    decoded = b" ".join([d for _, d in pieces if d])
                    for c in outputs:
                        if c == "ids":
                            made[c].append(np.frombuffer(ids, dtype="<u4").astype(np.int64))
                        elif c == "decoded":
                            made[c].append(decoded.decode("utf-8"))
                        elif c == "n_tokens":
                            made[c].append(len(ids) // 4)
                        else:
                            made[c].append(hashlib.sha256(ids if c == "ids_sha256" else decoded).hexdigest())
                rest = [batch.column(k).slice(sl.first, len(sl.counts)) for k in range(len(others))]
                kinds = {"ids": pa.list_(pa.int64()), "n_tokens": pa.int64()}
                yield pa.RecordBatch.from_arrays([*rest, *[pa.array(made[c], kinds.get(c, pa.string())) for c in outputs]], names=[*others, *outputs])

    return docs.select(*others, text).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
