"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

1. Four patterns find e-mail addresses, IP addresses, card and phone numbers
   (leftmost, non-overlapping within a kind; a match that fails its check is
   dropped and not tried again). What they find are the protected entities, and
   their spans stay whatever the next step says.
2. Information-theoretic sanitisation: within WINDOW words around each mention
   of an entity e, every other term t is counted with it. Over all documents,
   IC(e) = log2(N / n(e)) is what an entity's identity is worth, and
   PMI(t, e) = log2(N * n(t, e) / (n(t) * n(e))) is how much of it the term gives
   away. A term whose PMI is DISCLOSURE of IC(e) or more is a span of its own,
   wherever it stands; one that gives away REMOVED of it is taken out of a
   sanitised text, others are generalised to their class.

N, n(t) and n(e) count all documents, copies included. n(t, e) counts different
contexts, of a document one, named by a min-hash of the words around, and must be
SUPPORT at least: so copies of a text prove nothing, and a family of near copies
next to nothing, while their words still count in n(t).

How it scales: the pairs of a mention are bounded by the window, so they grow
with the text and not with its square, and are counted by (term, entity,
document) before any single key is. n(t) is needed for candidate terms alone:
pairs whose term stands in too many of the documents with entities already can't
reach the threshold and go first. A bitmap of the candidates' hashes, of a fixed
FILTER_BITS, goes to the tasks that scan the texts for them; what passes it by
chance falls out in the exact join. The bitmap only saves work: however many
candidates there are, the result is the same.

Nulls, empties, ties: null text is empty and has no spans; repeated rows are
documents of their own; a text is scanned whole and in linear time whatever its
length (runs of letters, digits or dots of any length are no trap). A word is a
run of Unicode word characters, compared casefolded. Columns of the input named
spans, sanitized or _uid are replaced by the results.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceledger.session import discard, materialize

KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")
WINDOW = 8
SUPPORT = 3
DISCLOSURE = 0.8
REMOVED = 0.95
FILTER_BITS = 1 << 24
#: A word of this many characters at least can be a term.
TERM_CHARS = 2
SPAN = "struct<start:int,kind:int,end:int,strength:double>"
#: Rows that a task gathers before it sends them; words of which it remembers that the bitmap doesn't have them.
PAIR_ROWS = 1 << 16
TERM_MEMO = 1 << 18

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Everything between the first and last digit of an address or a card number.
_DIGITS = re.compile(r"[0-9](?:[0-9 .-]*[0-9])?")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_WORD = re.compile(r"\w+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", end if found else at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every match of the four patterns, by start and kind, in code points."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for run in _DIGITS.finditer(text):
        if run.end() - run.start() < 7:
            continue
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text, run.start(), run.end()) if all(map(_small, m.groups()))]
        for m in _CARD.finditer(text, run.start(), run.end()):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def entity(text: str, span: tuple[int, int, int]) -> int:
    """A protected entity's key: one 64-bit hash for all ways of writing it."""
    start, kind, end = span
    plain = text[start:end].lower() if kind == 0 else ".".join(p.lstrip("0") or "0" for p in text[start:end].split(".")) if kind == 1 else re.sub("[^0-9]", "", text[start:end])
    return _signed(xxhash.xxh64_intdigest(f"{kind}:{plain}".encode(), seed=1)) or 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(term: str) -> int:
    """The hash that Spark's xxhash64 gives a string."""
    return xxhash.xxh64_intdigest(term.encode(), seed=42)


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words outside the spans."""
    at, covered = 0, -1
    for m in _WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            covered = max(covered, spans[at][2])
            at += 1
        if m.start() >= covered and m.end() - m.start() >= TERM_CHARS:
            yield m[0].casefold(), m.start(), m.end()


def cooccurrences(text: str, spans: list[tuple[int, int, int]], window: int) -> Iterator[tuple[str, int, int]]:
    """(term, entity, context) around every mention; ("", entity, 0) of each entity and (term, 0, 0) of each term of the text."""
    words = list(terms_of(text, spans))
    starts = [w[1] for w in words]
    yield from ((t, 0, 0) for t in {w[0] for w in words})
    for span in spans:
        e = entity(text, span)
        yield "", e, 0
        left, right = bisect_left(starts, span[0]), bisect_left(starts, span[2])
        near = {w[0] for w in (*words[max(0, left - window) : left], *words[right : right + window])}
        order = sorted((_signed(_key(t)), t) for t in near)
        for t in near:
            other = next((h for h, u in order if u != t), 0)
            yield t, e, other


def pairs(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(term, entity, n, contexts): documents of each pair and different contexts among them; entity 0 counts a term's documents, term '' an entity's, among documents with entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: set[tuple[int, str, int, int]] = set()
        for batch in batches:
            for uid, value in zip(batch["_uid"].to_pylist(), batch["_text"], strict=True):
                body = value.as_py() or ""
                if not (spans := base_spans(body)):
                    continue
                for term, e, context in cooccurrences(body, spans, window):
                    rows.add((uid, term, e, context))
                    if len(rows) >= PAIR_ROWS:
                        yield _pair_batch(rows)
                        rows = set()
        yield _pair_batch(rows)

    work = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(text).alias("_text"))
    met = work.mapInArrow(run, "uid bigint, term string, entity bigint, context bigint")
    once = met.groupBy("term", "entity", "uid").agg(F.min("context").alias("context"))
    per_context = once.groupBy("term", "entity", "context").agg(F.count("*").alias("n"))
    return per_context.groupBy("term", "entity").agg(F.sum("n").alias("n"), F.count("*").alias("contexts"))


def _pair_batch(rows: set[tuple[int, str, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["uid", "term", "entity", "context"])


def candidates(counted: DataFrame, n_docs: int, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term, n_pair, n_entity): pairs that may reach the threshold, as far as documents with entities tell."""
    own = counted.where("term <> '' AND entity <> 0").where(F.col("contexts") >= support).select("term", "entity", F.col("contexts").alias("n_pair"))
    entities = counted.where("term = ''").select("entity", F.col("n").alias("n_entity"))
    terms = counted.where("entity = 0").select("term", F.col("n").alias("n_term"))
    out = own.join(entities, "entity").join(terms, "term").where(strength(n_docs) >= disclosure)
    return out.select("term", "n_pair", "n_entity")


def strength(n_docs: int) -> Column:
    """PMI(term, entity) / IC(entity), from n_term, n_pair and n_entity; an entity of every document has nothing to give away."""
    worth = F.log2(F.lit(float(max(1, n_docs))) / F.col("n_entity"))
    return F.when(worth > 0, 1 - F.log2(F.col("n_term") / F.col("n_pair")) / worth).otherwise(0.0)


def term_filter(found: DataFrame) -> dict[int, bytes]:
    """A bitmap of the candidates' hashes, by bucket: FILTER_BITS / 8 bytes at most, however many candidates there are."""
    bit = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS))
    rows = found.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    return {r["bucket"]: bytes(r["bits"]) for r in rows.collect()}


def _passes(bits: dict[int, bytes], term: str) -> bool:
    # as Spark's bitmap functions number buckets and bits: from 1 on, 0 in a bucket of its own
    bit = _signed(_key(term)) % FILTER_BITS
    bucket, at = (1 + (bit - 1) // 32768, (bit - 1) % 32768) if bit else (0, 0)
    part = bits.get(bucket)
    return part is not None and bool(part[at >> 3] >> (at & 7) & 1)


def scan(work: DataFrame, bits: dict[int, bytes]) -> DataFrame:
    """``work`` (_uid, _row, _text) with base, the patterns' spans, and hits, one entry for each term of the text that passes the filter; without _text."""
    sent = work.sparkSession.sparkContext.broadcast(bits)
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("strength", pa.float64())])
    hit = pa.struct([("term", pa.string()), ("at", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failing: set[str] = set()
        for batch in batches:
            base, hits = [], []
            for value in batch["_text"]:
                body = value.as_py() or ""
                spans = base_spans(body)
                base.append([{"start": a, "kind": k, "end": b, "strength": None} for a, k, b in spans])
                met: dict[str, list[dict]] = {}
                if sent.value:
                    # words that the worker has met and that don't pass cost one set difference a text
                    new = set(_WORD.findall(body)) - failing
                    passing = {t for w in new if _passes(sent.value, t := w.casefold())}
                    failing.update(w for w in new if w.casefold() not in passing)
                    if len(failing) > TERM_MEMO:
                        failing.clear()
                    for term, a, b in terms_of(body, spans) if passing else ():
                        if term in passing:
                            met.setdefault(term, []).append({"start": a, "kind": TERM, "end": b, "strength": None})
                hits.append([{"term": t, "at": at} for t, at in met.items()])
            yield pa.RecordBatch.from_arrays([batch["_uid"], batch["_row"], pa.array(base, pa.list_(span)), pa.array(hits, pa.list_(hit))], ["_uid", "_row", "base", "hits"])

    spans = T.ArrayType(T.StructType.fromDDL("start int, kind int, end int, strength double"))
    hits = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("at", spans)]))
    schema = T.StructType([*work.select("_uid", "_row").schema.fields, T.StructField("base", spans), T.StructField("hits", hits)])
    return work.select("_uid", "_row", "_text").mapInArrow(run, schema)


def disclosing(hits: DataFrame, found: DataFrame, n_docs: int, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term, strength) of the candidates that reveal an entity, with n(t) over all documents, from one row of ``hits`` per document and term."""
    n_term = hits.groupBy("term").agg(F.count("*").alias("n_term"))
    rows = found.join(n_term, "term").select("term", strength(n_docs).alias("strength")).where(F.col("strength") >= disclosure)
    return rows.groupBy("term").agg(F.max("strength").alias("strength"))


def find(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` (columns ``keep``, or all) with spans: an array of (start, kind, end, strength) by start and kind; strength is null for the patterns' spans."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("spans", "_uid")]
    n_docs = docs.count()
    counted = materialize(pairs(docs, text, window), "cooccurrences")
    found = materialize(candidates(counted, n_docs, support, disclosure), "candidates")
    # rows are numbered once and written, so that a number means one row however often tasks are repeated
    numbered = docs.select(F.monotonically_increasing_id().alias("_uid"), F.struct(*keep).alias("_row"), F.col(text).alias("_text"))
    scanned = materialize(scan(numbered, term_filter(found)), "scanned")
    hits = scanned.select("_uid", F.explode("hits").alias("hit")).select("_uid", "hit.term", "hit.at")
    terms = materialize(disclosing(hits, found, n_docs, disclosure), "terms")
    spans = hits.join(terms, "term").select("_uid", F.transform("at", lambda s: s.withField("strength", F.col("strength"))).alias("at"))
    spans = spans.groupBy(F.col("_uid").alias("_of")).agg(F.flatten(F.collect_list("at")).alias("terms"))
    out = scanned.join(spans, F.col("_uid") == F.col("_of"), "left")
    every = F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(f"array<{SPAN}>"))))
    discard(counted, found)
    return out.select("_row.*", every.alias("spans"))


def _class_of(word: str, kind: int) -> str:
    """What a span becomes in a sanitised text: its kind, or a term's class."""
    if kind != TERM:
        return f"[{KINDS[kind].upper()}]"
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"


def sanitized(text: str | None, spans: list[dict], removed: float = REMOVED) -> str | None:
    """The text with each span replaced by its class; terms that give away ``removed`` of an entity are taken out. Overlapping spans are one."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out.append(text[at : s["start"]])
            if s["strength"] is None or s["strength"] < removed:
                out.append(_class_of(text[s["start"] : s["end"]], s["kind"]))
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def sanitize(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with spans and sanitized, the text without personal data; a null text stays null."""
    found = find(docs, text=text, **options)
    replace = F.udf(lambda body, spans: sanitized(body, spans), "string", useArrow=True)
    return found.withColumn("sanitized", replace(F.col(text), F.col("spans")))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(len(KINDS))]  # noqa: B023
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
