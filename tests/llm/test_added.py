"""Conversation repair, vector codes and personal data against brute force, with nulls, empties, ties, repeats, long texts and clashing columns."""

import hashlib
import heapq
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paceledger.llm import codes, pii, repair


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11: conversation repair ----------------------------------------------------------------------------------
BLANK = set("\x20\x09\x0a\x0b\x0c\x0d")


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        filled = [c for c in text if c not in BLANK]
        out.append("blank" if not filled else "duplicate" if (role, text) in seen else "truncated" if filled[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """The least (cost, audit) by a queue over (row, last initial), from rows (turn, role, text) without nulls but in turn."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    faults = faults_of(rows)
    following = {"": "u", "s": "u", "u": "a", "a": "u"}
    best, heap = {}, [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if (i, q) in best:
            continue
        best[i, q] = (cost, audit, out)
        to = following[q]
        name = {"u": "user", "a": "assistant"}[to]
        heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*out, f"{name}:")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        extra = 3 * (faults[i] == "truncated")
        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, to, (*out, f"{name}:{text}")))
        if role[:1] == to or (role[:1], q) == ("s", ""):
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
    cost, audit, out = min(best[len(rows), q] for q in ("", "a") if (len(rows), q) in best)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "lines": list(out),
    }


@pytest.fixture(scope="module")
def talks():
    rng = np.random.default_rng(11)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "Well then.  ", "é ü。", "a long one, " * 40 + "end."]
    roles = ["user", "assistant", "system", "tool", "user", "assistant", "", "User", "unknown"]
    rows = []
    for conv in range(60):
        for turn in range(int(rng.integers(1, 14))):
            at = None if rng.random() < 0.05 else int(turn + 2 * (rng.random() < 0.1))
            role = roles[rng.integers(len(roles))] if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = texts[rng.integers(len(texts))] if rng.random() < 0.6 else f"Said {conv} {turn}."
            rows.append((None if conv == 3 else conv, at, None if rng.random() < 0.03 else role, None if rng.random() < 0.03 else text, "other", 7))
    rows += [(100, 0, "user", "Same.", "x", 1)] * 40 + [(101, i, ("user", "assistant")[i % 2], f"Turn {i}.", "x", 1) for i in range(300)]
    return rows


@pytest.mark.parametrize("segment", [1, 2, 7, 8192])
def test_repair_equals_brute_force(spark, talks, segment, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    monkeypatch.setattr(repair, "TOGETHER", 500)
    rows = spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string, audit string, seg int").repartition(5)
    made, found = repair.repair(rows)
    lines = defaultdict(list)
    for r in made.orderBy("seg", "step").collect():
        if r["edit"] != "D":
            lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    digests = {r["conv_id"]: r["sha256"] for r in repair.digests(made).collect()}
    own = defaultdict(list)
    for conv, turn, role, text, *_ in talks:
        own[conv].append((turn, " " if role is None else role, " " if text is None else text))
    rows = found.collect()
    assert {r["conv_id"] for r in rows} == set(own)
    for r in rows:
        want = brute_repair(own[r["conv_id"]])
        assert {k: r[k] for k in want if k != "lines"} == {k: v for k, v in want.items() if k != "lines"}, r["conv_id"]
        assert lines[r["conv_id"]] == want["lines"]
        assert digests.get(r["conv_id"], sha("")) == sha("\n".join(want["lines"]))


def test_least_paths_rank_by_whole_audits():
    rng = np.random.default_rng(3)
    for _ in range(30):
        row = rng.integers(0, 16, int(rng.integers(1, 40)))
        last = np.array([True])
        dist = repair.costs(row[None, :], np.array([len(row)]), repair.ENDS[None, :], last)
        letter, target = repair.arcs(row[None, :], np.array([len(row)]), last, dist)
        path = repair.least_paths(letter, target, np.arange(4))
        for start in range(4):
            node, audit = start, []
            while letter[node]:
                audit.append(letter[node])
                node = target[node]
            assert letter[path[start]][: len(audit)].tolist() == audit
            assert not letter[path[start]][len(audit) :].any()


def test_repair_query_covers_conversations_without_rows(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Line {c} {t}." if t else None) for c in range(200) for t in range(1 + c % 3)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = repair.op11_conversation_repair(spark, str(tmp_path))
    names = got.columns
    view = duckdb.connect()
    view.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = view.execute(repair.OP11_SQL).fetchall()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert names == [d[0] for d in view.description]
    gone = [r for r in want if r[7] == "" and r[6] == 0]
    assert gone and all(r[8] == sha("") for r in gone)


def test_repair_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert repair.op11_conversation_repair(spark, str(tmp_path)).collect() == []


# ---- 12: vector codes -----------------------------------------------------------------------------------------
def brute_codes(vectors, rounds=codes.ROUNDS):
    """Full comparisons in every round, over rows in order of id."""
    q = np.array([[math.floor(1024 * float(x)) for x in v] for v in vectors], dtype=np.int64)
    out, books, errors = [], [], []
    for a, b in codes.cuts(q.shape[1]):
        part = q[:, a:b]
        book = part[: codes.ENTRIES].copy()
        for turn in range(rounds + 1):
            d = ((part[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            code = d.argmin(axis=1)
            if turn < rounds:
                for e in set(code.tolist()):
                    book[e] = part[code == e].sum(axis=0) // (code == e).sum()
        out.append(code)
        books.append(book)
        errors.append(d[np.arange(len(part)), code])
    return np.stack(out, 1), np.stack(errors, 1), books


@pytest.mark.parametrize(("n", "dim"), [(700, 16), (300, 10), (40, 8), (3, 4)])
def test_codes_equal_full_comparisons(spark, n, dim):
    rng = np.random.default_rng(n)
    # few distinct values, so that distances tie often
    vectors = (rng.integers(-3, 4, (n, dim)) / 1024 if n != 700 else rng.normal(0, 0.1, (n, dim))).tolist()
    rows = [(i, v, i % 3 if i % 5 else None, "x") for i, v in enumerate(vectors)]
    odd = [(n, None, 1, "x"), (n + 1, [0.1] * (dim - 1) + [None], 1, "x"), (n + 2, [float("nan")] * dim, 1, "x"), (n + 3, [float("inf")] + [0.0] * (dim - 1), 1, "x"), (n + 4, [], 1, "x")]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int, code string").repartition(4)
    got, books = codes.compress(table)
    code, error, brute_books = brute_codes(vectors)
    found = {r["vec_id"]: r for r in got.collect()}
    assert sorted(found) == list(range(n))
    for i in range(n):
        assert list(found[i]["code"]) == code[i].tolist()
        assert list(found[i]["dist"]) == error[i].tolist()
    assert all((a.entries == b).all() for a, b in zip(books, brute_books, strict=True))
    back = {r["vec_id"]: r["vector"] for r in codes.decoded(got, books).collect()}
    assert back[0] == [x / 1024 for p, b in enumerate(brute_books) for x in b[code[0, p]].tolist()]


def test_active_entries_compare_only_what_moved():
    rng = np.random.default_rng(1)
    x = rng.integers(-20, 20, (200, 4))
    entries = rng.integers(-20, 20, (30, 4))
    code, dist = codes.nearest(x, codes.Codebook(entries, np.ones(30, dtype=bool)), None, None)
    moved = np.zeros(30, dtype=bool)
    moved[[3, 7, 20]] = True
    new = entries + moved[:, None] * rng.integers(-9, 9, (30, 4))
    got = codes.nearest(x, codes.Codebook(new, moved), code, dist)
    d = ((x[:, None, :] - new[None]) ** 2).sum(axis=2)
    assert (got[0] == d.argmin(axis=1)).all() and (got[1] == d.min(axis=1)).all()
    same = codes.nearest(x, codes.Codebook(entries, np.zeros(30, dtype=bool)), code, dist)
    assert (same[0] == code).all()


def test_codes_of_repeats_null_ids_and_nothing(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    got, _ = codes.compress(spark.createDataFrame([(1, [0.5] * 4, None)] * 3 + [(None, [0.25] * 4, 2)], kind))
    assert sorted((r["vec_id"] is None, list(r["code"])) for r in got.collect()) == [(False, [0] * 4)] * 3 + [(True, [3] * 4)]
    none, books = codes.compress(spark.createDataFrame([], kind))
    assert none.collect() == [] and codes.digest(books) == sha("")
    with pytest.raises(Exception, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 4, 1)], kind))
    big = spark.createDataFrame([(i, [2.0**17 + i] * 4, 1) for i in range(5)], kind)
    assert all(r["dist"] == [0] * 4 for r in codes.compress(big)[0].collect())


# ---- 13: personal data ----------------------------------------------------------------------------------------
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, kind != 1 or all(int(p) <= 255 for p in m[0].split(".")), kind != 2 or (14 <= len(digits) <= 19 and luhn(digits)), kind != 3 or 10 <= len(digits) <= 15)
            if all(ok):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(13)
    pieces = ["a", "b.c", "@", ".", "..", "-", " ", "+", "%", "1", "25", "256", "0", "007", "4465758382889437", "4465 7583 8288-9437", "é", "@x.y", "1.2.3.4", "1.2.3.4.5.6.7.8", "+1 (523) 555-1055", "(", ")", "\n", "_", "٣", "😀"]
    for _ in range(6000):
        text = "".join(pieces[i] for i in rng.integers(0, len(pieces), int(rng.integers(1, 14))))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    n = 200_000
    for text in ("1" * n, "a" * n + "@", "1." * n, "1 " * n, "a@" * n, "+1" + "(" * n, "+1" * n, "a@b" + ".c" * n, "9" * n + ".1.1.1"):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def leaks():
    """A codename by one person's phone in texts that differ, a word of every text, and copies of a text that prove nothing."""
    rng = np.random.default_rng(31)
    word = lambda: f"w{rng.integers(0, 300)}"
    some = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{some(20)} Zephyrine the {some(3)} call +1 (523) 555-1055 {some(20)}" for _ in range(6)]
    texts += [f"{some(15)} the {some(25)}" for _ in range(150)]
    texts += [f"{some(15)} about zephyrine, alone"]
    texts += ["copied text Orchidea mails jo.x@mail.example.com or 10.0.0.255 today"] * 12
    return [*texts, None, "", " \n"]


def brute_terms(texts):
    """Terms and what they give away, by the definition."""
    n_term, n_entity, contexts = Counter(), Counter(), defaultdict(set)
    for text in texts:
        body = text or ""
        spans = plain_spans(body)
        words = list(pii.terms_of(body, spans))
        n_term.update({w for w, _, _ in words})
        met = defaultdict(set)
        for span in spans:
            e = pii.entity(body, span)
            met[e]
            near = {w for w, _, _ in [x for x in words if x[2] <= span[0]][-pii.WINDOW :] + [x for x in words if x[1] >= span[2]][: pii.WINDOW]}
            for t in near:
                met[e].add((t, min((pii._signed(pii._key(u)) for u in near if u != t), default=0)))
        for e, found in met.items():
            n_entity[e] += 1
            least = {}
            for t, c in found:
                least[t] = min(c, least.get(t, c))
            for t, c in least.items():
                contexts[t, e].add(c)
    out = {}
    for (t, e), n in ((k, len(c)) for k, c in contexts.items()):
        worth = math.log2(len(texts) / n_entity[e])
        if n >= pii.SUPPORT and worth > 0 and (d := 1 - math.log2(n_term[t] / n) / worth) >= pii.DISCLOSURE:
            out[t] = max(d, out.get(t, 0))
    return out


def test_disclosing_terms_equal_brute_force(spark, leaks):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(leaks)], "doc_id bigint, text string, spans string").repartition(5)
    terms = brute_terms(leaks)
    assert "zephyrine" in terms and "orchidea" not in terms and "the" not in terms
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert len(got) == len(leaks)
    for i, text in enumerate(leaks):
        body = text or ""
        base = plain_spans(body)
        want = sorted([*base, *((a, pii.TERM, b) for t, a, b in pii.terms_of(body, base) if t in terms)])
        assert [(s["start"], s["kind"], s["end"]) for s in got[i]] == want
        for s in got[i]:
            if s["kind"] == pii.TERM:
                assert s["strength"] == pytest.approx(terms[body[s["start"] : s["end"]].casefold()])


def test_sanitized_texts_hold_no_entity_and_clean_ones_stay(spark, leaks):
    docs = spark.createDataFrame(list(enumerate(leaks)), "doc_id bigint, text string")
    out = {r["doc_id"]: r["sanitized"] for r in pii.sanitize(docs).collect()}
    for i, text in enumerate(leaks):
        if text is None:
            assert out[i] is None
        elif not plain_spans(text) and "zephyrine" not in text.lower():
            assert out[i] == text
        else:
            assert not plain_spans(out[i])
    assert "[PHONE]" in out[0] and "zephyrine" not in out[0].lower()
    span = {"start": 2, "kind": pii.TERM, "end": 5, "strength": 0.85}
    assert pii.sanitized("a Bob c", [span]) == "a [NAME] c" and pii.sanitized("a Bob c", [span | {"strength": 1.0}]) == "a  c"
    assert pii.sanitized("12345678", [{"start": 0, "kind": 2, "end": 5, "strength": None}, {"start": 3, "kind": 3, "end": 7, "strength": None}]) == "[CARD]8"


def test_term_filter_agrees_with_the_tasks_hash(spark):
    terms = [f"térm{i}" for i in range(500)]
    bits = pii.term_filter(spark.createDataFrame([(t,) for t in terms], "term string"))
    assert all(pii._passes(bits, t) for t in terms)
    assert sum(pii._passes(bits, f"other{i}") for i in range(2000)) < 20
    assert pii.term_filter(spark.createDataFrame([], "term string")) == {}


def test_personal_data_of_the_table(spark, tiny, tmp_path):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in pii.op13_personal_data(spark, tiny).collect():
        spans = plain_spans(docs[r["doc_id"]] or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == sha(listed)
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term:")] == [s for s in listed.split(",") if s]
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert pii.op13_personal_data(spark, str(tmp_path)).collect() == []
