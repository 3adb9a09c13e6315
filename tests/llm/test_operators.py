"""The training-data operators against brute force, with nulls, empties, ties, repeats, long texts and clashing columns."""

import hashlib
import re
import string
from collections import Counter, defaultdict
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceledger.llm import bpe, chat, graph, langid, lines, maxscore, mixing, neardup, quality, substring, urls
from paceledger.session import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string"


def words_of(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def prose(rng, n, vocabulary=400):
    return [f"w{i}" + "é" * int(i % 3 == 0) for i in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Small documents with every awkward case, and a column that clashes with results."""
    rng = np.random.default_rng(5)
    base = prose(rng, 120)
    near = base[:60] + ["changed"] + base[61:]
    passage = prose(rng, 50, 10**6)
    long = prose(rng, 30_000, 10**6)
    texts = [
        " ".join(base), " ".join(base), " ".join(near), " ".join(w.upper() for w in near), None, "", " \t\n ", "one", "one two three", "one two three",
        " ".join(prose(rng, 80) + passage + prose(rng, 40)), " ".join(prose(rng, 20) + passage), " ".join(passage[:34]), "a b " * 200, " ".join(long),
        "\n".join(["same line here"] * 5 + ["other"]), "x" * 5000, "### $$$ %%% *** ### ||| <<< >>> &&& ###", " ".join(long[:15_000] + ["cut"] + long[15_000:]),
    ]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s1", "s2", None)[i % 4], None, "clash") for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None, 1, None), (3, texts[3], "en", "s1", 1, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def local(docs):
    return docs.collect()


# ---- 1 ------------------------------------------------------------------------------------------------------
def brute_repeats(texts, n):
    ws = [words_of(t) for t in texts]
    times = Counter(tuple(w[i : i + n]) for w in ws for i in range(len(w) - n + 1))
    out = []
    for w in ws:
        stay = [True] * len(w)
        for i in range(len(w) - n + 1):
            if times[tuple(w[i : i + n])] > 1:
                stay[i : i + n] = [False] * n
        out.append((len(w), stay.count(False), sha(" ".join(x for x, s in zip(w, stay) if s))))
    return out


@pytest.mark.parametrize("n", [35, 8])
def test_substring(docs, local, n):
    got = substring.remove_repeats(docs, min_words=n).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(repr, (tuple(r)[1:] for r in got))) == sorted(map(repr, brute_repeats([r.text for r in local], n)))


def test_substring_keeps_words_in_text(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(50))) + "  end"), (2, "start\n" + " ".join(map(str, range(50))))], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in substring.remove_repeats(df).collect()}
    assert got == {1: "end", 2: "start"}


def test_substring_doubles_until_none_survive(spark):
    shared = " ".join(f"t{i}" for i in range(150))
    df = spark.createDataFrame([(1, shared + " x"), (2, "y " + shared)], "doc_id bigint, text string")
    levels = substring.repeats(df, longest=0)
    assert [length for length, _ in levels] == [35, 70, 140, 280]
    assert {r.doc_id: len(r.places) for r in levels[2][1].collect()} == {1: 11, 2: 11} and levels[3][1].count() == 0


def test_substring_empty(spark, docs):
    assert substring.remove_repeats(docs.limit(0)).count() == 0


# ---- 2 ------------------------------------------------------------------------------------------------------
NASTY = ["\\### Assistant: </turn> ok", "", "\\", "\\\\h#<l:", "###", "a\n </turn>\n### user: b", "é \U0001f600 : x", "\\c\\\\c", "t" * 20000]


def test_chat_round_trip(spark):
    rows = [(c, i, role, text) for c in range(3) for i, (role, text) in enumerate((("user", NASTY[(c + k) % len(NASTY)]) if k % 2 else ("assistant", NASTY[(c * 3 + k) % len(NASTY)])) for k in range(9))]
    rows += [(9, 0, None, None), (9, 1, "ro:le", "x"), (None, 0, "user", "q"), (4, 5, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_chats(chat.from_rows(df)).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_mask")))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].back] == turns
        assert got[c].loss == "".join(t for r, t in turns if r == "assistant")
        assert got[c].layout == "turns"


def test_chat_layouts(spark):
    records = [
        ('{"prompt":"p","completion":"c"}', "prompt_completion", ["p", "c"]),
        ('{"completion":null,"prompt":"p"}', "prompt_completion", ["p", ""]),
        ('{"messages":[{"content":"x","role":"user"},{"role":"assistant","content":"y"}]}', "messages", ["x", "y"]),
        ('{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"y"}]}', "from_value", ["x", "y"]),
        ('{"instruction":"i","input":"n","output":"o"}', "instruction_input_output", ["i", "n", "o"]),
        ('{"unknown":1}', None, []),
        ('{"id":7,"messages":[{"role":"user","content":"x","name":"n","meta":{"text":[1,{"role":2}]}}],"turn":{"prompt":"no"}}', "messages", ["x"]),
        ('{"messages":[]}', "messages", []),
        ('{"response":"r","meta":{"completion":"no"},"prompt":"p","score":1.5}', "prompt_response", ["p", "r"]),
        ('{"dialogue":[{"speaker":"user","utterance":"x"},{"speaker":null,"utterance":3}]}', "dialogue", ["x", "3"]),
        ('{"prompt":"p"}', None, []),
        ('{"prompt":"p","completion":"c","messages":[{"role":"user","content":"x"}]}', None, []),
        ('{"messages":[{"role":"user"}]}', None, []),
        ('{"messages":["a","b"]}', None, []),
        ('{"messages":[{"role":"user","content":"x"},"junk"]}', None, []),
        ('{"messages":[{"role":"user","content":"x"},null]}', None, []),
        ('{"messages":[{"role":"user","content":"x"},7,[{"role":"user","content":"x"}]]}', None, []),
        ('{"messages":null}', None, []),
        ('{"messages":{"role":"user","content":"x"}}', None, []),
        ('{"x, prompt: y":1,"completion":"a"}', None, []),
        ('{"a>b, `prompt`: <x":{"y":"}"},"prompt":"p","completion":"c"}', "prompt_completion", ["p", "c"]),
        ('{"messages":[{"role":"user","content":"x"},{"role":"assistant"}]}', "messages", ["x", ""]),
        ("[1,2]", None, []),
        ("not json", None, []),
        (None, None, []),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(records)], "id int, record string")
    got = {r.id: r for r in chat.format_chats(df).collect()}
    for i, (_, layout, texts) in enumerate(records):
        assert got[i].layout == layout and [t.text for t in got[i].turns] == texts
    assert [t.role for t in got[3].turns] == ["user", "assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0
    assert sorted(r.id for r in chat.quarantined(chat.format_chats(df)).collect()) == [i for i, r in enumerate(records) if r[1] is None]


def test_chat_clashing_columns(spark):
    df = spark.createDataFrame([('{"prompt":"p","completion":"c"}', "a", "b", "c", "d")], "record string, layout string, turns string, formatted string, loss_mask string")
    got = chat.format_chats(df)
    assert sorted(got.columns) == sorted(df.columns) and got.first().layout == "prompt_completion"


def test_chat_query_uses_mappings(spark, tiny):
    """The query's conversations come in several layouts, and each record's fingerprint finds its mapping."""
    rows = spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text")
    records = chat.mixed_layouts(chat.from_rows(rows))
    found = {r.layout: r["count"] for r in chat.canonical(records.where("json IS NOT NULL"), "json").groupBy("layout").count().collect()}
    assert None not in found and {"messages", "dialogue", "turns"} <= set(found) and records.where("record IS NOT NULL").count() > 0


def test_chat_rows_have_no_size_limit(spark):
    """A text above the JSON parser's limit is formatted; a JSON record above it fails loudly."""
    rows = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("x"), 20_000_001).alias("text"))
    got = chat.format_chats(chat.from_rows(rows)).select("layout", F.size("turns").alias("n"), F.col("loss_mask")[0]["length"].alias("loss")).first()
    assert tuple(got) == ("turns", 1, 20_000_001)
    record = rows.select(F.concat(F.lit('{"prompt":"p","completion":"'), "text", F.lit('"}')).alias("record"))
    with pytest.raises(Exception, match="doesn't parse"):
        chat.format_chats(record).select("layout").collect()


def test_chat_struct_records(spark):
    df = spark.sql("SELECT struct('p' AS prompt, CAST(NULL AS STRING) AS completion) AS record, 1 AS id UNION ALL SELECT NULL, 2")
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.format_chats(df).collect()}
    assert got == {1: ("prompt_completion", [("user", "p"), ("assistant", "")]), 2: (None, [])}


# ---- 3 ------------------------------------------------------------------------------------------------------
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_components(rows, n, percent=80):
    sets = {}
    for i, text in rows:
        w = words_of((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(docs, local):
    got = neardup.near_duplicates(docs, shingle=4).collect()
    want = brute_components([(r.doc_id, r.text) for r in local if r.doc_id is not None], 4)
    assert len(got) == len(local)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]


def test_near_duplicates_family(spark):
    """A family around the threshold, where links form chains."""
    rng = np.random.default_rng(3)
    base = prose(rng, 150, 10**6)
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            w[at] = f"edit{i}_{at}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(prose(rng, 100))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_components(rows, 5)
    assert sorted(r.doc_id for r in neardup.dedup(df).collect()) == sorted(i for i, v in got.items() if v[2])


def test_near_duplicates_large_family(spark):
    """300 texts around the threshold that share edits, two bases a fifth apart, and a passage that unrelated texts hold."""
    rng = np.random.default_rng(8)
    base = prose(rng, 140, 10**6)
    other = [w if i % 19 else f"other{i}" for i, w in enumerate(base)]
    rows = []
    for i in range(300):
        w = list(base if i % 2 else other)
        for at in rng.choice(140, int(rng.integers(1, 10)), replace=False):
            w[at] = f"edit{at}_{rng.integers(0, 4)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(prose(rng, 30) + base[20:60] + prose(rng, 30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    want = brute_components(rows, 5)
    assert got == want and 20 < sum(v[2] for v in want.values()) < 320


def test_dedup_of_repeated_rows(spark):
    """Equal rows leave one; rows of one id are one document; null ids stay; other columns may have any name."""
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, text, 1), (1, text, 1), (2, text, 2), (3, "x y z u v w", 3), (3, text, 4), (4, "only here but of a good length", 5), (4, "and another text of this very id", 6), (None, text, 7), (None, text, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint").withColumns({c: F.lit("clash") for c in ("component", "kept", "_n", "node")})
    out = neardup.dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.n) for r in out.collect()) == [(0, 7), (0, 7), (1, 1), (4, 5), (4, 6)]


def test_near_duplicates_empty(docs):
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_path(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.components(links)
    assert got.count() == 301 and got.select("component").distinct().collect()[0][0] == 0


# ---- 4 ------------------------------------------------------------------------------------------------------
def test_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "123 !? 4", "fr"), (-4, "the of and to " * 20000, None), (None, "the and of that", "de")], "doc_id bigint, text string, lang string")
    found = langid.predict(docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), langid.learn(docs))
    got = {r.doc_id: r for r in found.collect()}
    held = docs.where(langid.held_out(F.col("doc_id"))).select("doc_id", "lang").collect()
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and got[-4].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.learn(odd.limit(0)) is None and {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_language_of_many_letters_and_any_length(spark):
    """Scripts of thousands of letters, and languages whose documents are all long or all short."""
    rng = np.random.default_rng(6)
    blocks = {"en": (0x61, 26), "zh": (0x4E00, 1500), "ko": (0xAC00, 1500), "el": (0x3B1, 17), "ru": (0x430, 32)}
    words = {k: ["".join(chr(at + c) for c in rng.integers(0, n, 2)) for _ in range(500)] for k, (at, n) in blocks.items()}
    length = {"el": (2000, 2001), "ru": (10, 25)}
    rows = [(i, " ".join(rng.choice(words[k], int(rng.integers(*length.get(k, (60, 200)))))), k) for i, k in enumerate(list(blocks) * 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(df.select("doc_id", "text"), langid.learn(df)).collect()}
    assert got == {i: k for i, _, k in rows}


def test_cross_parse_counts_longest_matches():
    table = langid.automaton(np.array([2, 3, 2, 2, 3]), 4)
    text, sample, at, phrases = [2, 3, 3, 2, 2, 3, 2], "23223", 0, 0
    for c in text:
        if table[at, c] < 0:
            phrases, at = phrases + 1, 0
        at = table[at, c]
    parts, rest = 0, "".join(map(str, text))
    while rest:
        parts += 1
        rest = rest[max(k for k in range(1, len(rest) + 1) if rest[:k] in sample) :]
    assert phrases + 1 == parts


def test_language_against_brute_force(spark, tiny):
    """Every prediction's phrases counted by searching the sample text itself, segment by segment."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = langid.learn(docs)
    rows = langid.sample(docs)
    coded = {}
    for lang, own in rows.groupby("lang"):
        upto = own["text"].str.len().cumsum()
        text = " ".join(own["text"][(upto <= langid.SAMPLE_CHARS) | (own["n"] == own["n"].min())])
        s = symbols_of(text, model)
        coded[lang] = "".join(chr(c + 32) for c in s if c > 0) + chr(33)
    texts = [r.text for r in docs.limit(25).collect()] + ["", "?!", "\u4e00\u4e01 abc \u4e00", "a" * 3000]
    got = langid.entropies(texts, model)
    for i, t in enumerate(texts):
        s = [chr(c + 32) for c in symbols_of(t, model)]
        for k, lang in enumerate(model["langs"]):
            phrases = 0
            for at in range(0, len(s), langid.SEGMENT):
                rest = "".join(s[at : at + langid.SEGMENT])
                phrases += 1
                begin = 0
                for j in range(len(rest)):
                    if rest[begin : j + 1] not in coded[lang]:
                        phrases += 1
                        begin = j if rest[j] in coded[lang] else j + 1
            want = phrases * model["weights"][k] / max(1, len(s))
            assert abs(got[i, k] - want) < 1e-9


def symbols_of(text, model):
    """Symbols of a text, runs of what is no letter as one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for c in langid.coded(codes, model["symbols"], model["seconds"])[0].tolist():
        if c != 1 or not out or out[-1] != 1:
            out.append(c)
    return out


# ---- 5 ------------------------------------------------------------------------------------------------------
def test_bpe_equals_the_library(docs, spark, tiny):
    from tokenizers import Tokenizer

    odd = ["a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "don't THEY'LL we've 12,34.", "É é   x", "日本語 テスト。 한국어", "x" * 3000, "a." * 700 + " ,. .,", "İstanbul ΑΣ ς ﬁn", "word&&& it's## 'tis' x!? (a) a_b __ __a a'&& é!! \u0301x a\u0301. 3) ½% <|a|> a<|endoftext|>.", "a\u00a0 \u00a0b \u2003.c\u200d, ª² ǅa ʰ. \u1e9e"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")).unionByName(spark.read.parquet(f"{tiny}/documents.parquet").select((F.col("doc_id") + 2000).alias("doc_id"), "text"))
    texts = {(r.doc_id, r.text) for r in rows.collect()}
    tokenizer = Tokenizer.from_file(bpe.tokenizer_path(bpe.TOKENIZER))
    want = {}
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i] = (ids, tokenizer.decode(ids, skip_special_tokens=False), len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    got = bpe.encode_decode(rows).collect()
    assert len(got) == rows.count()
    for r in got:
        assert (list(r.ids), r.decoded, r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id]


def test_bpe_widens_a_join_that_disagrees():
    """Where a neighbour changes a run's tokens, the window around it grows until it agrees, to the whole document at last."""
    import pyarrow as pa

    from paceledger.llm import words

    text = " ".join(f"word{i % 7} and Other{i}." for i in range(300))
    coder = bpe.Encoder(bpe.TOKENIZER)
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    (sl,) = words.slices(pa.array([text]))
    coder.disagreeing = lambda raw, sl, runs: set(runs)
    (pieces,) = coder.slice(bpe.chunked(sl))
    assert len(pieces) > 5 and np.frombuffer(b"".join(p for p, _ in pieces), "<u4").tolist() == want
    whole, calls = coder.whole, []
    coder.whole = lambda t: calls.append(len(t.split())) or (whole(t) if len(t.split()) >= 900 else (b"bad" + whole(t)[0], b""))
    (pieces,) = coder.slice(bpe.chunked(sl))
    assert len(pieces) == 1 and np.frombuffer(pieces[0][0], "<u4").tolist() == want
    assert sorted(set(calls[::2]))[:4] == sorted(calls[::2])[:4] and max(calls) == 900


def test_bpe_encodes_a_shared_chunk_once_per_worker(spark):
    """Two documents in two tasks of one Python worker: the second finds every core of the first."""
    text = " ".join(f"shared{i} words{i * 7}" for i in range(400))

    def run(batches):
        import pandas as pd
        import pyarrow as pa

        from paceledger.llm import words

        coder = bpe.encoder(bpe.TOKENIZER)
        for pdf in batches:
            before = coder.new_cores
            for t in pdf["text"]:
                for sl in words.slices(pa.array([t])):
                    list(coder.slice(bpe.chunked(sl)))
            yield pd.DataFrame({"pid": [__import__("os").getpid()], "new": [coder.new_cores - before]})

    df = spark.createDataFrame([(f"start{k} {text} end{k}",) for k in range(40)], "text string").repartition(40)
    by_worker = {}
    for r in df.mapInPandas(run, "pid bigint, new bigint").collect():
        by_worker.setdefault(r.pid, []).append(r.new)
    assert len(by_worker) < 40
    for new in by_worker.values():
        most, *others = sorted(new, reverse=True)
        assert most > 10 and all(n <= 2 for n in others)


def test_bpe_of_another_tokenizer(spark):
    """A tokenizer that keeps white space is left to the library."""
    from tokenizers import Tokenizer

    texts = ["Hello  world, it's\n fine", "", None, " leading and trailing  ", "\u00e9\u65e5 \U0001f600"]
    t = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in bpe.encode_decode(df, tokenizer="byte_bpe_50k.json", outputs=("ids", "decoded")).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (list(r.ids), r.decoded) == (ids, t.decode(ids, skip_special_tokens=False))


# ---- 6 ------------------------------------------------------------------------------------------------------
def test_url_filter(spark):
    feed = spark.sql("SELECT entry, CAST(day AS DATE) AS day, listed FROM VALUES ('bad.example', '2024-01-10', true), ('BAD.example', '2024-01-20', false), ('x.bad.example', '2024-01-15', true), ('t.example', '2024-01-05', true), ('t.example', '2024-01-05', false), (NULL, '2024-01-01', true), ('n.example', NULL, true) AS t(entry, day, listed)")
    captures = spark.sql("SELECT id, url, CAST(day AS DATE) AS day, 'clash' AS entry2 FROM VALUES (1, 'http://bad.example/a', '2024-01-09'), (2, 'https://www.BAD.example:80/a', '2024-01-10'), (3, 'http://bad.example', '2024-01-20'), (4, 'http://a.x.bad.example/', '2024-01-16'), (5, 'http://notbad.example', '2024-01-16'), (6, NULL, '2024-01-16'), (7, 'no url', '2024-01-16'), (8, 'http://t.example', '2024-01-06'), (9, 'http://bad.example', NULL), (4, 'http://a.x.bad.example/', '2024-01-16') AS t(id, url, day)")
    got = {r.id: (r.blocked, r.entry) for r in urls.evaluate(captures, feed).collect()}
    assert got == {1: (False, None), 2: (True, "bad.example"), 3: (False, None), 4: (True, "x.bad.example"), 5: (False, None), 6: (False, None), 7: (False, None), 8: (False, None), 9: (False, None)}
    kept = urls.filter_urls(captures, feed)
    assert kept.columns == captures.columns and kept.count() == 7
    clash = captures.withColumns({c: F.lit("x") for c in ("host", "entry", "hit", "_row", "_day", "_host")})
    assert sorted((r.id, r.blocked) for r in urls.evaluate(clash, feed).collect()) == sorted((r.id, r.blocked) for r in urls.evaluate(captures, feed).collect())
    assert urls.evaluate(captures.limit(0), feed).count() == 0 and urls.filter_urls(captures, feed.limit(0)).count() == 10


@pytest.mark.parametrize(
    ("url", "host"),
    [
        ("http://user:pw@Bad.Example/", "bad.example"), ("https://u@bad.example:8080?x", "bad.example"), ("http://a@b@bad.example#f", "bad.example"), ("http://bad.example./p", "bad.example"),
        ("http://bad.example..", "bad.example"), ("http://[2001:DB8::1]:80/", "[2001:db8::1]"), ("http://u:p@[::1]", "[::1]"), (" \t http://bad.example", "bad.example"),
        ("http://good.example\\@bad.example/", "good.example"), ("http://ok.example/@bad.example", "ok.example"), ("http:///path", None), ("http://.", None), ("no url", None), ("", None), (None, None),
        ("http://" + "x" * 100_000 + ".example/", "x" * 100_000 + ".example"),
    ],
)
def test_host(spark, url, host):
    import duckdb

    assert spark.createDataFrame([(url,)], "u string").select(lines.host_of(F.col("u")).alias("h")).first().h == host
    assert duckdb.execute(f"SELECT nullif(rtrim(lower(regexp_extract(?, '{lines.HOST}', 1)), '.'), '')", [url]).fetchone()[0] == host


# ---- 7 ------------------------------------------------------------------------------------------------------
def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def near(taken, target, sizes):
    """Whole documents come near a target: by half a hundredth of it or the least document's size."""
    return abs(taken - target) <= max(target / 200, min((n for n in sizes if n), default=0) + 1)


def test_mixing_takes_whole_documents_near_the_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ("a", "b", "c", "tiny", None)[int(k)], int(n), int(rng.integers(-(2**62), 2**62))) for i, (k, n) in enumerate(zip(rng.choice(5, 600, p=[0.05, 0.3, 0.5, 0.01, 0.14]), rng.integers(0, 900, 600)))]
    rows += [(1000, "b", 40_000, 5), (1001, "one", 700, 6), (1002, "nothing", 0, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, key bigint")
    taken = lambda: {r.doc_id: (r.source, r.size, r.target, len(r.draws)) for r in mixing.takes(df, shard_words=1 << 13).collect()}
    got = taken()
    sizes = defaultdict(list)
    for _, s, n, _ in rows:
        sizes[s].append(n)
    want = brute_targets({s: sum(n) for s, n in sizes.items()})
    for s, target in want.items():
        own = [v for v in got.values() if v[0] == s]
        assert abs(own[0][2] - target) < 1e-6 and near(sum(v[1] * v[3] for v in own), target, sizes[s]), s
        assert len({v[3] for v in own if v[1]} ) <= 2
    assert len(got) == len(rows) and all(v[3] <= 3 for v in got.values()) and got[1002][3] == 0
    assert got == taken()


def test_mixing_fills_gaps_with_the_largest_that_fit(spark):
    docs = spark.createDataFrame([("a", k, n) for k, n in enumerate([50, 40, 40, 9, 5, 3, 1, 0])] + [(None, 99, 7)], "source string, key bigint, size bigint")
    rest = spark.createDataFrame([("a", 100), (None, 6)], "source string, lack bigint")
    got = {r.key for r in mixing.fill(docs, rest).collect()}
    # 50, 40, 9 and 1 fill 100; 7 is nearer to 6 than nothing
    assert got in ({0, 1, 3, 6, 99}, {0, 2, 3, 6, 99})
    far = spark.createDataFrame([("a", 3)], "source string, lack bigint")
    assert [r.key for r in mixing.fill(docs.where("size > 5"), far).collect()] == []


def test_running_sums_by_range(spark):
    rng = np.random.default_rng(4)
    rows = [(("hot", "hot", "b", None)[int(k)], i, int(n)) for i, (k, n) in enumerate(zip(rng.integers(0, 4, 500), rng.integers(0, 50, 500)))]
    got = mixing.running(spark.createDataFrame(rows, "source string, id bigint, n bigint"), F.col("n"), "id").collect()
    assert len(got) == 500
    for s in ("hot", "b", None):
        own = sorted((r for r in got if r.source == s), key=lambda r: r.id)
        assert [r.place for r in own] == list(range(1, len(own) + 1))
        assert [r.upto for r in own] == np.cumsum([r.n for r in own]).tolist()


def test_mixing_tree_splits_exactly(spark):
    quotas = {"a": 70, None: 41, "b": 0, "c": 5}
    df = spark.createDataFrame(list(quotas.items()), "source string, quota bigint")
    for depth in (1, 4, 7, 9):
        got = mixing.leaves(df, depth, 1).collect()
        total, each = Counter(), Counter()
        for r in got:
            total[r.source] += r.quota
            each[r.shard] += r.quota
        assert dict(total) == {s: n for s, n in quotas.items() if n}
        assert max(each.values()) - min(each[i] for i in range(2**depth)) <= 1 and set(each) <= set(range(2**depth))
    assert len({r.shard for r in mixing.leaves(df, 6, 1).collect()}) == 64


def test_draws_of_large_populations(monkeypatch):
    monkeypatch.setattr(mixing, "MOST_DRAWN", 100)
    quota = np.array([700, 255, 0, 90, 3])
    left = mixing.left_half(quota, np.random.default_rng(1))
    assert left.sum() == quota.sum() // 2 and (left <= quota).all() and abs(left[0] - 350) < 40


def test_mixing_shards(spark):
    """Every draw goes to one shard, shards get equally many and none is empty, quotas are the tree's, and each shard's rows are neighbours in keyed order."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(prose(rng, int(rng.integers(5, 60)))), str(rng.choice(["a", "b", "c"], p=[0.6, 0.3, 0.1]))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit("clash") for c in ("size", "draws", "key", "block", "target", "_n", "d", "passes")})
    sized = docs.select("source", mixing.size_of(F.col("text")).alias("size"), F.xxhash64("doc_id").alias("key"))
    depth = 5
    goal, blocks, singles = mixing.plan(sized, depth=depth, shard_words=1 << 9)
    draws = [(r.source, "block", r.block, d.copy, d.shard) for r in blocks.collect() for d in r.draws] + [(r.source, "single", r.key, d.copy, d.shard) for r in singles.collect() for d in r.draws]
    assert len({x[:4] for x in draws}) == len(draws)
    shards = Counter(x[4] for x in draws)
    assert sorted(shards) == list(range(2**depth)) and max(shards.values()) - min(shards.values()) <= 1
    quotas = spark.createDataFrame(list(Counter(x[0] for x in draws).items()), "source string, quota bigint")
    assert {(r.shard, r.source): r.quota for r in mixing.leaves(quotas, depth, mixing.SEED).collect()} == dict(Counter((x[4], x[0]) for x in draws))
    mixed = mixing.mix(docs, depth=depth, shard_words=1 << 9)
    assert mixed.columns == [*docs.columns, "_shard", "_order"]
    parts = mixing.sharded(mixed).rdd.glom().map(lambda p: [(r["_shard"], r["_order"]) for r in p]).collect()
    assert all(p == sorted(p) for p in parts) and sum(map(len, parts)) == mixed.count()
    where = [s for p in parts for s in {r[0] for r in p}]
    assert len(where) == len(set(where))
    text, got = {i: t for i, t, _ in rows}, Counter()
    for r in mixed.collect():
        assert r.text == text[r.doc_id]
        got[r.source] += len(words_of(r.text))
    for s, n in brute_targets({k: sum(len(w.split()) for _, w, s in rows if s == k) for k in "abc"}).items():
        assert near(got[s], n, [len(w.split()) for _, w, k in rows if k == s])
    assert mixing.depth_for(spark.sql("SELECT 100 * 1048576D AS target")) == 7 and mixing.depth_for(spark.sql("SELECT CAST(NULL AS DOUBLE) AS target")) == 1


def test_mix_rows(spark, docs):
    out = mixing.mix(docs, shard_words=1 << 8).collect()
    texts, sizes = set(), defaultdict(list)
    for r in docs.collect():
        sizes[r.source].append(len(words_of(r.text)))
        texts.add((r.doc_id, r.text))
    got, whole = Counter(), {s: sum(n) for s, n in sizes.items()}
    for r in out:
        assert (r.doc_id, r.text) in texts
        got[r.source] += len(words_of(r.text))
    for s, target in brute_targets(whole).items():
        # these sources have few documents, one of them much longer than the rest: by less than that one the mix may miss
        assert abs(target - got[s]) <= max(sizes[s])
    assert mixing.mix(docs.limit(0)).count() == 0


# ---- 8 ------------------------------------------------------------------------------------------------------
def test_line_dedup(spark):
    rows = [(i, f"menu\nbody {i}\n\n  \nmenu" + ("\nrare" if i < 4 else ""), "h1") for i in range(40)] + [(100 + i, f"menu\ntext {i}", "h2") for i in range(4)] + [(300, "alone\nhere", "h3")] + [(200, None, "h1"), (201, "", None), (202, "menu", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in lines.drop_boilerplate(df).collect()}
    assert len(got) == len(rows)
    assert got[0].text == "body 0\n\n  \nrare" and (got[0]["_n_lines"], got[0]["_n_dropped"]) == (4, 2)
    assert got[100].text == "text 0" and got[200].text is None and got[202].text == "menu" and got[300].text == "alone\nhere"
    assert {r.doc_id: r.text for r in lines.drop_boilerplate(df, min_pages=5).collect()}[100] == "menu\ntext 0"
    clash = df.withColumns({c: F.lit("x") for c in ("_n_lines", "_drop", "_site", "site", "lines", "_row")})
    assert [r.text for r in lines.drop_boilerplate(df, keep_first=True).collect()].count("menu\ntext 0") <= 1
    out = lines.drop_boilerplate(clash)
    assert {r.doc_id: (r.text, r["_n_lines"]) for r in out.collect()} == {i: (r.text, r["_n_lines"]) for i, r in got.items()}
    long = df.unionByName(spark.createDataFrame([(400, "menu\n" + "word " * 2_000_000 + "\n" + "line\n" * 200_000, "h1")], df.schema))
    assert next(r for r in lines.drop_boilerplate(long).where("doc_id = 400").collect())["_n_dropped"] == 1
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_visible_lines(spark):
    html = "<html><head><title>T</title><style>p{}</style><script>var x='<p>';</script></head><body><p>One <b>two</b></p><!-- no --><div>Three</div></body></html>"
    got = spark.createDataFrame([(html,)], "h string").select(lines.visible_lines(F.col("h")).alias("t")).first().t
    assert [x.strip() for x in got.split("\n") if x.strip()] == ["T", "One two", "Three"]


# ---- 9 ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("dim", [1, 7, 64])
def test_top_k(spark, dim, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 60)
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(dim)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(0, 0.3, (400, dim)), 1))]
    data += [(400 + i, data[50][1]) for i in range(30)] + [(50 * 20, None), (50 * 21, [float("nan")] * dim), (50 * 22, [None] * dim), (50 * 23, [0.5] * (dim + 1)), (None, [0.1] * dim)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = {}
    for r in maxscore.top_k(maxscore.whole_numbers(df), F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    fit = {i: [floor(256 * x) for x in v] for i, v in data[:430]}
    for q in (i for i in fit if i % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(fit[q], v)), i) for i, v in fit.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {i for i in fit if i % 50 == 0}
    assert maxscore.top_k(maxscore.whole_numbers(df.limit(0)), F.col("id") % 50 == 0).count() == 0


def test_top_k_of_large_components(spark):
    """Scores beyond 2^53 are whole numbers still; what doesn't fit raises."""
    big = 2.0**20
    data = [(0, [big, big, 1.0]), (1, [big, big, 3.0]), (2, [big, big, 2.0]), (3, [-big, big, 5.0]), (4, [])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = [(r.vec_id, r.score) for r in maxscore.top_k(maxscore.whole_numbers(df), F.col("id") == 0).orderBy("rank").collect()]
    value = lambda a, b: sum(int(x * 256) * int(y * 256) for x, y in zip(a, b))
    assert got == sorted(((i, value(data[0][1], v)) for i, v in data[1:4]), key=lambda p: (-p[1], p[0])) and got[0][1] > 2**53
    for x in (2.0**30, 2.0**46, 1e300):
        wild = spark.createDataFrame([(0, [x, x]), (1, [x, x])], "vec_id bigint, embedding array<double>")
        with pytest.raises(Exception, match="2\\^45|64 bits"):
            maxscore.top_k(maxscore.whole_numbers(wild), F.col("id") == 0).collect()


def test_top_k_sends_queries_as_rows(spark, monkeypatch):
    """Shards and queries meet in one shuffle of rows: a join's table of all pairs of shards and blocks was broadcast, beyond the driver's memory at 615,384 vectors."""
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 20)
    data = [(i, [float(i % 7), float(i % 11) - 5]) for i in range(300)]
    found = maxscore.top_k(spark.createDataFrame(data, "id bigint, v array<double>"), F.col("id") % 50 == 0)
    for r in found.where("rank = 1").collect():
        q = data[r.query_id][1]
        assert (-r.score, r.vec_id) == min((-sum(a * b for a, b in zip(q, v)), i) for i, v in data if i != r.query_id)
    assert found.count() == 6 * 5
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("kind", ["plain", "sparse", "copies", "positive", "repeated ids", "double", "whole"])
def test_shard_search(kind):
    """Blocks of queries get what brute force gets, over all steps of a shard."""
    rng = np.random.default_rng(len(kind))
    n, dim, k = 5000, 20, 5
    x = np.floor(rng.normal(0, {"double": 2.0**14, "whole": 2.0**24}.get(kind, 100.0), (n, dim)))
    ids = rng.permutation(n).astype(np.int64)
    if kind == "sparse":
        x[rng.random(x.shape) < 0.9] = 0
    elif kind == "copies":
        x[rng.integers(0, n, n)] = x[0]
    elif kind == "positive":
        x = np.abs(x)
    elif kind == "repeated ids":
        ids = rng.integers(0, n, n)
    some = rng.integers(0, n, 90)
    at, found, scores = maxscore.Shard(ids, x).search(x[some], ids[some], k)
    for j, i in enumerate(some):
        whole = x.astype(np.int64) @ x[i].astype(np.int64)
        best = [p for p in sorted(zip((-whole).tolist(), ids.tolist())) if p[1] != ids[i]][:k]
        assert sorted(zip((-scores[at == j]).tolist(), found[at == j].tolist())) == best
    one = maxscore.Shard(ids[:3], x[:3]).search(x[:1], ids[:1], k)
    assert len(one[0]) == len(set(ids[1:3]) - {ids[0]})


# ---- 10 -----------------------------------------------------------------------------------------------------
def brute_base(text):
    w = words_of(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    filled = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(filled) - len(set(filled)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality(docs, local):
    got = quality.score(docs).collect()
    key = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert sorted(map(key, got)) == sorted(brute_base(r.text) for r in local)
    assert not any(r.kept for r in got if r.base_failed)
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.score(docs.limit(0)).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("_row", "_text", "_lang", "kept_lang", "_w", "_all", "symbol_rate")}).withColumnRenamed("lang", "language")
    again = quality.filter_quality(clash, lang="language")
    assert again.columns == clash.columns and again.count() == kept.count()


def test_quality_groups_lean_on_their_language(spark):
    """A few odd rows are judged by their language, and the more of them a group has the more by themselves."""
    rng = np.random.default_rng(9)
    clean = [(i, " ".join(prose(rng, 60)), "en", "a") for i in range(300)]
    odd = lambda n: [(1000 + i, " ".join(w + "##" for w in prose(rng, 60)), "en", "b") for i in range(n)]
    for n, dropped in ((3, 3), (250, 0)):
        df = spark.createDataFrame(clean + odd(n), "doc_id bigint, text string, lang string, source string")
        assert [r.doc_id >= 1000 for r in quality.score(df).where("NOT kept").collect()] == [True] * dropped


def test_quality_verdict_keeps_with_length(spark):
    """A long text with a few symbols stays, and ten times the words at equal rates change no verdict."""
    rng = np.random.default_rng(19)
    marked = lambda n, every: " ".join(w + "%" * (i % every == 0) for i, w in enumerate(prose(rng, n, 10**6)))
    rows = [(i, " ".join(prose(rng, 80, 10**6)), "en", "a") for i in range(100)] + [(900 + i, marked(200, 2), "en", "a") for i in range(2)]
    cases = {2000: (12_006, 2001), 2001: (300, 100), 2002: (3000, 100), 2003: (150, 2), 2004: (1500, 2)}
    rows += [(k, marked(*v), "en", "a") for k, v in cases.items()]
    got = {r.doc_id: r.kept for r in quality.score(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert [got[k] for k in cases] == [True, True, True, False, False]
    assert all(v for k, v in got.items() if k < 900)


def test_quality_fences_come_from_the_sketches(spark, small):
    """No constant decides a fence: groups share one only with others of their language, from whose sketch it then comes. Rates of text without outliers have none."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source")
    limits = quality.thresholds(quality.sketch(materialize(quality.add_measures(docs), "measures"))).collect()
    for m in ("symbol_rate_high", "upper_rate_high", "word_length_high", "word_length_low"):
        langs = defaultdict(set)
        for r in limits:
            langs[r[m]].add(r.lang)
        assert None not in langs and len(langs) > len(limits) / 3
        assert sum(len(own) > 1 for own in langs.values()) < len(langs) / 10
    calm = spark.createDataFrame([(i, "a few plain words, as many as it takes to pass here. " * (1 + i % 3), "en", "a") for i in range(50)], "doc_id bigint, text string, lang string, source string")
    assert quality.thresholds(quality.sketch(quality.add_measures(calm))).first()["symbol_rate_high"] is None


def test_quality_fences_adapt(spark):
    rng = np.random.default_rng(2)
    clean = [(i, " ".join(prose(rng, 60)), "en", "a") for i in range(300)]
    noisy = [(1000 + i, " ".join(w + "#" for w in prose(rng, 60)), "en", "b") for i in range(300)]
    junk = [(5000, " ".join(w + "###" for w in prose(rng, 60)), "en", "a")]
    df = spark.createDataFrame(clean + noisy + junk, "doc_id bigint, text string, lang string, source string")
    dropped = [r.doc_id for r in quality.score(df).where("NOT kept").collect()]
    assert dropped == [5000]


def test_quality_fences_of_long_words(spark):
    """A group written without spaces has fences of its own, also where its word length lies far above 5000."""
    rng = np.random.default_rng(4)
    line = lambda n: "\n".join("".join(chr(0x4E00 + c) for c in rng.integers(0, 3000, n + int(rng.integers(0, 9)))) for _ in range(12))
    rows = [(i, line(80), "zh", "a") for i in range(250)] + [(1000 + i, line(400), "ja", "a") for i in range(250)] + [(5000, line(800), "zh", "a"), (5001, line(20), "ja", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert sorted(r.doc_id for r in quality.score(df).where("NOT kept").collect()) == [5000, 5001]
    values = [0, 1, 4999, 5000, 8191, 8192, 8193, 10**6, 2**38 - 1, 2**38]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v bigint").select(quality.bin_of("v").alias("b")).collect()]
    assert got[:6] == values[:6] and all(b <= v < b + max(1, b / 2**12 + 1) for v, b in zip(values, got))


def test_sketches_merge_in_any_order(spark, docs):
    m = materialize(quality.add_measures(docs), "measures")
    parts = quality.sketch(m.where("doc_id < 8")).union(quality.sketch(m.where("doc_id >= 8 OR doc_id IS NULL")))
    a, b = quality.merge(parts, "lang"), quality.merge(quality.sketch(m), "lang")
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
