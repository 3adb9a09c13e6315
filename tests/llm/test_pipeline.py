"""The pipeline's stages and queries on the small tables, and the queries with SQL against DuckDB."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paceledger.llm import registry
from paceledger.session import materialize
from tests.llm.test_operators import brute_components, sha, words_of
from tests.test_queries import normal


@pytest.fixture(scope="module")
def oracle(tiny):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, tiny, oracle, name):
    got = registry.queries()[name](spark, tiny).toPandas()
    want = oracle.execute(registry.oracle_sql()[name]).df()
    assert normal(got) == normal(want)


def test_stages(spark, tiny):
    """Each stage against a plain version of its decision on what the stage before kept."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tiny)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = (docs.collect(), out.collect())
        docs = spark.createDataFrame(seen[name][1], out.schema)
    before, after = seen["quality_rules"]
    assert {r.doc_id for r in after} < {r.doc_id for r in before} and all(len(words_of(r.text)) >= 10 for r in after)
    before, after = seen["line_dedup"]
    pages = Counter(r.source for r in before)
    held = Counter((r.source, x) for r in before for x in set(r.text.split("\n")) if words_of(x))
    drop = {k for k, n in held.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    assert {r.doc_id: r.text for r in after} == {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x) not in drop) for r in before}
    before, after = seen["near_dedup"]
    assert sorted(r.doc_id for r in after) == sorted(i for i, v in brute_components([(r.doc_id, r.text) for r in before], 5).items() if v[2])
    before, after = seen["mix_sources"]
    words = lambda rows: sum(len(words_of(r.text)) for r in rows)
    # sources of a few documents each, taken whole
    assert abs(words(after) - words(before)) <= words(before) / 25
    whole = {(r.doc_id, r.text) for r in before}
    assert all((r.doc_id, r.text) in whole for r in after)
    from tokenizers import Tokenizer

    from paceledger.llm import bpe

    tokenizer = Tokenizer.from_file(bpe.tokenizer_path(bpe.TOKENIZER))
    coded = {}
    for r in after:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        coded[(r.doc_id, sha(np.asarray(ids, "<u4").tobytes()))] = (len(ids), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tiny).collect()
    assert len(last) == len(after) and all(coded[(r.doc_id, r.ids_sha256)] == (r.n_tokens, r.decoded_sha256) for r in last)


def test_run(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.count() > 0 and out.where(F.col("n_tokens") <= 0).count() == 0


def test_stages_on_odd_documents(spark, tiny):
    """Null and empty texts, null ids and groups, a very long text, repeated rows and clashing columns go through; an empty table stays empty."""
    rng = np.random.default_rng(12)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 5000, n))
    texts = [None, "", " \n ", prose(30), prose(30), "\n".join(prose(12) for _ in range(6)), "\n".join(prose(5000) for _ in range(40))]
    rows = [(i, t, "en", None if i % 2 else "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", None, 1), (None, prose(40), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit("clash") for c in ("size", "draws", "kept", "_n", "n_words", "key", "layout")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, tiny), f"odd-{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) == {3, 4, 5, 6, None}
        if name == "near_dedup":
            assert len(ids) == 5
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tiny).where("n_tokens > 20").count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tiny).count() == 0


def test_copied_text_survives(spark, tiny):
    """A third of a source is one text: line dedup keeps its lines, and one copy comes out of the pipeline's stages."""
    body = lambda k: "\n".join(" ".join(f"{k}x{i}y{j}" for j in range(6)) for i in range(4))
    texts = [body("copied")] * 30 + ["a single line that is a document of its own with more than ten words in it"] * 30 + [f"menu of the site\n{body(i)}" for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.line_dedup(spark, docs, tiny)
    got = {r.doc_id: r.text for r in out.collect()}
    assert all(got[i] == texts[i] for i in range(60))
    # one text keeps the menu, for all
    assert sorted(got[60 + i] == body(i) for i in range(30)) == [False] + [True] * 29 and sum("menu of the site" in t for t in got.values()) == 1
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, out, tiny).collect()}
    assert left == {0, 30, *range(60, 90)}
    mixed = corpus_pipeline.mix_sources(spark, corpus_pipeline.near_dedup(spark, out, tiny), tiny)
    assert {0, 30} <= {r.doc_id for r in mixed.collect()}


def test_a_family_of_near_copies_keeps_its_body_once(spark, tiny):
    """Six near copies of twelve shared lines among 46 texts: the lines are above the ratio, and one text of the family keeps them all."""
    shared = [" ".join(f"line{i}w{j}" for j in range(8)) for i in range(12)]
    family = ["\n".join([*shared, f"member {k} only has these words"]) for k in range(6)]
    others = ["\n".join(" ".join(f"o{k}x{i}y{j}" for j in range(6)) for i in range(4)) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(family + others)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, tiny).collect()}
    whole = [i for i in range(6) if got[i] == family[i]]
    assert len(whole) == 1 and all(got[i] == f"member {i} only has these words" for i in range(6) if i not in whole)
    assert all(got[6 + k] == t for k, t in enumerate(others))


def test_language_query_covers_all(spark, tiny):
    out = registry.queries()["op4_language_id"](spark, tiny)
    assert out.count() == spark.read.parquet(f"{tiny}/documents.parquet").count()


def test_empty_digest():
    assert sha("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
