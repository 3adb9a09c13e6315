"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and tokenisation of ``documents``.

Each stage is one operator of ``paceledger.llm`` applied to all that the stage
before kept; ``run`` writes each stage's result as Parquet in the shared folder,
reads it for the next and deletes what the stage wrote on the way and the stage
before. The stages pass on the columns
of ``documents`` and no others.

Nulls, empties, ties: documents of less than ten words, null and empty texts
among them, fail the quality rules; null sources and languages are groups of
their own; null ids are kept; repeated rows are copies, of which the near-dedup
keeps one; an empty table stays empty; columns besides those of ``documents``,
clashing or not, are left out. Texts are processed whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceledger.llm import bpe, lines, mixing, neardup, quality
from paceledger.session import discard, materialize, scratch

PAGES = 5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their group's fences go."""
    return quality.filter_quality(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go from the texts; a source is a site here, and copies of a text count once.

    A line must be in PAGES texts at least, so that a pair of near copies in a small source is left to the next stage.
    One text keeps each line, so the body of a family of near copies stays whole in one of them.
    """
    out = lines.drop_boilerplate(docs.select(*COLUMNS), text="text", site="source", min_pages=PAGES, copies=False, keep_first=True)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.lit(0).cast("bigint"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words a shingle, similarity 0.8."""
    return neardup.dedup(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as their source's target says, and lie by shard, shuffled inside each."""
    out = mixing.sharded(mixing.mix(docs.select(*COLUMNS)))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn document, and digests of them and of the text decoded from them."""
    return bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: SQL can express neither the near-dedup's sketches, the seeded draws nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch() as keep:
            before, docs = docs, keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
