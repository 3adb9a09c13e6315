"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from paceledger.llm import bpe, chat, codes, langid, lines, maxscore, mixing, neardup, pii, quality, repair, substring, urls
from paceledger.session import ship_package


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_substring": substring.op1_substring,
        "op2_chat_format": chat.op2_chat_format,
        "op3_minhash": neardup.op3_minhash,
        "op4_language_id": langid.op4_language_id,
        "op5_bpe": bpe.op5_bpe,
        "op6_url_filter": urls.op6_url_filter,
        "op7_mixing": mixing.op7_mixing,
        "op8_line_dedup": lines.op8_line_dedup,
        "op9_maxscore": maxscore.op9_maxscore,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_conversation_repair": repair.op11_conversation_repair,
        "op12_vector_codes": codes.op12_vector_codes,
        "op13_personal_data": pii.op13_personal_data,
        "pipeline": corpus_pipeline.run,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat.OP2_SQL,
        "op6_url_filter": urls.OP6_SQL,
        "op8_line_dedup": lines.OP8_SQL,
        "op9_maxscore": maxscore.OP9_SQL,
        "op10_quality_rules": quality.OP10_SQL,
        "op11_conversation_repair": repair.OP11_SQL,
        "op12_vector_codes": codes.OP12_SQL,
    }
