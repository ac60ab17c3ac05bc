"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import bpe, langid, mixing, quality, records, sharding, simhash, toolcalls, toxicity, vectors

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_tool_calls": toolcalls.op1_tool_calls,
        "op2_mixing": mixing.op2_mixing,
        "op3_line_cleaning": quality.op3_line_cleaning,
        "op4_token_records": records.op4_token_records,
        "op5_simhash": simhash.op5_simhash,
        "op6_feistel_shards": sharding.op6_feistel_shards,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_hyperdimensional_language": langid.op8_hyperdimensional_language,
        "op9_bpe": bpe.op9_bpe,
        "op10_pca_tiles": vectors.op10_pca_tiles,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_tool_calls": toolcalls.ORACLE_SQL,
        "op2_mixing": mixing.ORACLE_SQL,
        "op3_line_cleaning": quality.ORACLE_SQL,
        "op6_feistel_shards": sharding.ORACLE_SQL,
        "op10_pca_tiles": vectors.ORACLE_SQL,
    }
