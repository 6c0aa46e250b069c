"""Queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, licenses, lines, mixing, negatives, packing, pii, quality, sharding, simhash, tokens, urls, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_pii": pii.op2_pii,
        "op3_urls": urls.op3_urls,
        "op4_simhash": simhash.op4_simhash,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_quality": quality.op6_quality,
        "op7_mixing": mixing.op7_mixing,
        "op8_licenses": licenses.op8_licenses,
        "op9_packing": packing.op9_packing,
        "op10_lines": lines.op10_lines,
        "op11_negatives": negatives.op11_negatives,
        "op12_tokens": tokens.op12_tokens,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_urls": urls.SQL, "op8_licenses": licenses.SQL}
