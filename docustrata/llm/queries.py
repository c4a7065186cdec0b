"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docustrata.llm import fingerprints, language, licenses, mixing, neardup, packing, secrets, tokens, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_neardup": neardup.op1_neardup,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_language": language.op3_language,
        "op4_packing": packing.op4_packing,
        "op5_tokens": tokens.op5_tokens,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_secrets": secrets.op7_secrets,
        "op8_licenses": licenses.op8_licenses,
        "op9_mixing": mixing.op9_mixing,
        "op10_topk": topk.op10_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_secrets": secrets.op7_sql(),
        "op8_licenses": licenses.op8_sql(),
        "op10_topk": topk.op10_sql(),
    }
