"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = {"op1_merge_dropout": "pieces", "op2_quality_llr": "quality", "op3_decontaminate": "decontaminate", "op4_wrapper_extract": "wrappers", "op5_license_automaton": "licences", "op6_pitman_yor": "pitman_yor", "op7_language_zstd": "language", "op8_simhash_bktree": "simhash", "op9_pii": "pii", "op10_warc": "warc", "op11_merkle_manifest": "merkle", "op12_jaccard_tiles": "jaccard", "op13_spelling_fm": "spelling"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"tallyrock.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in MODULES.items():
        sql = getattr(import_module(f"tallyrock.llm.{module}"), "ORACLES", {})
        out |= {k: v for k, v in sql.items() if k == name}
    return out
