"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Module of each query.
MODULES = {
    "op2_licence_scan": "licences",
    "op4_language_fusion": "language_id",
    "op9_suffix_array_pieces": "sentencepiece_codec",
    "op5_template_decontamination": "decontaminate",
    "op7_suffix_dedup": "repeats",
    "op8_jaccard_join": "jaccard_join",
    "op6_warc_zstandard": "warc",
    "op1_balanced_sharding": "sharding",
    "op3_perplexity_rules": "perplexity",
    "op10_quality_classifier": "quality",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"cleave.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """Each module may name its SQL in ``SQL``; those without are tested against brute force."""
    return {name: sql for name, module in MODULES.items() if (sql := getattr(importlib.import_module(f"cleave.llm.{module}"), "SQL", None))}
