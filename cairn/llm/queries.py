"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op01_pii, op02_packing, op03_decontaminate, op04_quality, op05_url_rules, op06_warc, op07_lines, op08_minhash, op09_tokens, op10_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_skip_chain": op01_pii.query,
        "op2_packing_bin_slack": op02_packing.query,
        "op3_benchmark_decontamination": op03_decontaminate.query,
        "op4_quality_llr": op04_quality.query,
        "op5_url_rules": op05_url_rules.query,
        "op6_warc_records": op06_warc.query,
        "op7_line_dedup": op07_lines.query,
        "op8_minhash_near_duplicates": op08_minhash.query,
        "op9_token_blocks": op09_tokens.query,
        "op10_toxicity_crf": op10_toxicity.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_llr": op04_quality.oracle(), "op5_url_rules": op05_url_rules.ORACLE_SQL, "op6_warc_records": op06_warc.ORACLE_SQL}
