"""The queries of this subpackage and their SQL: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import decontamination, mixing, neardup, pii, quality, secret_scan, sharding, substring_dedup, toxicity, url_filter
from quarrystone.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": lambda s, d: secret_scan.secrets(table(s, d, "documents")),
        "op2_sharding": lambda s, d: sharding.shard(table(s, d, "documents")),
        "op3_mixing": lambda s, d: mixing.mix(table(s, d, "documents")),
        "op4_pii": lambda s, d: pii.pseudonymized(table(s, d, "documents")),
        "op5_substring_dedup": lambda s, d: substring_dedup.removed(table(s, d, "documents")),
        "op6_decontamination": lambda s, d: decontamination.decontaminate(table(s, d, "documents"), table(s, d, "benchmark")),
        "op7_quality_rules": lambda s, d: quality.quality(table(s, d, "documents")),
        "op8_url_filter": lambda s, d: url_filter.filter_urls(table(s, d, "pages")),
        "op9_toxicity": lambda s, d: toxicity.toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op10_minhash_neardup": lambda s, d: neardup.near_duplicates(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sharding": sharding.SQL,
        "op3_mixing": mixing.SQL,
        "op5_substring_dedup": substring_dedup.SQL,
        "op6_decontamination": decontamination.SQL,
        "op8_url_filter": url_filter.SQL,
        "op10_minhash_neardup": neardup.SQL,
    }
