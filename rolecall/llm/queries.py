"""The queries of this folder, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolecall.llm import decontaminate, filter_audit, fingerprint, line_hash, line_join, near_dup, packing, prefix_trie, privacy, quality, toxicity, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_line_join": line_join.op4_line_join,
        "op5_fingerprint": fingerprint.op5_fingerprint,
        "op6_quality": quality.op6_quality,
        "op7_line_hash": line_hash.op7_line_hash,
        "op8_near_dup": near_dup.op8_near_dup,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_privacy": privacy.op10_privacy,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_warc": warc.op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.OP2_SQL, "op7_line_hash": line_hash.OP7_SQL, "op8_near_dup": near_dup.OP8_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL, "op13_warc": warc.OP13_SQL,
    }
