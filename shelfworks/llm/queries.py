"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfworks.llm import collocations, decontaminate, license_scan, mixing, near_dups, phrase_automata, quality, suffix_dedup, token_counts, topk_search, toxicity, url_filter, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, over its whole table."""
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_near_dups": near_dups.op2_near_dups,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_topk_search": topk_search.op4_topk_search,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_quality": quality.op9_quality,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_collocations": collocations.op12_collocations,
        "op13_phrase_dedup": phrase_automata.op13_phrase_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can say the same."""
    return {
        "op3_url_filter": url_filter.ORACLE_SQL,
        "op4_topk_search": topk_search.ORACLE_SQL,
        "op5_license_scan": license_scan.ORACLE_SQL,
        "op11_vector_codes": vector_codes.ORACLE_SQL,
        "op12_collocations": collocations.ORACLE_SQL,
    }
