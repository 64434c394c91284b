"""The corpus queries by name, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import bpe, centroids, decontaminate, licenses, linededup, neardup, quality, suffixdedup, tokencounts, topk, turnrepair, urlfilter, warc

_QUERIES = {
    "op1_suffix_dedup": suffixdedup.op1_suffix_dedup,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_url_filter": urlfilter.op3_url_filter,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_quality": quality.op5_quality,
    "op6_minhash_near_dedup": neardup.op6_minhash_near_dedup,
    "op7_warc": warc.op7_warc,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_exact_top_k": topk.op9_exact_top_k,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_token_counts": tokencounts.op11_token_counts,
    "op12_delta_lloyd": centroids.op12_delta_lloyd,
    "op13_turn_repair": turnrepair.op13_turn_repair,
}
_SQL = {
    "op3_url_filter": urlfilter.ORACLE,
    "op7_warc": warc.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op9_exact_top_k": topk.ORACLE,
    "op10_license_scan": licenses.ORACLE,
    "op12_delta_lloyd": centroids.ORACLE,
    "op13_turn_repair": turnrepair.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
