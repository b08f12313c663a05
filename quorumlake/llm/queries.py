"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html_extract, language, mixing, near_dedup, packing, passages, quality, repeats, sharding, token_store, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": token_store.op1_token_store,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_packing": packing.op4_packing,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_mixing": mixing.op6_mixing,
    "op7_language": language.op7_language,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_html_extraction": html_extract.op9_html_extraction,
    "op10_substring_dedup": passages.op10_substring_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_periodic_runs": repeats.op12_periodic_runs,
    "op13_url_filter": url_filter.op13_url_filter,
}

ORACLES: dict[str, str] = {
    "op6_mixing": mixing.ORACLE,
    "op13_url_filter": url_filter.ORACLE,
}
