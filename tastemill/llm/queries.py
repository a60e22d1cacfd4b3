"""The registered ``opN_<name>`` queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tastemill.llm import align, ann, decontaminate, lang_id, line_dedup, merkle, near_dedup, pii, quality, sentencepiece_scan, sharding, token_files, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": near_dedup.op1_near_duplicates,
    "op2_lines": line_dedup.op2_lines,
    "op3_language": lang_id.op3_language,
    "op4_sentencepiece": sentencepiece_scan.op4_sentencepiece,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_urls": url_filter.op6_urls,
    "op7_nearest": ann.op7_nearest,
    "op8_shards": sharding.op8_shards,
    "op9_pii": pii.op9_pii,
    "op10_quality": quality.op10_quality,
    "op11_merkle": merkle.op11_merkle,
    "op12_token_files": token_files.op12_token_files,
    "op13_align": align.op13_align,
}

SQL: dict[str, str] = {
    "op1_near_duplicates": near_dedup.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op7_nearest": ann.SQL,
    "op11_merkle": merkle.SQL,
}
