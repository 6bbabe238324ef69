"""Queries of the numbered problems on training text, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.keyword_spam import keyword_spam
from granary.llm.leakage import leaked_items, without_leaks
from granary.llm.mixing import cube_mix, mix_report, sized_documents
from granary.llm.qa_defects import defective_pairs
from granary.llm.scan_noise import repaired_texts, scan_noise
from granary.plans.lineage import materialize
from granary.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "run_results", "result_id", "question", "answer", "expected")
    return defective_pairs(rows, "result_id", "question", "answer", "expected").select(F.col("row_id").alias("result_id"), "defect_type")


def _scans(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, key: table(spark, d, name).select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), F.col("paper_title").alias("paper"), "page", "section", F.col("chunk_text").alias("text"))
    return part("expanded_evidence", "ev_id").unionByName(part("retrieved_chunks", "rc_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise(_scans(spark, d), table(spark, d, "papers", "paper_title", "authors"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return repaired_texts(_scans(spark, d), table(spark, d, "papers", "paper_title", "authors"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark_items", "item_id", "gold_passage", "verified_answer")
    return leaked_items(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", items, "item_id", ["gold_passage", "verified_answer"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return without_leaks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", _leaks(spark, d))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return materialize(sized_documents(table(spark, d, "documents", "doc_id", "text", "source"), "doc_id", "text", "source"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return cube_mix(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mix_report(sized, targets, cube_mix(sized, targets))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return keyword_spam(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id").distinct()


def p9_reasons(spark: SparkSession, d: str) -> DataFrame:
    return keyword_spam(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {
    "p1_found": (p1_found, None),
    "p6_found": (p6_found, None),
    "p6_repaired": (p6_repaired, None),
    "p7_found": (p7_found, None),
    "p7_cleaned": (p7_cleaned, None),
    "p8_mix": (p8_mix, None),
    "p8_report": (p8_report, None),
    "p9_found": (p9_found, None),
    "p9_reasons": (p9_reasons, None),
}
