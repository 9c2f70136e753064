"""A corpus pipeline: language, repeated lines, near-duplicates, benchmark passages, token ids.

Each stage takes ``(spark, docs, sf_dir)``; its rows are written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionloom.context import cut
from sessionloom.llm import contamination, fuzzy, language, lines, pieces
from sessionloom.llm.common import table

STAGES = [
    ("language", language.stage),
    ("line_dedup", lines.stage),
    ("near_dedup", fuzzy.stage),
    ("decontaminate", contamination.stage),
    ("encode", pieces.stage),
]

#: SQL has neither the fingerprints nor the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
