"""Queries p4_: consistent form of titles and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lonja.llm.canon_text import changed_fields, consistent_fields
from lonja.session import table

FIELDS = ["title", "model"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return changed_fields(table(spark, d, "listings"), FIELDS)


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return consistent_fields(table(spark, d, "listings"), FIELDS)


QUERIES = {"p4_found": p4_found, "p4_forms": p4_forms}
ORACLE: dict[str, str] = {}
