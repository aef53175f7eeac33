"""Queries p3_: freely typed values mapped to their canonical list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm.canonical_values import ALIASES, ORDER, inexact_values, map_values, typed_rows
from lonja.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = typed_rows(table(spark, d, "listings"), table(spark, d, "boe_valores"))
    return inexact_values(rows, table(spark, d, "canonical_values"), ALIASES, ORDER)


def p3_value_map(spark: SparkSession, d: str) -> DataFrame:
    rows = typed_rows(table(spark, d, "listings"), table(spark, d, "boe_valores"))
    return map_values(rows, table(spark, d, "canonical_values"), ALIASES, ORDER).withColumn("score", F.round("score", 6))


QUERIES = {"p3_found": p3_found, "p3_value_map": p3_value_map}
ORACLE: dict[str, str] = {}
