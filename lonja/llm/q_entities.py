"""Queries p6_: vehicles matched to official rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm.official_match import match_official
from lonja.session import table


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return match_official(table(spark, d, "vehiculos"), table(spark, d, "boe_valores"), table(spark, d, "canonical_values").where("list_name = 'make'"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("boe_id", "vehiculo_id")


def p6_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).withColumn("confidence", F.round("confidence", 4))


QUERIES = {"p6_found": p6_found, "p6_confidence": p6_confidence}
ORACLE: dict[str, str] = {}
