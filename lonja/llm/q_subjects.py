"""Queries p10_: subject areas of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm.subjects import document_subjects
from lonja.session import table


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels")).select("doc_id", "subject_id")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """How many documents and characters of the corpus deal with each area."""
    docs = table(spark, d, "documents")
    per = document_subjects(docs, table(spark, d, "subject_labels")).join(docs.select("doc_id", "n_chars"), "doc_id")
    per = per.groupBy("subject_id").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))
    return table(spark, d, "subject_areas").select("subject_id", "subject").join(per, "subject_id", "left").na.fill(0)


QUERIES = {"p10_found": p10_found, "p10_composition": p10_composition}
ORACLE: dict[str, str] = {}
