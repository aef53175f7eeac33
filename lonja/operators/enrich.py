"""Exact-key memory of a measured value: learn from the whole batch, then fill what is missing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.keys import co2_memory_key, fuel_category


def observed(df: DataFrame) -> DataFrame:
    """key, at, co2 of the listings that state a value themselves; values typed by users are not learned."""
    d = df.withColumn("key", co2_memory_key(df)).where(F.col("key").isNotNull() & F.col("co2_emissions_g_km").isNotNull() & ~F.col("source").isin("manual", "user", "public"))
    return d.select("key", "row_id", F.col("co2_emissions_g_km").alias("co2"))


def memory_mean(df: DataFrame) -> DataFrame:
    """key, samples, least, greatest and mean value: an order-free aggregate with partial combine."""
    return observed(df).groupBy("key").agg(F.count("*").alias("samples"), F.min("co2").alias("co2_min"), F.max("co2").alias("co2_max"), (F.sum(F.col("co2").cast("bigint")) / F.count("*")).alias("co2_avg"))


def memory_fold(df: DataFrame) -> DataFrame:
    """The same with the mean rounded to two places at every step, in row order, as a stepwise update leaves it. Each step
    needs the one before, so keys stream through sorted partitions; a task holds the figures of one key, never its rows."""
    ordered = observed(df).repartition(F.col("key")).sortWithinPartitions("key", "row_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        for pdf in batches:
            out = []
            for key, value in zip(pdf["key"], pdf["co2"]):
                if now is None or now[0] != key:
                    if now is not None:
                        out.append(now)
                    now = (key, 1, value, value, float(value))
                else:
                    _, n, least, most, mean = now
                    now = (key, n + 1, min(least, value), max(most, value), round((mean * n + value) / (n + 1), 2))
            yield pd.DataFrame(out, columns=["key", "samples", "co2_min", "co2_max", "co2_avg"])
        if now is not None:
            yield pd.DataFrame([now], columns=["key", "samples", "co2_min", "co2_max", "co2_avg"])

    return ordered.mapInPandas(run, "key string, samples long, co2_min int, co2_max int, co2_avg double")


def enrich_co2(df: DataFrame, memory: DataFrame, doubtful: Column | None = None) -> DataFrame:
    """row_id, value, source and confidence: stated, zero for electric, from the memory (memory_fold leaves what a stepwise
    update does, memory_mean the plain mean), or missing. A stated value where `doubtful` holds counts half."""
    d = df.withColumn("key", co2_memory_key(df)).join(memory.select(F.col("key").alias("m_key"), "co2_avg"), F.col("key") == F.col("m_key"), "left")
    stated, electric, known = F.col("co2_emissions_g_km").isNotNull(), fuel_category(F.col("fuel_type")) == "electric", F.col("co2_avg").isNotNull()
    return d.select(
        "row_id", F.when(stated, F.col("co2_emissions_g_km")).when(electric, 0).when(known, F.bround("co2_avg").cast("int")).alias("co2_g_km"),
        F.when(stated, "listing").when(electric, "electric_zero").when(known, "memory").otherwise("missing").alias("co2_source"),
        F.when(stated & F.coalesce(doubtful, F.lit(False)) if doubtful is not None else F.lit(False), 0.5).when(stated | electric, 1.0).when(known, 0.9).otherwise(0.0).alias("co2_confidence"),
    )
