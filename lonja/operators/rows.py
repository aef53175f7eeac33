"""Row-level and keyed operators: export frame, keep-best, latest per key, semi and anti joins, erasure, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.keys import effective_year, fuel_category
from lonja.functions.text import normalize_text


def export_frame(df: DataFrame) -> DataFrame:
    """The flat export frame: nested fields as columns, the gross price under its export name."""
    flat = [F.col("first_registration.year").alias("first_registration_year"), F.col("first_registration.month").alias("first_registration_month")]
    rest = [F.col(c).alias("price_gross_eur") if c == "price_eur" else F.col(c) for c in df.columns if c != "first_registration"]
    return df.select(*rest, *flat)


def keep_best(df: DataFrame, key: list[Column], score: Column, tie: list[Column]) -> DataFrame:
    """The row with the largest score of each key, null being a key like any other; the least tie value wins a tie.

    An aggregate with partial combine before the shuffle, not a window: a hot key costs one row a task."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    order = F.struct(score.alias("s"), *[(-t).alias(f"t{i}") for i, t in enumerate(tie)])
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(*named, order.alias("_o"), row.alias("_r")).groupBy(*[f"_k{i}" for i in range(len(key))]).agg(F.max_by("_r", "_o").alias("_r")).select("_r.*")


def dedupe_listings(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Repeated cards of one vehicle: nine key fields, the most complete row wins, the first among equals."""
    battery = F.col("battery_capacity_kwh") if "battery_capacity_kwh" in df.columns else F.lit(None).cast("double")
    key = [normalize_text(F.col("make")), normalize_text(F.col("model")), effective_year(df), F.col("mileage_km"), F.round(F.when(~F.isnan("price_eur"), F.col("price_eur")) * 100).cast("bigint"), F.col("power_hp"), battery, fuel_category(F.col("fuel_type")), normalize_text(F.col("transmission"))]
    filled = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0)
    return keep_best(df, key, filled("version") + filled("engine_displacement_cc") + filled("transmission") + filled("seller_dealer_id"), [F.col(id_col)])


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`: what an upsert leaves of an append-only table."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in key]), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The base with the changed keys replaced and new keys added."""
    return base.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def with_flag(df: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """Adds whether the key occurs in the other frame (a semi join as a column)."""
    return df.join(other.select(F.col(key).alias("_k")).where("_k is not null").distinct().withColumn("_f", F.lit(True)), F.col(key) == F.col("_k"), "left").withColumn(flag, F.coalesce("_f", F.lit(False))).drop("_k", "_f")


def with_latest(df: DataFrame, other: DataFrame, key: str, order: str, take: list[str]) -> DataFrame:
    """Left join to the latest row of the other frame by key."""
    last = latest_per_key(other.select(key, order, *take), [key], [order])
    return df.join(last.select(F.col(key).alias("_k"), *take), F.col(key) == F.col("_k"), "left").drop("_k")


def unused(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in the other frame; a null key is unused."""
    return df.join(used.select(F.col(key).alias("_k")).where("_k is not null").distinct(), F.col(key) == F.col("_k"), "left_anti")


def erase(df: DataFrame, match: Column, columns: list[str]) -> DataFrame:
    """Personal columns set to null where the condition holds; rows and their figures stay."""
    hit = F.coalesce(match, F.lit(False))
    return df.select(*[F.when(~hit, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns], hit.alias("erased"))


def missing_fields(df: DataFrame) -> Column:
    """Names of the required fields a listing lacks, joined by commas; electric and hydrogen cars need no displacement, a
    new unregistered one no date."""
    fuel = fuel_category(F.col("fuel_type"))
    gap = lambda name, cond: F.when(cond, F.lit(name))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return F.array_join(F.array_compact(F.array(
        gap("make", empty("make")), gap("model", empty("model")), gap("price_eur", F.col("price_eur").isNull()),
        gap("first_registration", effective_year(df).isNull() & ~F.coalesce(F.col("unregistered_new"), F.lit(False))), gap("fuel_type", empty("fuel_type")),
        gap("engine_displacement_cc", F.col("engine_displacement_cc").isNull() & ~fuel.isin("electric", "hydrogen")), gap("power", F.col("power_kw").isNull() & F.col("power_hp").isNull()), gap("mileage_km", F.col("mileage_km").isNull()),
    )), ",")
