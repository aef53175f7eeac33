"""Comparable matching: bucket equi-join with range residuals, three quality levels, best-level market statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.keys import effective_year, model_key, power_hp, transmission_kind, with_engine
from lonja.functions.text import normalize_text

# Limits of the levels.
YEARS = {"exact": 1, "near": 2, "broad": 4}
KM = {"exact": 15_000, "near": 35_000, "broad": 60_000}
CC = {"exact": 150, "near": 300, "limit": 500}
HP = {"exact": 15, "near": 30, "limit": 60, "share": 0.25}
BATTERY_KWH = 5.0
RANK = {"exact": 1, "near": 2, "broad": 3}
BAND = 5  # years; targets look into the bands within YEARS["broad"]


#: What dedupe and keyed() read of a listing; a pool is cut down to these before its rows are carried through a shuffle.
COLUMNS = ["row_id", "source", "listing_id", "title", "make", "model", "version", "price_eur", "mileage_km", "first_registration", "production_year", "fuel_type", "transmission", "source_transmission", "power_hp", "power_kw", "engine_displacement_cc", "battery_capacity_kwh", "seller_dealer_id"]


def narrow(df: DataFrame) -> DataFrame:
    """The columns of COLUMNS that the frame has."""
    return df.select(*[c for c in COLUMNS if c in df.columns])


def keyed(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """The columns matching needs, one row a listing: identity keys, engine, year, mileage, gearbox, battery, price."""
    battery = F.col("battery_capacity_kwh") if "battery_capacity_kwh" in df.columns else F.lit(None).cast("double")
    beside = F.col("source_transmission") if "source_transmission" in df.columns else None
    k = with_engine(df)
    return k.select(
        F.col(id_col).alias("id"), "source", "listing_id", normalize_text(F.col("make")).alias("make_n"), model_key(F.col("model")).alias("model_k"), "fuel",
        F.col("engine_displacement_cc").alias("cc"), power_hp(F.col("power_hp"), F.col("power_kw")).alias("hp"), effective_year(df).alias("year"),
        F.col("mileage_km").alias("km"), transmission_kind(F.col("transmission"), beside).alias("tx"), battery.alias("kwh"), F.when(~F.isnan("price_eur"), F.col("price_eur")).alias("price"), "engine",
    )


def _delta(c: str) -> Column:
    return F.abs(F.col(f"t.{c}") - F.col(f"c.{c}"))


def _clash() -> Column:
    return (F.col("t.engine") != "na") & (F.col("c.engine") != "na") & (F.col("t.engine") != F.col("c.engine"))


def _hp_limit() -> Column:
    return F.greatest(F.lit(HP["limit"]), F.floor(F.coalesce(F.col("t.hp"), F.lit(0)) * HP["share"]))


def _within() -> Column:
    """Whether t and c, which share make, model family and fuel, match at some level; null where a year or mileage is."""
    beyond = (F.coalesce(_delta("cc"), F.lit(0)) > CC["limit"]) | (F.coalesce(_delta("hp"), F.lit(0)) > _hp_limit())
    return (_delta("year") <= YEARS["broad"]) & (_delta("km") <= KM["broad"]) & ~_clash() & ~beyond


def _same_engine() -> Column:
    return (F.col("t.engine") != "na") & (F.col("t.engine") == F.col("c.engine"))


def _same_tx() -> Column:
    return F.coalesce(F.col("t.tx") == F.col("c.tx"), F.lit(False))


def _level() -> Column:
    """The level of a pair that is _within()."""
    dy, dkm = _delta("year"), _delta("km")
    motor = lambda lv: _same_engine() & ((F.col("t.fuel") == "electric") | F.coalesce(_delta("cc") <= CC[lv], F.lit(False))) & F.coalesce(_delta("hp") <= HP[lv], F.lit(False))
    battery = ~F.col("t.fuel").isin("electric", "phev") | F.coalesce(_delta("kwh") <= BATTERY_KWH, F.lit(False))
    return (
        F.when(motor("exact") & (dy <= YEARS["exact"]) & (dkm <= KM["exact"]) & _same_tx() & battery, F.lit("exact"))
        .when(motor("near") & (dy <= YEARS["near"]) & (dkm <= KM["near"]) & battery, F.lit("near")).otherwise(F.lit("broad"))
    )


def comparable_pairs(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """target_id, candidate_id, level and the candidate's figures, for every pair of some level.

    Both sides are keyed() frames. The join is an equi-join on make, model family, fuel and a band of years: a target is
    sent to the bands its years reach, which also spreads a hot model over bands; limits on years, mileage, displacement
    and power stand in the join condition. Keys of `na` match nothing; null years or mileages match nothing.
    """
    known = lambda d: d.where((F.col("make_n") != "na") & (F.col("model_k") != "na") & (F.col("fuel") != "na") & F.col("year").isNotNull() & F.col("km").isNotNull())
    reach = YEARS["broad"]
    bands = F.sequence(F.floor((F.col("year") - reach) / BAND), F.floor((F.col("year") + reach) / BAND))
    t = known(targets).withColumn("band", F.explode(bands)).alias("t")
    c = known(candidates).withColumn("band", F.floor(F.col("year") / BAND)).alias("c")
    cond, level = _within(), _level()
    for k in ("make_n", "model_k", "fuel", "band"):
        cond = cond & (F.col(f"t.{k}") == F.col(f"c.{k}"))
    engine_check = F.when((level == "exact") | (level == "near"), F.lit("match")).when(_same_engine(), F.lit("relaxed")).otherwise(F.lit("unavailable"))
    tx_check = F.when(F.col("t.tx").isNull() | F.col("c.tx").isNull(), F.lit("unavailable")).when(_same_tx(), F.lit("match")).otherwise(F.when(level == "exact", F.lit("mismatch")).otherwise(F.lit("relaxed")))
    battery_check = F.when(~F.col("t.fuel").isin("electric", "phev") | _delta("kwh").isNull(), F.lit("unavailable")).when(_delta("kwh") <= BATTERY_KWH, F.lit("match")).otherwise(F.when(level == "broad", F.lit("relaxed")).otherwise(F.lit("mismatch")))
    checks = F.create_map(
        *[x for k in ("make", "model", "fuel") for x in (F.lit(k), F.lit("match"))], F.lit("version"), engine_check,
        F.lit("year"), F.when(level == "broad", F.lit("relaxed")).otherwise(F.lit("match")), F.lit("mileage"), F.lit("match"), F.lit("transmission"), tx_check, F.lit("battery"), battery_check,
    )
    return t.join(c, cond).select(
        F.col("t.id").alias("target_id"), F.col("c.id").alias("candidate_id"), level.alias("level"), F.col("c.price").alias("price"), F.col("c.source").alias("candidate_source"),
        _same_tx().alias("same_tx"), _delta("year").alias("year_delta"), _delta("km").alias("km_delta"), battery_check.isin("relaxed", "unavailable").alias("battery_open"), checks.alias("checks"),
    )


def pair_decisions(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """target_id, candidate_id, level, reason of every pair of one make, model family and fuel: the level of those that
    match, and of the others the first thing that keeps them apart. For audits; the pairs of a hot model are as many as its
    candidates a target, so targets should be few.

    Both are settled where the pair is made, so the listings are shuffled and not their pairs. Repeated ids are the
    exception: a pair of two ids takes the level of every match of these ids, for which their pairs are joined."""
    t, c = targets.where("make_n <> 'na' and model_k <> 'na' and fuel <> 'na'"), candidates
    twice_t, twice_c = _repeated(targets), _repeated(candidates)
    if twice_t is None and twice_c is None:
        return _decided(t, c).drop("apart")
    out = _decided(_among(t, twice_t, False), _among(c, twice_c, False)).drop("apart")
    for x, y in ((_among(t, twice_t, True), c), (_among(t, twice_t, False), _among(c, twice_c, True))):
        own = _decided(x, y)
        met = own.where("level is not null").select(F.col("target_id").alias("m_t"), F.col("candidate_id").alias("m_c"), F.col("level").alias("met"))
        j = own.join(met, (F.col("target_id") == F.col("m_t")) & (F.col("candidate_id") == F.col("m_c")), "left")
        out = out.unionByName(j.select("target_id", "candidate_id", F.col("met").alias("level"), F.when(F.col("met").isNull(), F.col("apart")).alias("reason")))
    return out


def _repeated(df: DataFrame) -> DataFrame | None:
    """The ids that occur more than once; none if there are no such ids."""
    ids = df.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    return None if ids.isEmpty() else ids


def _among(df: DataFrame, ids: DataFrame | None, those: bool) -> DataFrame:
    """The rows whose id is one of `ids`, or the others."""
    if ids is None:
        return df.limit(0) if those else df
    return df.join(ids, "id", "left_semi" if those else "left_anti")


def _decided(t: DataFrame, c: DataFrame) -> DataFrame:
    """target_id, candidate_id, level, reason, and apart, the reason whether the pair matches or not, from one join."""
    t, c = t.alias("t"), c.alias("c")
    far = lambda v, most: F.coalesce(v > most, F.lit(True))
    apart = F.when(far(_delta("year"), YEARS["broad"]), "year").when(far(_delta("km"), KM["broad"]), "mileage").when(_clash(), "engine").when(_delta("cc") > CC["limit"], "displacement").when(_delta("hp") > _hp_limit(), "power")
    j = t.join(c, (F.col("t.make_n") == F.col("c.make_n")) & (F.col("t.model_k") == F.col("c.model_k")) & (F.col("t.fuel") == F.col("c.fuel")))
    named = F.col("t.id").isNotNull() & F.col("c.id").isNotNull()  # a match is known by its ids
    j = j.select(F.col("t.id").alias("target_id"), F.col("c.id").alias("candidate_id"), F.when(named & _within(), _level()).alias("level"), apart.alias("apart"))
    return j.select("target_id", "candidate_id", "level", F.when(F.col("level").isNull(), F.col("apart")).alias("reason"), "apart")


def level_counts(pairs: DataFrame, priced_only: bool = True) -> DataFrame:
    """Number of comparables of each level by target."""
    p = pairs.where(F.col("price").isNotNull()) if priced_only else pairs
    return p.groupBy("target_id").agg(*[F.count_if(F.col("level") == lv).alias(f"{lv}_n") for lv in RANK])


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def source_label(sources: Column, first: tuple[str, ...] = ()) -> Column:
    """The sources joined by a plus: those of `first` in its order, then the others by letters."""
    own = F.array(*map(F.lit, first)).cast("array<string>")
    return F.array_join(F.concat(F.array_intersect(own, sources), F.array_sort(F.array_except(sources, own))), "+")


def market_statistics(pairs: DataFrame, price_first: bool = True, first_sources: tuple[str, ...] = ()) -> DataFrame:
    """target_id, level, n, average, median, least and greatest price of the best level that has comparables, confidence,
    sources, warnings. With `price_first` unpriced comparables are dropped before the level is chosen, else after, which
    may leave a target without figures. At level near, comparables with the same gearbox are used alone if there are any.
    """
    rank = F.when(F.col("level") == "exact", 1).when(F.col("level") == "near", 2).otherwise(3)
    p = pairs.select("target_id", "level", "price", "candidate_source", "same_tx", "battery_open")  # what the shuffle has to carry
    p = (p.where(F.col("price").isNotNull()) if price_first else p).withColumn("rank", rank)
    w = Window.partitionBy("target_id")
    p = p.withColumn("best", F.min("rank").over(w)).where(F.col("rank") == F.col("best"))
    p = p.where(F.col("price").isNotNull())
    p = p.withColumn("any_tx", F.max("same_tx").over(w)).withColumn("at_level", F.count("*").over(w))
    p = p.where((F.col("level") != "near") | ~F.col("any_tx") | F.col("same_tx"))
    s = p.groupBy("target_id", "level").agg(
        F.count("*").alias("n"), F.sum(cents(F.col("price"))).alias("sum_cents"), F.median("price").alias("median"), F.min("price").alias("least"), F.max("price").alias("greatest"),
        F.first("at_level").alias("at_level"), source_label(F.collect_set("candidate_source"), first_sources).alias("sources"),
        F.max("battery_open").alias("battery_open"),
    )
    confidence = F.when(F.col("level") == "exact", F.lit("high")).when(F.col("level") == "near", F.lit("medium")).otherwise(F.lit("low"))
    warnings = F.array_compact(F.array(
        F.when(F.col("level") == "broad", F.lit("broad_only")), F.when((F.col("level") == "broad") & F.col("battery_open"), F.lit("battery_open")),
        F.when((F.col("level") == "near") & (F.col("n") < F.col("at_level")), F.lit("same_gearbox_preferred")), F.when(F.col("n") < 3, F.lit("small_sample")),
    ))
    return s.select("target_id", "level", "n", (F.col("sum_cents") / 100.0 / F.col("n")).alias("average"), "median", "least", "greatest", confidence.alias("confidence"), "sources", F.array_join(warnings, ",").alias("warnings"))


def search_envelope(df: DataFrame) -> DataFrame:
    """Bounds within which a target's comparables are looked for: years, mileage, power, fuel where it is a known one."""
    span = F.greatest(F.lit(HP["limit"]), F.bround(F.col("hp") * HP["share"]).cast("int"))
    return df.select(
        "id", (F.col("year") - YEARS["broad"]).alias("min_year"), (F.col("year") + YEARS["broad"]).alias("max_year"), F.greatest(F.lit(0), F.col("km") - KM["broad"]).alias("min_km"), (F.col("km") + KM["broad"]).alias("max_km"),
        F.greatest(F.lit(0), F.col("hp") - span).alias("min_hp"), (F.col("hp") + span).alias("max_hp"), F.when(~F.col("fuel").isin("phev", "other", "na"), F.col("fuel")).alias("fuel"),
    )
