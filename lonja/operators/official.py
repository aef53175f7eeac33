"""Official value lookup: equi and tolerance join, a funnel of filters, ranking by text likeness."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.functions.text import normalize_official

POWER_TOLERANCE_KW = 2.0
SPREAD_HIGH = 0.05
# Fuel labels in normalised upper case and the code each stands for.
FUEL_CODES = {
    "G": "G", "GASOLINA": "G", "GASOLINE": "G", "PETROL": "G",
    "D": "D", "DIESEL": "D",
    "E": "ELC", "ELC": "ELC", "ELECTRICO": "ELC", "ELECTRIC": "ELC",
    "HYBRID": "HYBRID", "HIBRIDO": "HYBRID", "HYBRID GASOLINE": "HYBRID", "HYBRID DIESEL": "HYBRID", "GYE": "HYBRID", "DYE": "HYBRID", "SYE": "HYBRID",
    "PHEV": "PHEV",
    "S": "GAS", "GLP": "GAS", "LPG": "GAS", "GNC": "GAS", "CNG": "GAS",
    "H": "H", "HYDROGEN": "H", "HIDROGENO": "H",
    "M": "FLEX_FUEL", "ETHANOL": "FLEX_FUEL", "ETANOL": "FLEX_FUEL",
}
# Words of an automatic gearbox in official names.
AUTOMATIC_WORDS = ["aut", "automatic", "automatico", "cvt", "dct", "dsg", "eat6", "eat8", "edc", "etg5", "etg6", "multitronic", "powershift", "steptronic", "tiptronic"]
# Words of a hybrid in a model's name; beside them the phrase "mild hybrid".
HYBRID_WORDS = ["hybrid", "hibrido", "hev", "mhev", "etsi"]
# Brands that the official table writes in another way.
BRAND_ALIASES = {"VW": "VOLKSWAGEN", "MERCEDES BENZ": "MERCEDES"}


def fuel_family(c: Column, more: dict[str, str] | None = None) -> Column:
    """Code of a fuel label, or the label itself in normalised upper case; `more` adds labels to FUEL_CODES."""
    n = F.upper(normalize_official(c))
    codes = FUEL_CODES | (more or {})
    known = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.when(n != "", F.coalesce(F.try_element_at(known, n), n))


def query_fuel(code: Column, query: Column, more: dict[str, str] | None = None) -> Column:
    """A petrol or diesel label gives way to an explicit hybrid word in the model text."""
    family = fuel_family(code, more)
    hybrid = F.arrays_overlap(F.split(query, " "), F.array(*map(F.lit, HYBRID_WORDS))) | query.contains("mild hybrid")
    return F.when(family.isin("G", "D") & hybrid, F.lit("HYBRID")).otherwise(family)


def model_head(n: Column) -> Column:
    """The word that names the model: the second where the first is `e`; the digits of a figure with one letter."""
    tk = F.split(n, " ")
    return F.when((tk[0] == "e") & (F.size(tk) > 1), F.try_element_at(tk, F.lit(2))).when(tk[0].rlike(r"^\d+[a-z]$"), F.regexp_extract(tk[0], r"^(\d+)", 1)).otherwise(tk[0])


def official_gearbox(n: Column) -> Column:
    """Automatic where a word says so; all else is manual, for official names mark automatic variants only."""
    tk = F.split(n, " ")
    auto = F.arrays_overlap(tk, F.array(*map(F.lit, AUTOMATIC_WORDS))) | F.exists(tk, lambda x: x.rlike(r"^[5-9]g(tronic)?$"))
    return F.when(auto, F.lit("automatic")).otherwise(F.lit("manual"))


def declared_gearbox(c: Column) -> Column:
    """Automatic or manual as a label or a text declares it; null where it does not."""
    n = normalize_official(c)
    tk = F.split(n, " ")
    auto = n.isin("automatic", "automatico", "semi automatic", "semiautomatico") | F.arrays_overlap(tk, F.array(*map(F.lit, [*AUTOMATIC_WORDS, "automatik"])))
    return F.when(auto, F.lit("automatic")).when(F.arrays_overlap(tk, F.array(F.lit("manual"), F.lit("schaltgetriebe"))), F.lit("manual"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness by longest common blocks; not an edit distance, and the order of the two texts matters."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def token_likeness(query: Column, candidate: Column, ratio: Column | None = None) -> Column:
    """1.5 for equal texts; else .45 ratio + .40 recall + .15 precision, + .15 for a prefix or .10 for a part."""
    q, c = F.array_distinct(F.split(query, " ")), F.array_distinct(F.split(candidate, " "))
    overlap = F.size(F.array_intersect(q, c))
    score = F.lit(0.40) * overlap / F.size(q) + F.lit(0.15) * overlap / F.size(c)
    score = score + (F.lit(0.45) * ratio if ratio is not None else F.lit(0.0))
    bonus = F.when(F.startswith(candidate, query), 0.15).when(candidate.contains(query), 0.10).otherwise(0.0)
    return F.when(query == candidate, F.lit(1.5)).otherwise(score + bonus)


def latest_official(values: DataFrame, versions: DataFrame) -> DataFrame:
    """Official rows of the latest exercise, with their version's order and exercise."""
    v = versions.select(F.col("id").alias("version_id"), "order_code", "exercise")
    latest = v.agg(F.max("exercise").alias("latest"))
    return values.join(v, F.col("dataset_id") == F.col("version_id")).join(latest, F.col("exercise") == F.col("latest")).drop("version_id", "latest")


def base_candidates(vehicles: DataFrame, official: DataFrame, more_fuels: dict[str, str] | None = None, category: str | None = None) -> DataFrame:
    """Every vehicle with the official rows of its brand and model word, in any period (equi-join on both).

    A brand before the model's name is left out. Optional columns of the vehicles: `transmission`, a declared gearbox
    (else the model text is read for one), `cylinders`, and `chosen_id`, the official row chosen by hand. Nulls in brand or
    model give no candidate."""
    col = lambda c, kind: F.col(c).cast(kind) if c in vehicles.columns else F.lit(None).cast(kind)
    brand = F.upper(normalize_official(F.col("marca")))
    aliases = F.create_map(*[F.lit(x) for kv in BRAND_ALIASES.items() for x in kv])
    own, text = normalize_official(F.col("marca")), normalize_official(F.col("modelo"))
    q = F.when((own != "") & F.startswith(text, F.concat(own, F.lit(" "))), F.substring(text, F.length(own) + 2, F.length(text))).otherwise(text)
    gearbox = F.coalesce(declared_gearbox(col("transmission", "string")), declared_gearbox(F.col("modelo")))
    v = vehicles.select("vehiculo_id", F.coalesce(F.try_element_at(aliases, brand), brand).alias("brand_n"), q.alias("query"), F.year("fecha_primera_matriculacion").alias("year"), F.col("cilindrada_cc").alias("cc"), F.col("potencia_kw").alias("kw"),
                        F.col("combustible").alias("label"), gearbox.alias("wanted"), col("cylinders", "int").alias("v_cylinders"), col("chosen_id", "long").alias("chosen_id"))
    v = v.withColumn("head", model_head(F.col("query"))).withColumn("fuel", query_fuel(F.col("label"), F.col("query"), more_fuels)).drop("label")
    o = official.where(F.col("category") == category) if category else official
    n = normalize_official(F.col("model_type"))
    o = o.select(F.col("id").alias("boe_id"), F.upper(normalize_official(F.col("brand"))).alias("o_brand"), n.alias("name"), "commercial_start", "commercial_end", "displacement_cc", "cylinders", fuel_family(F.col("fuel_code"), more_fuels).alias("o_fuel"), "power_kw", "value_eur", official_gearbox(n).alias("gearbox"))
    o = o.withColumn("o_head", model_head(F.col("name")))
    return v.join(o, (F.col("brand_n") == F.col("o_brand")) & (F.col("head") == F.col("o_head")) & (F.col("query") != "")).drop("o_brand", "o_head")


def in_period() -> Column:
    return (F.coalesce(F.col("commercial_start"), F.lit(0)) <= F.col("year")) & (F.coalesce(F.col("commercial_end"), F.lit(9999)) >= F.col("year"))


def same_displacement() -> Column:
    none = F.col("fuel").isin("ELC", "H")
    return F.when(none, F.coalesce(F.col("displacement_cc"), F.lit(0)) == 0).otherwise(F.coalesce(F.col("displacement_cc") == F.col("cc"), F.lit(False)))


def same_fuel() -> Column:
    return F.coalesce(F.col("o_fuel") == F.col("fuel"), F.lit(False))


def same_power() -> Column:
    return F.coalesce(F.abs(F.col("power_kw") - F.col("kw")) <= POWER_TOLERANCE_KW, F.lit(False))


def technical_candidates(base: DataFrame) -> DataFrame:
    return base.where(in_period() & same_displacement() & same_fuel() & same_power())


def ranked_candidates(technical: DataFrame, with_ratio: bool = True) -> DataFrame:
    """The technical candidates with score, what fits and the pool: rows with the vehicle's cylinders if there are any, of
    these the rows that do not contradict its gearbox if there are any. The chosen row is the one chosen by hand, if it is
    a candidate, else the best of the pool by score, value and lowest id. The likeness runs after the technical filter, so
    it sees few pairs; all windows share one partitioning by vehicle."""
    q, w = F.col("query"), Window.partitionBy("vehiculo_id")
    t = technical.withColumn("score", F.round(token_likeness(q, F.col("name"), sequence_ratio(q, F.col("name")) if with_ratio else None), 4))
    t = t.withColumn("gearbox_fits", F.when(F.col("wanted").isNotNull() & ~F.col("o_fuel").isin("ELC", "H"), F.col("gearbox") == F.col("wanted"))).withColumn("cylinders_fit", F.col("cylinders") == F.col("v_cylinders"))
    fits, differs = F.coalesce("cylinders_fit", F.lit(False)), ~F.coalesce("gearbox_fits", F.lit(True))
    t = t.withColumn("any_cylinders", F.max(fits).over(w)).withColumn("pooled", fits | ~F.col("any_cylinders"))
    t = t.withColumn("any_gearbox", F.max(F.col("pooled") & ~differs).over(w)).withColumn("in_pool", F.col("pooled") & (~differs | ~F.col("any_gearbox")))
    order = w.orderBy(F.desc("by_hand"), F.desc("in_pool"), F.desc("score"), F.desc("value_eur"), "boe_id")
    t = t.withColumn("by_hand", F.coalesce(F.col("boe_id") == F.col("chosen_id"), F.lit(False)))
    t = t.withColumn("chosen", F.row_number().over(order) == 1).withColumn("manual", F.max("by_hand").over(w))
    value = F.when(F.col("in_pool"), F.col("value_eur"))
    t = t.withColumn("pool", F.count_if("in_pool").over(w)).withColumn("spread", (F.max(value).over(w) - F.min(value).over(w)) / F.min(value).over(w))
    t = t.withColumn("best_score", F.max(F.when(F.col("chosen"), F.col("score"))).over(w))
    return t.withColumn("tied", F.count_if(F.col("in_pool") & (F.col("score") == F.col("best_score"))).over(w) > 1)


def _label() -> Column:
    sure = (F.col("pool") == 1) | ((F.col("spread") <= SPREAD_HIGH) & F.col("any_gearbox"))
    return F.when(F.col("manual"), F.lit("manual")).when(sure, F.lit("high")).otherwise(F.lit("non_conclusive"))


def pick_official(technical: DataFrame, with_ratio: bool = True) -> DataFrame:
    """vehiculo_id, boe_id, score, pool size, spread of values in the pool, confidence label and whether its score is tied."""
    best = ranked_candidates(technical, with_ratio).where("chosen")
    return best.select("vehiculo_id", "boe_id", "score", "pool", F.bround(F.col("spread") * 100, 2).alias("spread_pct"), _label().alias("confidence"), "tied")


def candidate_trace(technical: DataFrame, with_ratio: bool = True) -> DataFrame:
    """vehiculo_id, boe_id, score, gearbox, chosen, decision: what became of every technical candidate, and why."""
    t = ranked_candidates(technical, with_ratio)
    differs = ~F.coalesce("gearbox_fits", F.lit(True))
    why = F.when(F.col("chosen") & F.col("manual"), "chosen_by_hand").when(F.col("chosen") & F.col("tied"), "tie_highest_value").when(F.col("chosen"), "best_likeness")
    why = why.when(differs, "gearbox_differs").when(F.col("any_cylinders") & ~F.coalesce("cylinders_fit", F.lit(False)), "cylinders_differ").when(F.col("score") == F.col("best_score"), "tie_lower_value").otherwise("lower_likeness")
    return t.select("vehiculo_id", "boe_id", "score", "gearbox", "chosen", why.alias("decision"))


def resolution_audit(vehicles: DataFrame, base: DataFrame, with_ratio: bool = True) -> DataFrame:
    """One row a vehicle: candidates after the base, technical and gearbox steps, the confidence label (`none` without a
    candidate), the spread, the facts that are missing and a warning."""
    rows = base.where(in_period())
    kept = base.where(in_period() & same_displacement() & same_fuel() & same_power())
    ranked = ranked_candidates(kept, with_ratio)
    tech = ranked.groupBy("vehiculo_id").agg(F.count("*").alias("technical"), F.count_if(F.col("pooled") & F.coalesce("gearbox_fits", F.lit(True))).alias("with_gearbox"), F.max(F.when(F.col("chosen"), F.struct(_label().alias("label"), F.bround(F.col("spread") * 100, 2).alias("spread_pct"), "any_gearbox"))).alias("r"))
    per = rows.groupBy("vehiculo_id").agg(F.count("*").alias("base"))
    q = normalize_official(F.col("modelo"))
    fuel = query_fuel(F.col("combustible"), q)
    gap = lambda name, cond: F.when(cond, F.lit(name))
    missing = F.array_join(F.array_compact(F.array(gap("displacement_cc", F.col("cilindrada_cc").isNull() & ~F.coalesce(fuel.isin("ELC", "H"), F.lit(False))), gap("power_kw", F.col("potencia_kw").isNull()), gap("fuel_code", fuel.isNull()))), ",")
    v = vehicles.select(F.col("vehiculo_id").alias("v_id"), missing.alias("missing"), (F.col("marca").isNull() | F.col("modelo").isNull()).alias("nameless"))
    j = v.join(per, F.col("v_id") == per.vehiculo_id, "left").drop("vehiculo_id").join(tech, F.col("v_id") == tech.vehiculo_id, "left").drop("vehiculo_id")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    warning = F.when(F.col("nameless"), "no_brand_or_model").when(F.col("missing") != "", "facts_missing").when(n("technical") == 0, "no_technical_row").when((F.col("r.label") == "non_conclusive") & ~F.col("r.any_gearbox"), "gearbox_conflict").when(F.col("r.label") == "non_conclusive", "values_differ")
    return j.select(F.col("v_id").alias("vehiculo_id"), n("base").alias("base"), n("technical").alias("technical"), n("with_gearbox").alias("with_gearbox"), F.coalesce("r.label", F.lit("none")).alias("confidence"), F.col("r.spread_pct").alias("spread_pct"), "missing", warning.alias("warning"))


def fallback_cause(vehicles: DataFrame, base: DataFrame) -> DataFrame:
    """vehiculo_id, cause: the first step of the funnel that leaves no official row; `resolved` where all steps leave one."""
    a, b, c, d = in_period(), same_displacement(), same_fuel(), same_power()
    per = base.groupBy("vehiculo_id").agg(F.max(a).alias("p"), F.max(a & b).alias("d"), F.max(a & b & c).alias("f"), F.max(a & b & c & d).alias("k"))
    j = vehicles.select("vehiculo_id", F.col("fecha_primera_matriculacion").isNull().alias("undated")).join(per.withColumnRenamed("vehiculo_id", "v"), F.col("vehiculo_id") == F.col("v"), "left")
    t = lambda x: F.coalesce(F.col(x), F.lit(False))
    cause = F.when(F.col("undated"), "no_date").when(F.col("v").isNull(), "model").when(~t("p"), "period").when(~t("d"), "displacement").when(~t("f"), "fuel").when(~t("k"), "power").otherwise("resolved")
    return j.select("vehiculo_id", cause.alias("cause"))
