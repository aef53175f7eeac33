"""Identity keys of listings as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.text import normalize_body, normalize_text

# Words of each fuel category in normalised text, in the order in which they decide.
FUEL_TOKENS = {
    "phev": ["phev"], "lpg": ["lpg", "glp", "autogas", "flussiggas"], "cng": ["cng", "gnc", "erdgas", "methan", "metano"],
    "hydrogen": ["hydrogen", "hydrogenium", "hidrogeno", "wasserstoff"], "ethanol": ["ethanol", "etanol", "flexifuel"],
}
PLUG_TOKENS = ["enchufable", "plugin", "plug"]
GASOLINE_TOKENS = ["gasolina", "gasoline", "benzin", "petrol"]
ELECTRIC_TOKENS = ["electrico", "elektrisch", "electric", "electricity", "strom"]
# Engine families as written in normalised text, in the order in which they decide.
ENGINE_FAMILIES = [
    ("pure_?tech", "puretech"), ("blue_?hdi", "bluehdi"), ("e_?tsi", "etsi"), ("e_?hybrid", "ehybrid"), ("tfsi", "tfsi"), ("tsi", "tsi"),
    ("thp", "thp"), ("hdi", "hdi"), ("tce", "tce"), ("dci", "dci"), ("cdi", "cdi"), ("crdi", "crdi"), ("cdti", "cdti"), ("multijet", "multijet"),
    ("jtd", "jtd"), ("ecoboost", "ecoboost"), ("skyactiv", "skyactiv"), ("d_?4d", "d4d"),
]
# Words and phrases of each body category, in the order in which they decide.
BODY_WORDS = {
    "suv": ["suv", "offroad", "todoterreno", "gelandewagen"],
    "monovolumen": ["monovolumen", "minivan", "multi purpose", "van"],
    "deportivo_gama_alta": ["deportivo", "sports car", "sportscar", "sportwagen", "coupe", "cabrio", "roadster"],
    "familiar": ["familiar", "estate", "estatecar", "station wagon", "kombi"],
    "turismo": ["turismo", "berlina", "sedan", "saloon", "limousine", "hatchback", "compact", "small car", "smallcar"],
}
# Names of the gearbox kinds in normalised text.
TRANSMISSIONS = {"automatic": ["automatic", "automatico", "automatik"], "manual": ["manual", "cambio_manual", "schaltgetriebe"], "semi_automatic": ["semi_automatic", "semiautomatico"]}
HP_PER_KW = 1.35962


def _lits(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def fuel_category(c: Column) -> Column:
    """One fuel category of a free label; `na` where there is none, `other` where no word decides."""
    n = normalize_text(c)
    has = lambda words: n.rlike("(?:^|_)(?:" + "|".join(words) + ")(?:_|$)")
    hybrid = has(["hybrid", "hibrido"]) | n.contains("mild_hybrid")
    plug = has(PLUG_TOKENS) | n.contains("plug_in")
    out = F.when(n == "na", n).when(has(FUEL_TOKENS["phev"]), F.lit("phev")).when(has(FUEL_TOKENS["lpg"]), F.lit("lpg"))
    out = out.when(has(FUEL_TOKENS["cng"]) | n.contains("gas_natural"), F.lit("cng")).when(has(FUEL_TOKENS["hydrogen"]), F.lit("hydrogen"))
    out = out.when(has(FUEL_TOKENS["ethanol"]) | n.contains("flex_fuel"), F.lit("ethanol")).when(hybrid & plug, F.lit("phev")).when(hybrid, F.lit("hybrid"))
    out = out.when((n == "di_esel") | n.contains("diesel"), F.lit("diesel")).when(has(GASOLINE_TOKENS), F.lit("gasoline")).when(has(ELECTRIC_TOKENS), F.lit("electric"))
    return out.otherwise(F.lit("other"))


def model_key(c: Column) -> Column:
    """The first word of a model; two where the first is a series word or one character."""
    return F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(normalize_text(c), "(?:^|_)na(?=_|$)", ""), "^_?((?:clase|serie|[a-z0-9])_[a-z0-9]+|[a-z0-9]+)", 1), F.lit("")), F.lit("na"))


def joined_text(version: Column, title: Column, model: Column) -> Column:
    part = lambda c: F.nullif(c, F.lit(""))
    return normalize_text(F.concat_ws(" ", part(version), part(title), part(model)))


# The forms of an engine variant in normalised text, in the order in which they decide: figure and letters at a
# word's end; a figure parted from its letter, or a letter parted from its figure; a word of a figure with single letters.
_JOINED = r"(\d{2,3}[a-z]{1,2})(?=_|$)"
_PARTED = r"(?:^|_)(\d+(?=_[dei](?:_|$))|[a-z0-9](?=_\d+(?:_|$)))_([a-z0-9]+)(?:_([dei])(?=_|$))?"
_WHOLE = r"(?:^|_)([a-z]?\d{2,3}[a-z]?)(?=_|$)"


def variant_key(text: Column) -> Column:
    """The engine variant in a normalised text; `na` where there is none. Three patterns, so it stays in generated code."""
    t = F.regexp_replace(text, r"(?:^|_)na(?=_|$)", "")
    find = lambda pattern, i: F.regexp_extract(t, pattern, i)
    parted = F.concat(find(_PARTED, 1), find(_PARTED, 2), F.when(find(_PARTED, 1).rlike("^.$") & find(_PARTED, 2).rlike(r"^\d"), find(_PARTED, 3)).otherwise(""))
    return F.coalesce(F.nullif(find(_JOINED, 1), F.lit("")), F.nullif(parted, F.lit("")), F.nullif(find(_WHOLE, 1), F.lit("")), F.lit("na"))


def engine_key(text: Column, variant: Column, fuel: Column, cc: Column) -> Column:
    """Engine family, with the displacement in hundreds before it where it is known; `na` where neither is found."""
    named = None
    for pattern, name in ENGINE_FAMILIES:
        hit = text.rlike(f"(?:^|_){pattern}(?:_|$)")
        named = F.when(hit, F.lit(name)) if named is None else named.when(hit, F.lit(name))
    some = text.rlike("(?:^|_)(?:" + "|".join(p for p, _ in ENGINE_FAMILIES) + ")(?:_|$)")  # few texts name a family at all
    family = F.when(fuel == "electric", F.lit("electric")).when(some, named)
    family = F.coalesce(family, F.nullif(variant, F.lit("na")))
    band = (F.bround(cc / 100.0) * 100).cast("int")
    return F.when(family.isNull(), F.lit("na")).when((F.coalesce(cc, F.lit(0)) != 0) & (fuel != "electric"), F.concat(band.cast("string"), F.lit(":"), family)).otherwise(family)


def with_engine(df: DataFrame) -> DataFrame:
    """Adds text_n, fuel, variant and engine, each a column of its own, so that Catalyst keeps the costly ones apart and
    none is computed again inside another."""
    df = df.withColumn("text_n", joined_text(F.col("version"), F.col("title"), F.col("model"))).withColumn("fuel", fuel_category(F.col("fuel_type")))
    df = df.withColumn("variant", variant_key(F.col("text_n")))
    return df.withColumn("engine", engine_key(F.col("text_n"), F.col("variant"), F.col("fuel"), F.col("engine_displacement_cc")))


def transmission_kind(c: Column, source_says: Column | None = None) -> Column:
    """The gearbox kind of a label; where it names none, that of what the source says beside it."""
    n = normalize_text(c)
    out = F.lit(None).cast("string")
    for kind, words in TRANSMISSIONS.items():
        out = F.when(n.isin(*words), F.lit(kind)).otherwise(out)
    return out if source_says is None else F.coalesce(out, transmission_kind(source_says))


def power_hp(hp: Column, kw: Column) -> Column:
    return F.coalesce(hp.cast("int"), F.bround(kw * HP_PER_KW).cast("int"))


def body_category(c: Column) -> Column:
    body = normalize_body(c)
    words = F.split(body, " ")
    out = None
    for name, pats in BODY_WORDS.items():
        hit = F.arrays_overlap(words, _lits([p for p in pats if " " not in p]))
        for p in pats:
            if " " in p:
                hit = hit | body.contains(p)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def effective_year(df: DataFrame) -> Column:
    return F.coalesce(F.col("first_registration.year"), F.col("production_year")) if "production_year" in df.columns else F.col("first_registration.year")


def vehicle_signature(df: DataFrame) -> Column:
    """Nine parts joined by a bar, a missing one as `na`; over a frame from with_engine()."""
    num = lambda c: F.coalesce(c.cast("string"), F.lit("na"))
    battery = F.col("battery_capacity_kwh") if "battery_capacity_kwh" in df.columns else F.lit(None)
    return F.concat_ws("|", normalize_text(F.col("make")), model_key(F.col("model")), F.col("variant"), num(effective_year(df)), F.col("fuel"),
                       num(F.col("power_hp")), num(F.col("engine_displacement_cc")), num(battery), normalize_text(F.col("transmission")))


def co2_memory_key(df: DataFrame) -> Column:
    """make | model | version | year; null where one is missing or empty."""
    year = effective_year(df)
    full = year.isNotNull()
    for c in ("make", "model", "version"):
        full = full & (F.coalesce(F.col(c), F.lit("")) != "")
    return F.when(full, F.concat_ws("|", *[normalize_text(F.col(c)) for c in ("make", "model", "version")], year.cast("string")))


def market_key(make: Column, model: Column, fuel: Column) -> Column:
    """Make, model family and fuel category (already a category) joined by a bar."""
    return F.concat_ws("|", normalize_text(make), model_key(model), fuel)
