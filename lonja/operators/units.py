"""Quantities recorded in different units: parse figures and units, weigh them against each other, convert to canonical units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.text import fold_wide, normalize_text
from lonja.functions.units import CANONICAL, COUNTRY_MONEY, Unit, code_unit, convert, convert_by_code, first_power, first_price, literal_map, parse_unit, price_units
from lonja.session import materialise

POWER_TOLERANCE = 0.02
PRICE_TOLERANCE = 0.004
MAX_KW = 1500.0


MOST_UNITS = 1_000


def unit_codes(units: DataFrame, quantity: str) -> dict[str, Unit]:
    """code -> unit of one quantity, in the order of the factors; the reference table is read once by the driver, and more
    than MOST_UNITS rows are an error."""
    rows = units.where(F.col("quantity") == quantity).select("unit_code", "factor").distinct().orderBy(F.desc_nulls_last("factor"), "unit_code").limit(MOST_UNITS + 1).collect()
    if len(rows) > MOST_UNITS:
        raise ValueError("measure_units is no reference table")
    return {r.unit_code: code_unit(r.unit_code, quantity, None if r.factor is None else float(r.factor)) for r in rows}


def _nearest(cands: list[tuple[str, Column]], ref: Column, tol: float) -> Column:
    """The code whose value lies nearest to `ref` within the relative tolerance; the first wins a tie; null if none."""
    arr = F.array(*[F.struct(F.abs(v / ref - 1).alias("err"), F.lit(i).alias("ord"), F.lit(code).alias("code")) for i, (code, v) in enumerate(cands)])
    arr = F.filter(arr, lambda x: x.err.isNotNull() & (x.err <= tol))
    return F.try_element_at(F.array_sort(arr), F.lit(1)).code


def power_evidence(listings: DataFrame, power: dict[str, Unit]) -> DataFrame:
    """Adds the power figures found in power_raw and title (`pw_raw`, `pw_title`), and `text_kw`, the kW they state."""
    df = listings.withColumn("pw_raw", first_power(fold_wide("power_raw"), power)).withColumn("pw_title", first_power(fold_wide("title"), power))

    def kw(c: str) -> Column:
        v = convert_by_code(F.col(f"{c}.value"), F.col(f"{c}.unit"), power, parse_unit(CANONICAL["power"]))
        return F.when((v > 5) & (v < MAX_KW), v)

    return df.withColumn("text_kw", F.coalesce(kw("pw_raw"), kw("pw_title")))


def normalise_quantities(listings: DataFrame, units: DataFrame, fx: DataFrame, vat: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Power in kW and net price in EUR for every listing, with the unit each figure was recorded in.

    A figure's unit is the one that agrees with the row's other evidence: the unit written in power_raw or title, the
    other power field, or else how often its model's agreeing rows have each reading. For a net price the evidence is the
    gross price less the country's VAT, and the month's exchange rate.

    Out: row_id, power_kw_value (kW, double), kw_unit, hp_unit, raw_power_unit, net_eur, net_unit, raw_price_unit, and the
    columns of `carry` as they are, so that no join back on row_id is needed.
    Nulls: a missing field has a null unit; with no power or price at all the value is null. A figure without any
    evidence keeps its field's own unit. Placeholder or zero gross prices are no evidence. NaN counts as null.
    Empty input gives an empty result; repeated rows come out as often as they went in.
    """
    power, money = unit_codes(units, "power"), unit_codes(units, "price")
    kilowatt, euro = parse_unit(CANONICAL["power"]), parse_unit(CANONICAL["price"])
    power = {"kw": kilowatt, "ps": parse_unit("PS")} | power  # the units of the two fields
    as_kw = lambda c, code: convert(c, power[code], kilowatt)
    keep = ["row_id", "source", "scraped_at", "title", "model", "engine_displacement_cc", "power_kw", "power_hp", "power_raw", "price_eur", "price_net_eur", "original_price", "price_raw", "country_code"]
    df = listings.select(*keep, *([F.struct(*carry).alias("_carry")] if carry else []))
    for c in ("price_eur", "price_net_eur", "original_price"):
        df = df.withColumn(c, F.when(~F.isnan(F.col(c)), F.col(c)))
    df = df.withColumn("kwf", F.col("power_kw").cast("double")).withColumn("hpf", F.col("power_hp").cast("double"))
    df = power_evidence(df, power).withColumn("mk", normalize_text(fold_wide("model")))

    # a pair that agrees as it stands: its kW votes for its model
    agree = (F.abs(convert(F.col("kwf"), kilowatt, power["ps"]) - F.col("hpf")) <= 1.01) & (F.col("kwf") < MAX_KW)
    votes = (
        df.where(agree).groupBy("mk", F.round("kwf").cast("int").alias("vote_kw")).agg(F.count("*").alias("n"))
        .groupBy("mk").agg(F.map_from_entries(F.collect_list(F.struct(F.col("vote_kw"), F.col("n")))).alias("votes"))
    )
    # written first, so that its size is known when the join is planned and the wide rows need no shuffle while it is small
    votes = materialise(votes, "votes")
    df = df.join(votes.withColumnRenamed("mk", "vote_mk"), F.col("mk") == F.col("vote_mk"), "left")

    def support(kw: Column) -> Column:
        k = F.round(kw).cast("int")
        return reduce(lambda a, b: a + b, [F.coalesce(F.try_element_at("votes", k + d), F.lit(0)) for d in (-1, 0, 1)])

    # readings of the pair that give one power: (unit of power_kw, unit of power_hp), the likeliest first; units of the table
    # beyond those known here can be meant in either field
    pairs = [("kw", "ps"), ("ps", "ps"), ("kw", "kw"), ("kw", "bhp"), ("w", "ps"), ("kw", "w"), ("ps", "kw"), ("bhp", "ps"), ("w", "kw"), ("w", "bhp"), ("bhp", "bhp")]
    known = ["kw", "ps", "bhp", "w"]
    others = [u for u in power if u not in known]
    pairs = [p for p in pairs if p[0] in power and p[1] in power] + [(u, "ps") for u in others] + [("kw", u) for u in others]
    readings = [u for u in known if u in power] + others
    both = F.array(*[
        F.struct((-support(as_kw(F.col("kwf"), a))).alias("s"), F.lit(i).alias("ord"), as_kw(F.col("kwf"), a).alias("kw"),
                 F.abs(as_kw(F.col("kwf"), a) - as_kw(F.col("hpf"), b)).alias("gap"))
        for i, (a, b) in enumerate(pairs)
    ])
    fits = F.filter(both, lambda x: (x.gap <= F.greatest(F.lit(0.8), x.kw * 0.006)) & (x.kw > 5) & (x.kw < MAX_KW))
    pair_kw = F.try_element_at(F.array_sort(fits), F.lit(1)).kw

    def lone(field: str, own: str) -> Column:
        """The kW of a single field by its model's votes; its own unit unless that is absurd or another has clear support."""
        v = F.col(field)
        arr = F.array(*[F.struct((-support(as_kw(v, u))).alias("s"), F.lit(int(u != own)).alias("ord"), as_kw(v, u).alias("kw")) for u in (own, *[x for x in readings if x != own])])
        arr = F.array_sort(F.filter(arr, lambda x: (x.kw > 5) & (x.kw < MAX_KW)))
        best, base = F.try_element_at(arr, F.lit(1)), as_kw(v, own)
        return F.when((base < MAX_KW) & (support(base) > 0), base).otherwise(best.kw)

    ref = F.coalesce(
        F.when(F.col("text_kw").isNotNull() & (F.abs(F.col("text_kw") - F.round("text_kw")) < 1), F.col("text_kw")),
        F.when(agree, F.col("kwf")), pair_kw,
        F.when(F.col("hpf").isNull(), lone("kwf", "kw")), F.when(F.col("kwf").isNull(), lone("hpf", "ps")),
        F.when(F.col("kwf") < MAX_KW, F.col("kwf")), as_kw(F.col("hpf"), "ps"),
    )
    df = df.withColumn("ref_kw", ref)

    def unit_of(field: str, own: str) -> Column:
        order = [own, *[u for u in readings if u != own]]
        # the reading that rounds back to the very figure wins over the merely near one; the field's own unit goes first
        exact = F.coalesce(*[F.when(F.abs(convert(F.round(F.col("ref_kw")), kilowatt, power[u]) - F.col(field)) <= 0.51 * max(1.0, kilowatt.scale / power[u].scale if power[u].scale < kilowatt.scale / 2 else 1.0), F.lit(u)) for u in order])
        near = _nearest([(u, as_kw(F.col(field), u)) for u in order], F.col("ref_kw"), POWER_TOLERANCE)
        return F.when(F.col(field).isNotNull(), F.coalesce(exact, near, F.lit(own)))

    df = df.withColumn("kw_unit", unit_of("kwf", "kw")).withColumn("hp_unit", unit_of("hpf", "ps"))

    # prices
    df = df.withColumn("pr_raw", first_price(fold_wide("price_raw"), F.col("country_code")))
    df = df.withColumn("fx_key", F.date_format("scraped_at", "yyyy-MM")).withColumn("own_money", F.lower(literal_map(COUNTRY_MONEY)[F.col("country_code")]))
    per_country = vat.where("country_code is not null").groupBy(F.col("country_code").alias("vat_country")).agg(F.max("vat_pct").alias("vat_pct"))
    df = df.join(_rates(fx), F.col("fx_key") == F.col("fx_month"), "left").join(per_country, F.col("country_code") == F.col("vat_country"), "left")
    rates, fixed = F.col("rates"), {k: u for k, u in ({"eur": euro} | money).items() if not u.rate}
    currencies = {k: u for k, u in ({"eur": euro} | money).items() if u.rate or k == "eur"}
    own = lambda c: convert_by_code(c, F.col("own_money"), currencies, euro, rates)
    df = df.withColumn("vat_factor", 1 + F.col("vat_pct") / 100)
    gross = F.coalesce(F.when(F.col("price_eur") > 1, F.col("price_eur")), own(F.when(F.col("original_price") > 1, F.col("original_price"))))
    df = df.withColumn("expect_net", gross / F.col("vat_factor"))
    v = F.col("price_net_eur")
    order = ["eur", *[k for k in fixed if k != "eur"]]
    meant = [*[(k, convert(v, fixed[k], euro)) for k in order], ("own", F.when(F.col("own_money") != "eur", own(v)))]
    unit = F.coalesce(_nearest(meant, F.col("expect_net"), PRICE_TOLERANCE), _nearest(meant, F.col("expect_net"), 0.25), F.lit("eur"))
    df = df.withColumn("net_unit", F.when(v.isNotNull(), F.when(unit == "own", F.col("own_money")).otherwise(unit)))

    settled = F.coalesce(convert_by_code(F.col("kwf"), F.col("kw_unit"), power, kilowatt), convert_by_code(F.col("hpf"), F.col("hp_unit"), power, kilowatt), F.col("text_kw"))
    spelt_units = price_units({"eur": euro} | money)
    raw_gross = convert_by_code(F.col("pr_raw.value"), F.col("pr_raw.unit"), spelt_units, euro, rates)
    net = F.coalesce(convert_by_code(v, F.col("net_unit"), {**fixed, **currencies}, euro, rates), F.col("expect_net"), raw_gross / F.col("vat_factor"))
    no_power = F.col("power_kw").isNull() & F.col("power_hp").isNull()
    no_price = F.col("price_eur").isNull() & F.col("price_net_eur").isNull()
    return df.select(
        "row_id", settled.alias("power_kw_value"), "kw_unit", "hp_unit",
        F.when(no_power & F.col("pw_raw.value").isNotNull(), F.col("pw_raw.unit")).alias("raw_power_unit"),
        net.alias("net_eur"), "net_unit",
        F.when(no_price & F.col("pr_raw.value").isNotNull(), F.col("pr_raw.unit")).alias("raw_price_unit"),
        *[F.col(f"_carry.{c}").alias(c) for c in carry],
    )


def _rates(fx: DataFrame) -> DataFrame:
    """One row per month with the map currency -> EUR per unit; of several rates of a month the mean."""
    one = fx.where("fx_month is not null and currency_code is not null").groupBy("fx_month", F.lower("currency_code").alias("c")).agg(F.avg("eur_per_unit").alias("r"))
    return one.groupBy("fx_month").agg(F.map_from_entries(F.collect_list(F.struct("c", "r"))).alias("rates"))


def misrecorded_fields(quantities: DataFrame) -> DataFrame:
    """(row_id, field, unit_code) of the figures that are not in their field's unit, and of the figures only in text."""
    cell = lambda field, cond, unit: F.when(cond, F.struct(F.lit(field).alias("field"), unit.alias("unit_code")))
    k, h, n = F.col("kw_unit"), F.col("hp_unit"), F.col("net_unit")
    cases = F.array_compact(F.array(
        cell("power_kw", k != "kw", k), cell("power_hp", h != "ps", h), cell("price_net_eur", n != "eur", n),
        cell("power_raw", F.col("raw_power_unit").isNotNull(), F.col("raw_power_unit")), cell("price_raw", F.col("raw_price_unit").isNotNull(), F.col("raw_price_unit")),
    ))
    return quantities.select("row_id", F.inline(cases))
