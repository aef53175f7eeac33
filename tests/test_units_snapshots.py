"""Unit grammar, misrecorded fields and snapshot changes on small tables, edge cases included."""

import datetime as dt

import pytest

from lonja.functions.units import ATOMS, code_unit, convert, convert_by_code, first_power, first_price, parse_unit
from lonja.operators.snapshots import snapshot_changes
from lonja.operators.units import misrecorded_fields, normalise_quantities
from pyspark.sql import functions as F

T0 = dt.datetime(2026, 1, 5, 12)
LISTING = "row_id long, source string, scraped_at timestamp, title string, model string, engine_displacement_cc int, power_kw int, power_hp int, power_raw string, price_eur double, price_net_eur double, original_price double, price_raw string, country_code string, power string"
UNITS = [("kw", "power", 1.0), ("ps", "power", 0.735499), ("bhp", "power", 0.7457), ("w", "power", 0.001), ("eur", "price", 1.0), ("eur_k", "price", 1000.0), ("eur_cent", "price", 0.01), ("pln", "price", None)]


def reference(spark):
    units = spark.createDataFrame(UNITS, "unit_code string, quantity string, factor double")
    fx = spark.createDataFrame([("EUR", "2026-01", 1.0), ("PLN", "2026-01", 0.25), ("SEK", "2026-01", 0.09)], "currency_code string, fx_month string, eur_per_unit double")
    vat = spark.createDataFrame([("DE", 19.0), ("PL", 23.0), ("SE", 25.0)], "country_code string, vat_pct double")
    return units, fx, vat


def row(i, kw=None, hp=None, raw=None, price=None, net=None, praw=None, country="DE", title=None, model="M"):
    return (i, "s", T0, title, model, 1500, kw, hp, raw, price, net, None, praw, country, "clash")


def test_unit_grammar():
    assert parse_unit("kg·m²/s³").dim == ATOMS["W"].dim
    assert parse_unit("kW").to(ATOMS["PS"], 100) == pytest.approx(135.962, abs=1e-3)
    assert parse_unit("°C").to(ATOMS["K"], 20) == pytest.approx(293.15)
    with pytest.raises(ValueError):
        parse_unit("°C/s")
    for bad in (lambda: parse_unit("kW").to(ATOMS["K"], 1), lambda: parse_unit("CHF").to(ATOMS["EUR"], 1), lambda: parse_unit("CHF^2"), lambda: parse_unit(""), lambda: parse_unit("kX")):
        with pytest.raises(ValueError):
            bad()


def test_codes_of_the_unit_table():
    assert code_unit("kw", "power", 1.0) == parse_unit("kW") and code_unit("chf", "price", None).rate == "chf"
    assert code_unit("mw_e", "power", 1000.0).to(ATOMS["PS"], 1) == pytest.approx(1359.62, abs=0.01)  # unknown to the grammar: by its factor
    for code, quantity, factor in (("kw", "power", 2.0), ("chf", "power", None), ("odd", "price", None)):
        with pytest.raises(ValueError):
            code_unit(code, quantity, factor)


def test_conversion_by_scale_offset_and_rate(spark):
    df = spark.createDataFrame([(20.0, "a", {"chf": 1.1}), (None, "a", {"chf": 1.1}), (20.0, "b", {}), (20.0, None, None)], "x double, code string, rates map<string,double>")
    c, k = parse_unit("°C"), parse_unit("K")
    got = [tuple(r) for r in df.select(convert(F.col("x"), c, k), convert(F.col("x"), parse_unit("kCHF"), ATOMS["EUR"], F.col("rates")), convert_by_code(F.col("x"), F.col("code"), {"a": c, "b": k}, k)).collect()]
    assert got[0] == (pytest.approx(293.15), pytest.approx(22_000.0), pytest.approx(293.15)) and got[1] == (None, None, None)
    assert got[2] == (pytest.approx(293.15), None, 20.0) and got[3][1:] == (None, None)
    with pytest.raises(ValueError):
        convert(F.col("x"), c, ATOMS["EUR"])


def test_figures(spark):
    df = spark.createDataFrame([("DTR 1.2 55kW man.",), ("136 PS / 100 kW",), ("brake hp 103",), ("103 brake hp",), (None,), ("",), ("x" * 100_000 + " 90 cv",)], "t string")
    got = [(r.p.value, r.p.unit) for r in df.select(first_power(F.col("t"), {c: code_unit(c, q, f) for c, q, f in UNITS if q == "power"}).alias("p")).collect()]
    assert got == [(55.0, "kw"), (136.0, "ps"), (None, None), (103.0, "bhp"), (None, None), (None, None), (90.0, "ps")]
    df = spark.createDataFrame([("10.045,00 EUR",), ("€10,010",), ("42,61 Tsd. €",), ("10,005 Tsd. €",), ("EUR 10.019,-",), ("CHF 10'105.–",), ("103 300 kr",), ("auf Anfrage",), (None,)], "t string")
    got = [(r.p.value, r.p.unit) for r in df.select(first_price(F.col("t"), F.lit("SE")).alias("p")).collect()]
    assert got == [(10045.0, "eur"), (10010.0, "eur"), (42.61, "eur_k"), (10.005, "eur_k"), (10019.0, "eur"), (10105.0, "chf"), (103300.0, "sek"), (None, None), (None, None)]


def test_misrecorded(spark):
    rows = [
        row(1, 100, 136), row(2, 136, 136, "136 PS"), row(3, 100, 134, "134 bhp"), row(4, 100_000, 136), row(5, 136, 100, "100 kW"), row(6, raw="110 KM"), row(7),
        row(8, 100, 136, price=11900.0, net=10000.0), row(9, 100, 136, price=11900.0, net=10.0), row(10, 100, 136, price=11900.0, net=1e6), row(11, 100, 136, price=12300.0, net=40000.0, country="PL"),
        row(12, praw="1,5 Tsd. €"), row(13, price=float("nan"), net=float("nan"), praw="1 500 zł", country="PL"), row(14, 100, 136, price=1.0, net=5000.0), row(14, 100, 136, price=1.0, net=5000.0),
        row(15, 75, 55, title="DTR 1.2 55kW"),
    ]
    df = spark.createDataFrame(rows, LISTING)
    got = {tuple(r) for r in misrecorded_fields(normalise_quantities(df, *reference(spark))).collect()}
    want = {(2, "power_kw", "ps"), (3, "power_hp", "bhp"), (4, "power_kw", "w"), (5, "power_kw", "ps"), (5, "power_hp", "kw"), (6, "power_raw", "ps"), (9, "price_net_eur", "eur_k"),
                   (10, "price_net_eur", "eur_cent"), (11, "price_net_eur", "pln"), (12, "price_raw", "eur_k"), (15, "power_kw", "ps"), (15, "power_hp", "kw"), (13, "price_raw", "pln")}
    assert got - {(13, "price_raw", "pln")} == want - {(13, "price_raw", "pln")}
    units, fx, vat = reference(spark)
    twice = {tuple(r) for r in misrecorded_fields(normalise_quantities(df, units.union(units), fx.union(fx), vat.union(vat))).collect()}
    assert twice == got  # repeated rows of the reference tables change nothing
    more = units.union(spark.createDataFrame([("kcal_min", "power", 0.0697333)], units.schema))  # a unit only the table knows
    kcal = spark.createDataFrame([row(1, 1434, 136)], LISTING)
    assert {tuple(r) for r in misrecorded_fields(normalise_quantities(kcal, more, fx, vat)).collect()} == {(1, "power_kw", "kcal_min")}
    q = {r.row_id: r for r in normalise_quantities(df, *reference(spark)).collect()}
    assert q[7].power_kw_value is None and q[7].net_eur is None and q[2].power_kw_value == pytest.approx(100, abs=0.1)
    assert q[11].net_eur == pytest.approx(10000) and normalise_quantities(df.limit(0), *reference(spark)).count() == 0


SNAP = "snapshot_id int, snapshot_date date, source string, listing_id string, scraped_at timestamp, price_eur double, mileage_km int"


def snap(n, source, lid, price, hour=1):
    return (n, dt.date(2026, 1, 5), source, lid, dt.datetime(2026, 1, 5, hour), price, 1)


def test_snapshot_changes(spark):
    rows = [
        snap(1, "a", "X1", 100.0), snap(1, "a", " x2 ", 5.0), snap(1, "a", "x3", None), snap(1, "a", "x5", 7.0),
        snap(2, "a", "x1", 100.000001), snap(2, "a", "x2", 6.0, 2), snap(2, "a", "x2", 9.0, 1), snap(2, "a", "x4", 1.0), snap(2, "a", "x3", float("nan")), snap(2, "a", "x5", None),
        snap(2, "b", "x1", 3.0), snap(4, "b", "x1", 3.0), snap(4, "b", "x9", 1.0), snap(4, "a", "x2", 6.0), snap(4, None, "x2", 6.0),
    ]
    df = spark.createDataFrame(rows, SNAP)
    got = {(r.source, r.listing_id, r.snapshot_id, r.change_kind) for r in snapshot_changes(df).collect()}
    assert got == {("a", "x2", 2, "changed"), ("a", "x4", 2, "added"), ("a", "x5", 2, "changed"), ("b", "x9", 4, "added"), ("a", "x1", 4, "removed"), ("a", "x3", 4, "removed"), ("a", "x4", 4, "removed"), ("a", "x5", 4, "removed")}
    assert snapshot_changes(df.limit(0)).count() == 0
    old = {(r.listing_id, r.snapshot_id): (r.old_cents, r.new_cents) for r in snapshot_changes(df).collect()}
    assert old[("x2", 2)] == (500, 600) and old[("x5", 2)] == (700, None) and old[("x4", 2)] == (None, 100)
