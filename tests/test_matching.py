"""Filters, comparable matching and keyed row operators at their boundaries."""

import pytest
from pyspark.sql import functions as F

from lonja.operators import enrich, matching, profile, rows
from lonja.operators.filters import ListingFilter

SCHEMA = "row_id long, listing_id string, source string, title string, make string, model string, version string, price_eur double, first_registration struct<year:int,month:int>, fuel_type string, power_hp int, power_kw int, engine_displacement_cc int, mileage_km int, transmission string, battery_capacity_kwh double, seller_type string, seller_dealer_id string, country_code string, body_type string, co2_emissions_g_km int, unregistered_new boolean, id string"
BASE = dict(row_id=1, listing_id="de-1", source="m", title="BMW X5 xDrive30d", make="BMW", model="X5", version=None, price_eur=40000.0, first_registration=(2020, 6), fuel_type="diesel", power_hp=265, power_kw=None, engine_displacement_cc=2993,
            mileage_km=60000, transmission="automatic", battery_capacity_kwh=None, seller_type="dealer", seller_dealer_id="D1", country_code="DE", body_type="suv", co2_emissions_g_km=None, unregistered_new=False, id="clash")


def frame(spark, *changes):
    return spark.createDataFrame([tuple({**BASE, "row_id": i + 1, **c}.values()) for i, c in enumerate(changes)], SCHEMA)


def levels(spark, target, *cands):
    p = matching.comparable_pairs(matching.keyed(frame(spark, target)), matching.keyed(frame(spark, *cands)))
    got = {r.candidate_id: r.level for r in p.collect()}
    return [got.get(i + 1) for i in range(len(cands))]


def test_mileage_and_year_boundaries(spark):
    km = [{"mileage_km": 60000 + d} for d in (15000, 15001, 35000, 35001, 60000, 60001)]
    assert levels(spark, {}, *km) == ["exact", "near", "near", "broad", "broad", None]
    years = [{"first_registration": (2020 + d, 1)} for d in (-1, 2, 3, -4, 5)] + [{"first_registration": None}, {"mileage_km": None}]
    assert levels(spark, {}, *years) == ["exact", "near", "broad", "broad", None, None, None]


def test_engine_power_gearbox_battery(spark):
    got = levels(spark, {}, {"title": "BMW X5 xDrive40d"}, {"power_hp": 280}, {"power_hp": 281}, {"power_hp": 295, "transmission": "manual"}, {"power_hp": 332}, {"engine_displacement_cc": 3494}, {"transmission": "Schaltgetriebe"}, {"transmission": None}, {"fuel_type": None}, {"make": None}, {"power_hp": None, "power_kw": 195})
    assert got == [None, "exact", "near", "near", None, None, "near", "near", None, None, "exact"]
    ev = {"fuel_type": "Eléctrico", "title": "BMW X5", "engine_displacement_cc": None, "battery_capacity_kwh": 77.0}
    assert levels(spark, ev, ev, {**ev, "battery_capacity_kwh": 72.0}, {**ev, "battery_capacity_kwh": 58.3}, {**ev, "battery_capacity_kwh": None}) == ["exact", "exact", "broad", "broad"]
    p = matching.comparable_pairs(matching.keyed(frame(spark, ev)), matching.keyed(frame(spark, {**ev, "battery_capacity_kwh": 58.3}, {**ev, "battery_capacity_kwh": None}))).orderBy("candidate_id")
    assert [r.checks["battery"] for r in p.collect()] == ["relaxed", "unavailable"]


def test_statistics_choose_the_best_level(spark):
    pairs = matching.comparable_pairs(matching.keyed(frame(spark, {})), matching.keyed(frame(spark, {"price_eur": 40000.0}, {"price_eur": 42000.0}, {"mileage_km": 90000, "price_eur": 1.0}, {"price_eur": None})))
    s = matching.market_statistics(pairs).collect()[0]
    assert (s.level, s.n, s.average, s.median, s.least, s.confidence, s.warnings) == ("exact", 2, 41000.0, 41000.0, 40000.0, "high", "small_sample")
    only = matching.comparable_pairs(matching.keyed(frame(spark, {})), matching.keyed(frame(spark, {"price_eur": None}, {"mileage_km": 90000})))
    assert [r.level for r in matching.market_statistics(only).collect()] == ["near"] and matching.market_statistics(only, price_first=False).count() == 0
    near = matching.comparable_pairs(matching.keyed(frame(spark, {})), matching.keyed(frame(spark, {"mileage_km": 90000, "price_eur": 10.0}, {"mileage_km": 90000, "transmission": "manual", "price_eur": 20.0})))
    r = matching.market_statistics(near).collect()[0]
    assert (r.level, r.n, r.median) == ("near", 1, 10.0) and "same_gearbox_preferred" in r.warnings
    assert matching.market_statistics(pairs.limit(0)).count() == 0


def test_filter(spark):
    df = frame(spark, {}, {"price_eur": None}, {"mileage_km": 130000}, {"seller_type": "private"}, {"country_code": "ES"}, {"model": "X5 M"}, {"model": "X50", "title": "X50"})
    ids = lambda f: [r.row_id for r in f.apply(df).orderBy("row_id").collect()]
    assert ids(ListingFilter(max_price=50000)) == [1, 3, 4, 5, 6, 7] and ids(ListingFilter(max_km=120000, dealer_only=True, country="de")) == [1, 2, 6, 7]
    assert ids(ListingFilter(model="x5")) == [1, 2, 3, 4, 5, 6] and ids(ListingFilter(fuels=("electric",))) == [] and ids(ListingFilter(min_doors=3)) == []
    for bad in (dict(min_year=2020, max_year=2019), dict(min_year=1800), dict(dealer_only=True, private_only=True), dict(max_seats=20)):
        with pytest.raises(ValueError):
            ListingFilter(**bad)
    assert ListingFilter(make="BMW", min_price=1).same_vehicle(ListingFilter(make="bmw")) and not ListingFilter(make="BMW").same_vehicle(ListingFilter(make="Audi"))


def test_keep_best_latest_erase(spark):
    df = frame(spark, {"version": None}, {"version": "x"}, {"version": "y"}, {"make": None}, {"make": None})
    assert sorted(r.row_id for r in rows.dedupe_listings(df).collect()) == [2, 4]
    t = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 1, "z")], "k string, n int, v string")
    assert {(r.k, r.n, r.v) for r in rows.latest_per_key(t, ["k"], ["n"]).collect()} == {("a", 2, None), (None, 1, "z")}
    assert {(r.k, r.v) for r in rows.upsert(t, spark.createDataFrame([("a", 9, "new"), ("b", 1, "b")], t.schema), ["k"]).collect()} == {("a", "new"), ("b", "b"), (None, "z")}
    assert {(r.k, r.f) for r in rows.with_flag(t, t.where("n = 2"), "k", "f").collect()} == {("a", True), (None, False)}
    assert {(r.k, r.n) for r in rows.unused(t, t.where("k = 'a'"), "k").collect()} == {(None, 1)}
    e = rows.erase(t, F.lower("v") == "x", ["v"]).collect()
    assert [(r.v, r.erased) for r in e] == [(None, True), (None, False), ("z", False)]
    m = [r[0] for r in frame(spark, {}, {"make": "", "price_eur": None}, {"fuel_type": "Strom", "engine_displacement_cc": None}, {"first_registration": None, "unregistered_new": True}).select(rows.missing_fields(df)).collect()]
    assert m == ["", "make,price_eur", "", ""]


def test_memory_and_enrichment(spark):
    c = {"version": "30d"}
    df = frame(spark, {**c, "co2_emissions_g_km": 150}, {**c, "co2_emissions_g_km": 153}, {**c, "co2_emissions_g_km": 154}, c, {"version": "40d"}, {"fuel_type": "EV Strom"}, {**c, "source": "manual", "co2_emissions_g_km": 1})
    fold = enrich.memory_fold(df).collect()[0]
    assert (fold.samples, fold.co2_min, fold.co2_max, fold.co2_avg) == (3, 150, 154, 152.33)
    got = {r.row_id: (r.co2_g_km, r.co2_source) for r in enrich.enrich_co2(df, enrich.memory_mean(df)).collect()}
    assert got[4] == (152, "memory") and got[5] == (None, "missing") and got[6] == (0, "electric_zero") and got[1] == (150, "listing")


def test_profiles(spark):
    t = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 10.0), ("b", None), (None, float("nan"))], "k string, v double")
    q = profile.quartile_outliers(t, ["k"], "v").collect()
    assert [(r.k, r.q1, r.n, r.outliers) for r in q] == [("a", 1.75, 4, 0)]
    assert {(r.field, r.value, r.percent) for r in profile.frequencies(t, ["k"]).collect()} == {("k", "a", 66.67), ("k", "b", 16.67), ("k", "(none)", 16.67)}
    names = spark.createDataFrame([(1, "Golf"), (2, "Polo"), (3, "Golf Plus")], "id int, name string")
    w = spark.createDataFrame([("golf ",), ("Golf Pl",), ("zzz",), (None,), ("",)], "wanted string")
    assert {(r.wanted, r.id, r.how) for r in profile.catalogue_lookup(w, names).collect()} == {("golf ", 1, "equal"), ("Golf Pl", 1, "part")}


def test_decisions_take_one_join_and_repeated_ids_every_match(spark):
    t, c = frame(spark, {}), frame(spark, {}, {"mileage_km": 300_000}, {"first_registration": None})
    once = matching.pair_decisions(matching.keyed(t), matching.keyed(c))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # pairs are not joined with pairs
    assert {(r.candidate_id, r.level, r.reason) for r in once.collect()} == {(1, "exact", None), (2, None, "mileage"), (3, None, "year")}
    c = frame(spark, {"row_id": 5}, {"row_id": 5, "mileage_km": 90_000}, {"row_id": 6, "mileage_km": 300_000}, {"row_id": 5, "mileage_km": 300_000}, {"row_id": None})
    got = sorted((r.candidate_id or 0, r.level or "", r.reason or "") for r in matching.pair_decisions(matching.keyed(t), matching.keyed(c)).collect())
    # each of the three pairs of ids 1 and 5 takes the level of both matches, as in the SQL; no id, no match
    assert got == sorted([(5, "exact", "")] * 3 + [(5, "near", "")] * 3 + [(6, "", "mileage"), (0, "", "")])
