"""Nulls, ties, empty frames, repeated rows and clashing names in the keyed and profile operators."""

import datetime as dt

from pyspark.sql import functions as F

from lonja.operators import enrich, matching, profile, rows
from lonja.operators.timelines import offered_load
from lonja.session import release, spread

T0 = dt.datetime(2026, 1, 1)
CAR = "row_id long, source string, listing_id string, title string, make string, model string, version string, price_eur double, mileage_km int, first_registration struct<year int, month int>, fuel_type string, transmission string, power_hp int, power_kw int, engine_displacement_cc int, seller_dealer_id string, country_code string, level string, id long"


def car(i, make="Xylon", model="Rasgo", km=50_000, year=2018, cc=1500, hp=100, price=9_000.0, fuel="diesel", tx="manual", country="ES", version=None):
    return (i, "s", f"l{i}", None, make, model, version, price, km, None if year is None else (year, 1), fuel, tx, hp, None, cc, None, country, "clash", -i)


def test_matching_edges(spark):
    cars = [car(1, country="DE"), car(2), car(3, km=150_000), car(4, year=2010), car(5, cc=2100), car(6, hp=300), car(7, make=None), car(8, year=None), car(9, km=None), car(10, price=None), car(2, price=9_000.0), car(12, fuel="Strom"), car(13, model="na")]
    df = spark.createDataFrame(cars, CAR)
    t, c = matching.keyed(df.where("country_code = 'DE'")), matching.keyed(df.where("country_code = 'ES'"))
    why = {(r.candidate_id, r.level, r.reason) for r in matching.pair_decisions(t, c).collect()}
    assert why == {(2, "broad", None), (3, None, "mileage"), (4, None, "year"), (5, None, "displacement"), (6, None, "power"), (8, None, "year"), (9, None, "mileage"), (10, "broad", None)}
    s = matching.market_statistics(matching.comparable_pairs(t, c), first_sources=("z", "s")).collect()
    assert [(r.n, r.level, r.median, r.sources, r.warnings) for r in s] == [(2, "broad", 9000.0, "s", "broad_only,battery_open,small_sample")]
    deduped = rows.dedupe_listings(matching.narrow(df.where("country_code = 'ES'")))
    assert deduped.count() == df.where("country_code = 'ES'").count() - 2 and "level" not in deduped.columns
    assert matching.market_statistics(matching.comparable_pairs(t.limit(0), c)).count() == 0 and matching.pair_decisions(t, c.limit(0)).count() == 0
    label = spark.range(1).select(matching.source_label(F.array(F.lit("b"), F.lit("a"), F.lit("z")), ("z", "y")).alias("x")).collect()[0].x
    assert label == "z+a+b"


def test_memory_fold_steps(spark):
    values = [100, 101, 101, 150, 0]
    df = spark.createDataFrame([(i, "s", "m", "x", "v", (2020, None), v) for i, v in enumerate(values)] + [(9, "manual", "m", "x", "v", (2020, None), 999), (10, "s", None, "x", "v", (2020, None), 1), (11, "s", "m", "x", "w", (2020, None), None)],
                               "row_id long, source string, make string, model string, version string, first_registration struct<year int, month int>, co2_emissions_g_km int")
    mean = float(values[0])
    for n, v in enumerate(values[1:], 1):
        mean = round((mean * n + v) / (n + 1), 2)
    got = enrich.memory_fold(df.orderBy(F.desc("row_id"))).collect()
    assert [(r.samples, r.co2_min, r.co2_max, r.co2_avg) for r in got] == [(5, 0, 150, mean)] and enrich.memory_fold(df.limit(0)).count() == 0
    e = enrich.enrich_co2(df.withColumn("fuel_type", F.lit("Strom")), enrich.memory_fold(df), doubtful=F.col("row_id") == 0)
    assert {r.row_id: r.co2_confidence for r in e.collect()}[0] == 0.5


def test_load_over_slices(spark):
    at = [0, 59, 60, 5_999, 6_000, 6_001, 6_058, 12_030]
    ev = spark.createDataFrame([("u", T0 + dt.timedelta(seconds=s), i) for i, s in enumerate(at)] + [("u", None, 90), (None, T0, 91)], "user_id string, ts timestamp, load long")
    got = {r.i: r.load for r in offered_load(ev.withColumnRenamed("load", "i"), "user_id", "ts", 60).collect()}
    want = {i: sum(s - 60 < x <= s for x in at) for i, s in enumerate(at)}
    assert {i: got[i] for i in want} == want and got.get(91) == 1 and offered_load(ev.limit(0).drop("load"), "user_id", "ts", 60).count() == 0


def test_lookups(spark):
    entries = spark.createDataFrame([("A", 1, "Rasgo"), ("A", 2, "Rasgo Grand"), ("B", 3, "Rasgo"), ("A", 4, None), (None, 5, "Rasgo")], "make string, id int, name string")
    wanted = spark.createDataFrame([("a", "rasgo "), ("a", "Grand"), ("b", "Rasgo GT"), ("a", ""), ("a", None), (None, "Rasgo"), ("c", "Rasgo"), ("a", "Rasgo")], "make string, wanted string")
    got = {(r.make, r.wanted): (r.id, r.how) for r in profile.lookup_within(wanted, entries, "make").collect()}
    assert got == {("a", "rasgo "): (1, "equal"), ("a", "Rasgo"): (1, "equal"), ("a", "Grand"): (2, "part"), ("b", "Rasgo GT"): (3, "part")}
    one = {r.wanted: (r.id, r.how) for r in profile.catalogue_lookup(wanted.select("wanted"), entries.select("id", "name")).collect()}
    assert one == {"rasgo ": (1, "equal"), "Rasgo": (1, "equal"), "Grand": (2, "part"), "Rasgo GT": (1, "part")}
    short = profile.catalogue_lookup(spark.createDataFrame([("go",), ("x",)], "wanted string"), entries.select("id", "name")).collect()
    assert [(r.wanted, r.id) for r in short] == [("go", 1)]
    names = {r.top: r.names for r in profile.catalogue_names(entries, "make", "name").collect()}
    assert names == {"A": "Rasgo,Rasgo Grand", "B": "Rasgo"} and profile.catalogue_names(entries.limit(0), "make", "name").count() == 0


def test_session_helpers(spark):
    from lonja.session import materialise

    df = materialise(spark.range(5), "x")
    assert df.count() == 5 and spread(spark.range(0, 5, 1, 1)).rdd.getNumPartitions() > 1 and spread(spark.range(0, 5, 1, 64)).rdd.getNumPartitions() == 64
    assert release(spark) >= 1 and release(spark) == 0
