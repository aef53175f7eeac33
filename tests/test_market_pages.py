"""JSON interface, detail pages, claims, pushdown, contracts, migrations, option groups, cache."""

import json

import pytest
from pyspark.sql import functions as F

from lonja.operators.filters import ListingFilter
from lonja.sources import contracts as C
from lonja.sources import market_pages as M
from lonja.sources import pushdown as P

ITEMS = [
    {"id": 501, "url": "/coche/501", "title": "Morvik BAGAX 1.3 PHX Lineal", "make": "Morvik", "model": "Bagax", "price": {"amount": 8200}, "year": 2017, "km": 90500, "hp": 90, "fuelType": "Híbrido", "cubicCapacity": 1298, "transmissionTypeId": 2,
     "location": {"regionLiteral": "Costa", "mainProvince": "Norte", "cityLiteral": "Puerto"}, "seller": {"name": "Taller Sol", "isProfessional": True}, "phone": "000", "creationDate": "2026-01-02T10:00:00", "photos": ["https://i.example/a.jpg"]},
    {"id": 502, "title": "Otra cosa", "make": "Morvik", "model": "Bagax", "hp": 0, "year": 0, "transmissionTypeId": 9, "seller": {"isProfessional": False}, "publishedDate": "2026-01-03T09:30:00", "creationDate": "2025-12-01T00:00:00"}, {"title": "no id"}, "broken", {"id": ""}]


def test_interface(spark):
    pages = spark.createDataFrame([(1, json.dumps({"items": ITEMS, "meta": {"totalResults": 41, "totalPages": 2}})), (2, "{bad"), (3, None), (4, json.dumps({"items": []}))], "page_num int, body string")
    got = {r.listing_id: r for r in M.interface_listings(pages, base_url="https://b.example").collect()}
    a, b = got["501"], got["502"]
    assert set(got) == {"501", "502"} and (a.version, a.url, a.power_kw, a.transmission, a.seller_type, a.city, a.country_code, a.total, a.has_next) == ("1.3 PHX Lineal", "https://b.example/coche/501", 66, "manual", "dealer", "Puerto", "ES", 41, True)
    assert a.images == ["https://i.example/a.jpg"] and a.first_registration.year == 2017 and a.publish_date.day == 2
    assert (b.version, b.power_kw, b.first_registration, b.transmission, b.seller_type, b.country_code, b.price_eur, b.publish_date.month) == ("Otra cosa", None, None, None, "private", None, None, 1)
    wanted = ListingFilter(make="morvik", max_km=100_000)
    assert [r.listing_id for r in M.refine(M.interface_listings(pages), wanted).collect()] == ["501"] and M.refine(M.interface_listings(pages), ListingFilter(), 1).count() == 1


def test_embedded_detail(spark):
    inner = {"id": "77", "title": "Kalbaya", "attributes": [{"tag": "mileage", "value": "40.010 km"}, {"tag": "battery", "value": "60"}, {"tag": "damageCondition", "value": "Neuwagen, unfallfrei"}, {"tag": "power", "value": "150 kW (204 PS)"}, {"tag": "cubicCapacity", "value": ""}]}
    text = '"listing":{broken "listing":' + json.dumps({"id": "1", "more": {"listing": inner}}) + '"listing":null'
    page = "<script>self.__next_f.push([1," + json.dumps(text) + "])</script>"
    assert M.object_with_id(text, '"listing":', "9") is None and M.object_with_id(None, "x", "1") is None
    assert M.object_with_id(json.dumps({"listing": {"id": "1", "listing": {"id": "77"}}}, separators=(",", ":")), '"listing":', "77") == {"id": "77"}
    pages = spark.createDataFrame([(page, "77"), (page, "404"), (None, "77")], "html string, listing_id string")
    d = M.detail_attributes(M.detail_objects(pages)).collect()
    assert [(r.listing_id, r.title, r.fuel_type, r.mileage_km, r.power_kw, r.accident_free, r.unregistered_new) for r in d] == [("77", "Kalbaya", "Eléctrico", 40010, 150, True, True)]


MARKUP = """<html><head><meta property="og:image" content="https://i.example/1.jpg"><style>g/km 5</style></head><body><h2>Brenka Mibarix</h2><h2> L 3.0</h2><span data-testid="prime-price">18.450&nbsp;€</span>
<div data-testid="vip-key-features-list-item-mileage"><div>Kilómetros</div><div>61.047 km</div></div><div data-testid="vip-key-features-list-item-power">141 kW (192 cv)</div><div data-testid="vip-key-features-list-item-transmission">Cambio automático</div>
<div data-testid="vip-key-features-list-item-firstRegistration">11/2018</div><div data-testid="vip-key-features-list-item-numberOfPreviousOwners">2 dueños</div><dl><dt data-testid="cubicCapacity-item">Cilindrada</dt><dd>2.968 ccm</dd>
<dt data-testid="envkv.co2Emissions-item">CO2</dt><dd>97 g/km</dd></dl><div data-testid="vip-vehicle-description-text">Uno<br>dos &amp; tres</div><p>5 puertas, 6,1 l/100 km</p><img src="https://i.example/logo.png"><img data-src="https://i.example/2.jpg"><div data-testid="vip-seller">Privatanbieter</div></body>"""


def test_detail_markup(spark):
    pages = spark.createDataFrame([("a", MARKUP), ("b", ""), ("c", None), ("d", "<div data-testid='prime-price'>12.000<p></div></span>")], "listing_id string, html string")
    r = {x.listing_id: x for x in M.detail_markup(pages).collect()}
    a = r["a"]
    assert (a.title, a.make, a.model, a.price_eur, a.mileage_km, a.power_kw, a.power_hp, a.transmission, a.previous_owners, a.engine_displacement_cc) == ("Brenka Mibarix L 3.0", "Brenka", "Mibarix L 3.0", 18450.0, 61047, 141, 192, "Automático", 2, 2968)
    assert (a.co2_emissions_g_km, a.consumption_combined_l_100km, a.doors, a.first_registration.year, a.description, a.images, a.seller_type) == (97, 6.1, 5, 2018, "Uno\\ndos & tres".encode().decode("unicode_escape"), ["https://i.example/1.jpg", "https://i.example/2.jpg"], "private")
    assert r["b"].price_eur is None and r["c"].title is None and r["d"].price_eur == 12000.0


def test_claims(spark):
    df = spark.createDataFrame([("Sin accidentes, no accidentado",), ("BESCHÄDIGT",), ("gebraucht",), ("  Nuevo",), (None,), ("",)], "c string")
    got = [(r[0], r[1], r[2]) for r in df.select(M.accident_free(F.col("c")), M.unregistered_new(F.col("c"), F.lit(None)), M.unregistered_new(F.col("c"), F.lit(1))).collect()]
    assert got == [(True, False, False), (False, False, False), (None, False, False), (None, True, False), (None, False, False), (None, False, False)]
    maps = [{"fuel": "Diesel", "battery": "1"}, {"envkv.engineType": "Elektromotor"}, {"battery": "1"}, {"battery": "1", "cylinder": "4"}, {}, None]
    assert [r[0] for r in spark.createDataFrame([(m,) for m in maps], "a map<string,string>").select(M.attribute_fuel(F.col("a"))).collect()] == ["Diesel", "Eléctrico", "Eléctrico", None, None, None]
    co2 = spark.createDataFrame([(1, 2, 3), (None, 2, 3), (None, None, 3), (None, None, None)], "co2_emissions_g_km int, co2_original_g_km int, co2_inferred_g_km int")
    assert [r[0] for r in co2.select(M.co2_value(co2)).collect()] == [1, 2, 3, None] and [r[0] for r in co2.select(M.co2_value(co2, ("co2_inferred_g_km", "none"))).collect()] == [3, 3, 3, None]


def test_pushdown(spark):
    f = ListingFilter(make="Morvik", model="bagax", min_price=5_000.5, max_year=2020, min_hp=100, max_hp=150, fuels=("diesel", "cng"), transmissions=("manual",), country="de", private_only=True)
    body = P.request_body(f, 2, 50, "year_desc", {"MORVIK": 7}, {("MORVIK", "BAGAX"): 31}, {"diesel": 1}, {"manual": 2})
    assert body["sort"] == {"term": "year", "order": "desc"} and body["filters"]["price"] == {"from": 5000, "to": None} and body["filters"]["vehicles"] == [{"make": "MORVIK", "makeId": 7, "model": "BAGAX", "modelId": 31}]
    assert body["filters"]["fuelTypeIds"] == [1] and body["filters"]["transmissionTypeId"] == 2 and body["filters"]["sellerTypeId"] == 2
    assert P.query_string(f, 3, {"MORVIK": 7}, None, {"diesel": "DIESEL"}, {}) == "isSearchRequest=true&dam=false&ms=7%3B%3B&p=5000%3A&fr=%3A2020&pw=73%3A110&cn=DE&ft=DIESEL&st=FSBO&pageNumber=3"
    assert P.query_string(ListingFilter()) == "isSearchRequest=true&dam=false" and "vehicles" not in P.request_body(ListingFilter(make="None"), makes={})["filters"]
    assert P.parse_words("Gasolina, hibrido,,vapor", P.FUEL_NAMES) == (("gasoline", "hybrid"), ("vapor",)) and P.parse_words(None, P.FUEL_NAMES) == ((), ()) and P.parse_sort("KM_desc ") == "mileage_desc" and P.parse_sort("x") == "relevance"
    words = spark.createDataFrame([("diesel",), ("steam",), (None,)], "f string").select(P.remote_word(F.col("f"), P.FUEL_WORDS["words_es"])).collect()
    assert [r[0] for r in words] == ["Diesel", "steam", None]
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 5.0), (4, 9.0)], "row_id long, price_eur double")
    assert [r.row_id for r in P.sort_listings(df, "price_desc").collect()] == [4, 2, 3, 1] and [r.row_id for r in P.sort_listings(df, "price_asc").collect()] == [2, 3, 4, 1]
    for bad in ({"page_size": 0}, {"page_size": 201}, {"min_km": 2, "max_km": 1}, {"max_doors": 9}):
        with pytest.raises(ValueError):
            ListingFilter(**bad)
    assert ListingFilter(make="Citroën", max_price=1).same_vehicle(ListingFilter(make="CITROEN ", country="es", page_size=10)) and not ListingFilter(make="a", min_km=1).same_vehicle(ListingFilter(make="a"))


def test_contract(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    c = C.Contract(("id", "v"), ("id",), 2, spark.createDataFrame([(9,)], "id long"))
    C.write_checked(df, str(tmp_path / "ok"), c)
    for bad in (df.select("v", "id"), df.limit(1), df.union(df).limit(2).union(df).where("id = 1").limit(2), df.withColumn("id", F.when(F.col("id") == 1, F.lit(None)).otherwise(F.col("id"))), df.withColumn("id", F.col("id") + 7)):
        with pytest.raises(C.ContractError):
            C.write_checked(bad, str(tmp_path / "bad"), c)
    assert tuple(c.report(df.limit(0)).collect()[0]) == (0, 0, 0)


def test_migrations(spark, tmp_path):
    ran = []
    ms = [C.Migration(2, "two", lambda s: ran.append(2)), C.Migration(1, "one", lambda s: ran.append(1))]
    log = str(tmp_path / "log")
    assert C.migrate(spark, log, "a", ms) == [1, 2] and C.migrate(spark, log, "a", [*ms, C.Migration(3, "three", lambda s: ran.append(3))]) == [3] and C.migrate(spark, log, "b", ms[:1]) == [2] and ran == [1, 2, 3, 2]
    with pytest.raises(ValueError):
        C.migrate(spark, log, "a", [ms[0], ms[0]])


def test_wide_export(spark):
    nested = spark.createDataFrame([("x", 10.0, (2019, None), ("ES", "Puerto"), ("dealer",), ("t1",))], "listing_id string, price_eur double, first_registration struct<year int, month int>, location struct<country_code string, city string>, seller struct<type string>, metadata struct<vehicle_id string>")
    wide = C.wide_export(nested.withColumn("scraped_at", F.lit("2026-01-01 10:00:00").cast("timestamp")), True)
    r = wide.collect()[0]
    assert len(wide.columns) == len(C.EXPORT) + 8 == 70 and (r.price_gross_eur, r.year, r.city, r.seller_type, r.vehicle_id, r.title) == (10.0, 2019, "Puerto", "dealer", "t1", None) and dict(wide.dtypes)["scraped_at"] == "timestamp_ntz"
    flat = spark.createDataFrame([("ES", "private")], "country_code string, seller_type string")
    assert tuple(C.wide_export(flat).select("country_code", "seller_type", "make").collect()[0]) == ("ES", "private", None)


def test_option_groups(spark):
    opts = [{"value": "", "label": "x"}, {"value": "1", "label": " Alle "}, {"value": "12", "label": "Bagax "}, {"value": "group-3", "label": "G"}, {"value": "5", "label": "S", "isGroup": True}, {"optgroupLabel": "Line", "items": [{"value": "13", "label": "Bagax II"}, {"items": [{"value": "14", "label": "Bagax III"}]}]}]
    df = spark.createDataFrame([(7, json.dumps(opts)), (7, json.dumps(opts)), (1400, json.dumps(opts)), (8, "[]"), (9, None)], "make_id int, options string")
    assert sorted(tuple(r) for r in C.option_models(df, excluded=(1400,)).collect()) == [(7, 12, "Bagax"), (7, 13, "Bagax II"), (7, 14, "Bagax III")]
    with pytest.raises(Exception, match="nested deeper"):
        C.option_models(df.limit(1), depth=2).collect()


def test_cache(spark):
    now, made = [0.0], []
    cache = C.TtlCache(900, lambda: now[0])
    get = lambda k: cache.get(k, lambda: made.append(k) or len(made))
    assert [get("a"), get("a"), get("b")] == [1, 1, 2]
    now[0] = 900.0
    assert get("a") == 3 and cache.get("df", lambda: spark.range(3)).count() == 3
