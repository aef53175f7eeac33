"""Official lookup, timelines, payload parsers, file sources and sinks, streaming forms."""

import datetime as dt
import difflib
import json
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.operators import official as O
from lonja.operators.timelines import advert_history, offered_load, rate_limit
from lonja.sources import files, payloads
from lonja.sources.official_xml import OrderError, parse_order
from lonja.streaming.stateful import limit_stream, memory_merge, windowed_counts

VEH = "vehiculo_id long, marca string, modelo string, fecha_primera_matriculacion date, combustible string, cilindrada_cc int, potencia_kw double, transmission string, cylinders int, chosen_id long"
OFF = "id long, dataset_id long, brand string, model_type string, commercial_start int, commercial_end int, displacement_cc int, cylinders int, fuel_code string, power_kw int, value_eur int"


def test_official_lookup(spark):
    at = lambda i, name, cc=1415, fuel="G", kw=93, value=20000, start=2014, end=None, ds=1, brand="Xylon", cyl=4: (i, ds, brand, name, start, end, cc, cyl, fuel, kw, value)
    off = spark.createDataFrame([at(1, "Rasgo 1.4 Turbo Lux Aut.", value=21000, end=2019), at(2, "Rasgo 1.4 Turbo Lux", value=19000), at(3, "Rasgo 1.4 Turbo Sport Aut.", value=24000), at(4, "Rasgo 1.9 TD", 1896, "D", 85),
                                 at(5, "Rasgo 1.4 Turbo old", ds=2, value=1), at(6, "Rasgo e-Hyb", fuel="GyE", value=30000), at(7, "Rasgo 1.4 trio", cyl=3, value=18000), at(8, "e- Rayo Z", 0, "Elc", 100), at(9, "Rayo Z2", None, "Elc", 100)], OFF)
    versions = spark.createDataFrame([(1, "o1", 2026), (2, "o0", 2025)], "id long, order_code string, exercise int")
    day = dt.date(2016, 9, 1)
    v = lambda i, model="Rasgo 1.4 Turbo Lux", gear=None, fuel="gasolina", cc=1415, kw=92.0, cyl=None, chosen=None, when=day, brand="xylon": (i, brand, model, when, fuel, cc, kw, gear, cyl, chosen)
    veh = spark.createDataFrame([
        v(1, "Rasgo 1.4 Turbo Lux automatico"), v(2, kw=90.0), v(3, "Otro"), v(4, when=dt.date(2010, 1, 1)), v(5, None, brand=None, when=None, fuel=None, cc=None, kw=None), v(6, cc=1300), v(7, fuel="D"),
        v(10, "XYLON Rasgo HEV"), v(11, "Rasgo hyb"), v(12, fuel="GASOIL"), v(13, gear="Automatik"), v(14, cyl=3), v(15, chosen=3), v(16, chosen=999), v(17, "Rayo Z", fuel="electric", cc=None, kw=100.0), v(18, kw=None)], VEH)
    base = O.base_candidates(veh, O.latest_official(off, versions))
    tech = O.technical_candidates(base)
    picks = {r.vehiculo_id: r for r in O.pick_official(tech).collect()}
    assert set(picks) == {1, 10, 11, 13, 14, 15, 16, 17}
    assert (picks[1].boe_id, picks[1].pool, picks[1].spread_pct, picks[1].confidence) == (1, 2, 14.29, "non_conclusive")
    assert picks[10].boe_id == 6 and picks[11].boe_id in (1, 2, 3, 7)  # hev says hybrid, hyb does not
    assert picks[13].boe_id in (1, 3) and picks[14].boe_id == 7 and picks[14].confidence == "high"  # a declared gearbox; the cylinders
    assert (picks[15].boe_id, picks[15].confidence) == (3, "manual") and picks[16].confidence != "manual" and picks[17].boe_id == 8
    more = O.base_candidates(veh, O.latest_official(off, versions), more_fuels={"GASOIL": "D"})
    assert more.where("vehiculo_id = 12 and fuel = 'D'").count() > 0 and base.where("vehiculo_id = 12 and fuel = 'GASOIL'").count() > 0
    cause = {r.vehiculo_id: r.cause for r in O.fallback_cause(veh, base).collect()}
    assert {i: cause[i] for i in range(1, 8)} == {1: "resolved", 2: "power", 3: "model", 4: "period", 5: "no_date", 6: "displacement", 7: "fuel"}
    trace = {(r.vehiculo_id, r.boe_id): r.decision for r in O.candidate_trace(tech).collect()}
    assert trace[1, 2] == "gearbox_differs" and trace[1, 1] == "best_likeness" and trace[1, 3] == "lower_likeness" and trace[14, 2] == "cylinders_differ" and trace[15, 3] == "chosen_by_hand"
    audit = {r.vehiculo_id: r for r in O.resolution_audit(veh, base).collect()}
    assert (audit[1].technical, audit[1].with_gearbox, audit[1].warning) == (4, 2, "values_differ") and audit[5].warning == "no_brand_or_model" and audit[18].missing == "power_kw" and audit[2].warning == "no_technical_row"
    assert audit[17].missing == "" and O.pick_official(tech.limit(0)).count() == 0


def test_full_likeness_is_the_block_ratio(spark):
    """pick_official with the block ratio against a plain loop over the same candidates."""
    names = ["Rasgo 1.4 Turbo Lux", "Rasgo 1.4 Turbo", "Rasgo Turbo Lux 1.4", "Rasgo 1.4", "Rasgo Grand Turbo"]
    off = spark.createDataFrame([(i, 1, "Xylon", n, 2014, None, 1415, 4, "G", 93, 20000 + 10 * i) for i, n in enumerate(names)], OFF)
    versions = spark.createDataFrame([(1, "o1", 2026)], "id long, order_code string, exercise int")
    asks = ["Rasgo 1.4 Turbo Lux", "Rasgo Lux Turbo", "Rasgo 1,4", "Rasgo Grand", "Rasgo Turbo Lux 1.4 neu"]
    veh = spark.createDataFrame([(i, "Xylon", m, dt.date(2016, 1, 1), "G", 1415, 93.0, None, None, None) for i, m in enumerate(asks)], VEH)

    def score(q, c):
        if q == c:
            return 1.5
        a, b = set(q.split()), set(c.split())
        return 0.45 * difflib.SequenceMatcher(None, q, c).ratio() + 0.4 * len(a & b) / len(a) + 0.15 * len(a & b) / len(b) + (0.15 if c.startswith(q) else 0.1 if q in c else 0)

    plain = lambda s: " ".join("".join(ch if ch.isalnum() else " " for ch in s.lower()).split())
    got = {r.vehiculo_id: r.boe_id for r in O.pick_official(O.technical_candidates(O.base_candidates(veh, O.latest_official(off, versions)))).collect()}
    for i, m in enumerate(asks):
        assert got[i] == max(range(len(names)), key=lambda j: (round(score(plain(m), plain(names[j])), 4), j))


def test_limiter_counts_only_accepted(spark):
    t0 = dt.datetime(2026, 1, 1)
    ev = spark.createDataFrame([(i, "u", t0 + dt.timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 30, 61))] + [(9, "v", t0)], "event_id long, user_id string, ts timestamp")
    got = [r.accepted for r in rate_limit(ev, "user_id", "ts", "event_id", 3, 60).where("user_id = 'u'").orderBy("event_id").collect()]
    assert got == [True, True, True, False, True]
    assert [r.load for r in offered_load(ev, "user_id", "ts", 60).where("user_id = 'u'").orderBy("event_id").collect()] == [1, 2, 3, 4, 4]


def test_advert_history(spark):
    d = lambda n: dt.date(2026, 1, 5) + dt.timedelta(days=7 * (n - 1))
    rows = [(n, d(n), "s", i, dt.datetime(2026, 1, 5), p) for n, i, p in ((1, "A", 5.0), (2, " a", 6.0), (4, "a", 6.0), (1, "b", None), (3, "b", None))]
    h = {r.listing_id: r for r in advert_history(spark.createDataFrame(rows, "snapshot_id int, snapshot_date date, source string, listing_id string, scraped_at timestamp, price_eur double")).collect()}
    assert (h["a"].deliveries, h["a"].spells, h["a"].price_changes, h["a"].days, h["b"].spells) == (3, 2, 1, 21, 2)


RESULTS = {"numResultsTotal": 57, "hasNextPage": False, "listings": [
    {"id": "9001", "shortTitle": "Brenka Mibarix", "subTitle": "3.0 e-Dual Comfort", "make": {"localized": "Brenka"}, "model": {"localized": "Mibarix"},
     "attr": {"cn": "AT", "loc": "Oberau", "fr": "11/2018", "pw": "141 kW (192 PS)", "ft": "Hybrid", "ml": "61.047 km", "cc": "2.968 ccm", "tr": "Automatik"}, "contact": {"enumType": "PRIVATE"}, "price": {"grs": {"amount": 18450.5}}}, 17, {"shortTitle": "no id"}]}
PAGE = "<script>self.__next_f.push([1," + json.dumps("ü" + '{"searchResults":' + json.dumps(RESULTS) + "}") + '])</script><a href="/v?id=31"></a><a href="/v?a=b&id=32"></a><a href="/v?id=31#x"></a>'
LD = """<script type="application/ld+json">[{"@type":"Organization"},{"offers":{"itemOffered":{"@type":["Thing","Car"],"name":"Mibarix","brand":"Brenka","model":{"name":"Mibarix L"},"dateVehicleFirstRegistered":"2018-11","mileageFromOdometer":"61 047 km",
"fuelType":"Hybrid","vehicleEngine":{"engineDisplacement":{"value":"2.968"},"enginePower":{"value":141}},"offers":[{"price":18450,"seller":{"@type":"Person"}}]}}}]</script><script type="application/ld+json">{bad</script><p>CO2 97 g/km, IVA deducible</p>"""
STATE = '<script id="__NEXT_DATA__" type="x">' + json.dumps({"props": {"pageProps": {"listings": [
    {"id": "k1", "price": {"priceFormatted": "€ 7.950,-"}, "vehicle": {"make": "Morvik", "modelVersionInput": "Bagax 1,3 PHX", "fuel": "Benzin", "mileageInKm": "120.310 km"}, "vehicleDetails": [{"iconName": "speedometer", "data": "120.310 km"}, {"iconName": "power", "data": "66 kW (90 PS)"}]},
    {"id": "k2", "vehicle": {"modelVersionInput": "2.0 e-Volt", "fuel": "Elektro"}, "vehicleDetails": []}]}}}) + "</script>"


def test_payloads(spark):
    pages = spark.createDataFrame([(PAGE,), (LD,), (STATE,), ("",), (None,), ("<p>self.__next_f.push([1,\"bad</p>",)], "html string")
    s = payloads.summary_listings(pages).collect()
    assert [(r.listing_id, r.mileage_km, r.power_kw, r.power_hp, r.engine_displacement_cc, r.first_registration.year, r.seller_type, r.price_net_eur) for r in s] == [("9001", 61047, 141, 192, 2968, 2018, "private", None)]
    assert [(r.total, r.has_next) for r in payloads.result_total(pages).where("total is not null").collect()] == [(57, False)]
    assert pages.limit(1).select(payloads.linked_ids(F.col("html"))).collect()[0][0] == ["31", "32"]
    j = payloads.jsonld_listings(pages).collect()
    assert [(r.price_eur, r.mileage_km, r.engine_displacement_cc, r.power_kw, r.co2_emissions_g_km, r.vat_deductible, r.seller_type, r.model) for r in j] == [(18450.0, 61047, 2968, 141, 97, True, "private", "Mibarix L")]
    n = payloads.script_listings(pages).orderBy("listing_id").collect()
    assert [(r.listing_id, r.price_eur, r.power_kw, r.engine_displacement_cc, r.mileage_km) for r in n] == [("k1", 7950.0, 66, 1300, 120310), ("k2", None, None, None, None)]


def test_scalars(spark):
    k = payloads.battery_kwh
    assert k({"note": "Akku 41,5 kWh netto", "Usable-Battery-Capacity": "39"}) == 39.0 and k([{"deep": [{"t": "ca. 62 kWh"}]}]) == 62.0 and k({"x": 3}) is None and k("900 kWh") is None and k({"batteryCapacity": "n/a", "y": "5 kWh"}) == 5.0
    hosts = {"www.shop.example": "shop", "m.shop.example": "shop"}
    urls = ["https://www.shop.example/d/x/4711.html", "https://m.shop.example/v?id=88", "http://www.shop.example/d/4711.html", "https://evil.example/d/4711.html", "https://www.shop.example.evil.example/d/1.html", "https://www.shop.example/v?id=8a", "nonsense", None,
            "https://www.shop.example/o/123e4567-e89b-12d3-a456-426614174000"]
    got = [r.u and tuple(r.u) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(payloads.route_url(F.col("u"), hosts).alias("u")).collect()]
    assert got == [("shop", "4711"), ("shop", "88"), None, None, None, None, None, None, ("shop", "123e4567-e89b-12d3-a456-426614174000")]
    df = spark.createDataFrame([("12.045 km", "7,25", '[{"tag":"q","value":"old"},{"tag":"q","value":"new"}]'), (None, None, None)], "i string, d string, t string")
    r = df.select(payloads.localized_integer(F.col("i")).alias("i"), payloads.localized_decimal(F.col("d")).alias("d"), payloads.tag_values(F.col("t")).alias("t")).collect()
    assert (r[0].i, r[0].d, r[0].t) == (12045, 7.25, {"q": "new"}) and r[1].i is None
    b = spark.createDataFrame([('{"batteryCapacity":77}',), ("{bad",), (None,)], "j string").select(payloads.battery_capacity("j")).collect()
    assert [x[0] for x in b] == [77.0, None, None]
    imgs = spark.createDataFrame([('{"a":"https://i.example/1.jpg","b":["https://i.example/photo/2","https://i.example/page"],"c":"https://i.example/1.jpg"}',)], "j string").select(payloads.image_urls(F.col("j"))).collect()
    assert imgs[0][0] == ["https://i.example/1.jpg", "https://i.example/photo/2"]


def _order(cells="<td>Rayo 0.9</td><td>2019</td><td/><td>0.898</td><td/><td>G</td><td>51</td><td>7,04</td><td>70</td><td>11.250</td>", note="<p>Nota final.</p>", number="<numero_oficial>N/7</numero_oficial>", second="<tr><td>Uno</td><td>90</td></tr>"):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    table = lambda body, head="": f"<table>{'<thead><tr><th>' + head + '</th></tr></thead>' if head else ''}<tbody>{body}</tbody></table>"
    return f"""<documento><metadatos><identificador>D-77</identificador>{number}<fecha_publicacion>20251230</fecha_publicacion><fecha_vigencia>20260101</fecha_vigencia></metadatos><texto><p>Preámbulo</p><p>ANEXO I</p>
<p>Valores para el ejercicio 2031</p>{table(f"<tr>{cells}</tr>", "Marca: XYLON Modelo-Tipo")}<p class="centro_negrita">Autocaravanas</p>{table(row("Casa", 2020, 2024, "1.950", 4, "D", 96, "13,20", 130, "38.100"), "Marca: NOMA Modelo-Tipo")}
<p class="centro_negrita">Buggys</p>{table(row("Todos", "2.040"))}<p>ANEXO II</p><p>x</p><p>ANEXO IV</p>{table(row("Nuevo", 100) + row("Usado", 55))}{table(second)}{note}<p>ANEXO V</p>{table(row("no", "x"))}</texto></documento>"""


def test_official_xml(spark):
    o = parse_order(_order(), "https://order.example")
    f = o.frames(spark)
    assert (o.meta["exercise"], o.meta["publication_date"], o.meta["depreciation_note"], o.meta["source_url"]) == (2031, "2025-12-30", "Nota final.", "https://order.example")
    assert [(r.category, r.displacement_cc, r.fiscal_hp, r.value_eur, r.commercial_end, r.cylinders) for r in f["values"].collect()] == [("passenger_vehicle", 898, 7.04, 11250, None, None), ("motorhome", 1950, 13.2, 38100, 2024, 4)]
    assert f["bands"].collect()[0].category == "buggy" and [(r.category, r.percentage) for r in f["depreciation"].collect()] == [("conventional_vehicle", 100), ("conventional_vehicle", 55), ("motorhome", 90)] and f["versions"].count() == 1
    broken = ["<documento><texto><p>x</p></texto></documento>", "no xml", "<x/>", _order(cells="<td>short</td>"), _order(note=""), _order(number=""), _order(cells=_order.__defaults__[0].replace("11.250", "x")), _order().replace("20251230", "2025")]
    for xml in broken:
        with pytest.raises(OrderError):
            parse_order(xml)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,price,km\n1,\"10,5\",7\n2,x,\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), {"price"}, {"km"}).collect()] == [("1", 10.5, 7), ("2", None, None)]
    schema = T.StructType([T.StructField("key", T.StringType())])
    assert files.load_memory(spark, str(tmp_path / "none.json"), schema).count() == 0
    df = spark.createDataFrame([(2025, "a"), (2026, "b")], "exercise int, v string")
    files.replace_version(df, str(tmp_path / "v"), ["exercise"])
    files.replace_version(spark.createDataFrame([(2026, "c")], df.schema), str(tmp_path / "v"), ["exercise"])
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "v")).collect()) == ["a", "c"]
    out = files.export_csv(df.repartition(2), str(tmp_path), "out")
    raw = open(out, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.decode("utf-8-sig").splitlines()[0] == "exercise,v" and len(raw.splitlines()) == 3
    with pytest.raises(ValueError):
        files.export_csv(df.limit(0), str(tmp_path), "none")


def test_memory_is_saved_only_if_changed(spark, tmp_path):
    m = spark.createDataFrame([("a", 1, 2.5), ("b", 2, None)], "key string, n int, mean double")
    path = str(tmp_path / "memory")
    assert files.save_memory(m, path) and not files.save_memory(m.orderBy(F.desc("key")), path)
    assert files.save_memory(m.withColumn("n", F.col("n") + 1), path) and {r.n for r in files.load_memory(spark, path, m.schema).collect()} == {2, 3}
    s = files.snapshot_rows(m, ["key"], ["n", "mean"], {"many": F.col("n") > 1, "high": F.col("mean") > 1}).orderBy("key").collect()
    assert [(r.key, r.payload, r.many, r.high) for r in s] == [("a", '{"n":1,"mean":2.5}', False, True), ("b", '{"n":2}', True, False)] and len(s[0].payload_hash) == 64


def test_saved_pages(spark, tmp_path):
    for s in ("a", "b"):
        (tmp_path / s).mkdir()
        for i in range(3):
            (tmp_path / s / f"{i}.html").write_text(f"<p>{s}{i}</p>")
    spark.dataSource.register(files.SavedPages)
    df = spark.read.format("saved_pages").option("max_pages", 2).load(str(tmp_path))
    assert sorted(r.html for r in df.collect()) == ["<p>a0</p>", "<p>a1</p>", "<p>b0</p>", "<p>b1</p>"] and df.where("source = 'b'").count() == 2
    assert sorted(r.html for r in df.where("source in ('b', 'c') and page = '1'").collect()) == ["<p>b1</p>"] and df.where("source = 'a' and page = '2'").count() == 0


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = lambda *xs: spark.createDataFrame([(u, t0 + dt.timedelta(seconds=s), "x") for u, s in xs], "user_id string, ts timestamp, event_type string")
    # two batches, the second with events before those of the first: judged by event time, not by arrival
    ev = rows(("u", 20), ("u", 30), ("v", 5))
    ev.coalesce(1).write.parquet(str(tmp_path / "ev" / "a"))
    rows(("u", 0), ("u", 10), ("u", 61), ("z", 4_000)).coalesce(1).write.parquet(str(tmp_path / "ev" / "b"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "ev"))
    q = limit_stream(stream, "user_id", "ts", 3, 60, "2 minutes").writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.accepted for r in spark.sql("select * from limited where user_id = 'u' order by ts").collect()] == [True, True, True, False, True]
    stream = spark.readStream.schema(ev.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "ev"))
    w = windowed_counts(stream, "ts", "1 minute").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.sql("select sum(n) from windows").collect()[0][0] == 6  # the window of the last event is still open
    empty = spark.createDataFrame([], "key string, samples long, total double, least int, greatest int")
    one = memory_merge(spark.createDataFrame([("k", 1), ("k", 5)], "key string, value int"), empty)
    two = memory_merge(spark.createDataFrame([("k", 9), ("j", 2)], "key string, value int"), one)
    assert {(r.key, r.samples, r.total, r.least, r.greatest) for r in two.collect()} == {("k", 3, 15.0, 1, 9), ("j", 1, 2.0, 2, 2)}
    shutil.rmtree(tmp_path / "ev")
