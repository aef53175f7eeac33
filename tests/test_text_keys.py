"""Normalisers and identity keys against label tables and Python's own Unicode data."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lonja.functions import keys as K
from lonja.functions.text import contains_tokens, normalize_official, normalize_text


def one(spark, fn, values, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def plain(v):
    if not v:
        return "na"
    v = unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "_", v).strip("_") or "na"


def test_normalize_text_matches_unicode_over_latin(spark):
    values = [chr(c) + "x" for c in range(0xA1, 0x250) if unicodedata.category(chr(c))[0] == "L"] + ["Großraum", "CO₂", "Ｖｏｌｔ", "𝗲-𝗩𝗼𝗹𝘁", "Ⅲ", "ﬁn", "", None, "---", "a  b"]
    got = one(spark, normalize_text, values)
    # a letter that decomposes into several ASCII letters is only covered where the table says so
    single = [(v, g) for v, g in zip(values, got) if len(v or "") != 2 or len(unicodedata.normalize("NFKD", v[0]).encode("ascii", "ignore")) < 2]
    assert [(v, g) for v, g in single if g != plain(v)] == []


def test_official_form_joins_figure_and_letter(spark):
    assert one(spark, normalize_official, ["320 d Aut.", "GLÄNZEND-2.0", None]) == ["320d aut", "glanzend 2 0", None]


@pytest.mark.parametrize("label,want", [
    ("Benzin Super Plus", "gasoline"), ("motor de gasolina 2.0", "gasoline"), ("Hybrid: Benzin + Strom", "hybrid"), ("mild-hybrid Diesel", "hybrid"), ("Hybrid mit Plug", "phev"), ("HÍBRIDO/ENCHUFABLE", "phev"), ("plug-in", "other"),
    ("biodiesel B7", "diesel"), ("DI-ESEL", "diesel"), ("100 % Strom", "electric"), ("vehículo eléctrico", "electric"), ("Umbau auf Autogas", "lpg"), ("GLP y gasolina", "lpg"), ("CNG+Benzin", "cng"), ("gas-natural vehicular", "cng"),
    ("Hidrógeno verde", "hydrogen"), ("flex fuel E85", "ethanol"), ("Etanol", "ethanol"), ("Holzvergaser", "other"), ("***", "na"), ("", "na"), (None, "na"),
])
def test_fuel_labels(spark, label, want):
    assert one(spark, K.fuel_category, [label]) == [want]


def test_bodies(spark):
    got = one(spark, K.body_category, ["Kompakt-SUV", "gran Monovolumen", "ROADSTER 2+2", "Estate/Kombi", "sportliche Limousine", "multi-purpose vehicle", "Kastenwagen", "", None, "cabrio Geländewagen", "sedan coupé"])
    assert got == ["suv", "monovolumen", "deportivo_gama_alta", "familiar", "turismo", "monovolumen", None, None, None, "suv", "deportivo_gama_alta"]


def test_model_key(spark):
    assert one(spark, K.model_key, ["serie Óptima", "CLASE k 200", "q 9 max", "Fadoneta IV", "-", None, "na", "na Kalbaya"]) == ["serie_optima", "clase_k", "q_9", "fadoneta", "na", "na", "na", "kalbaya"]


def test_variant_and_engine(spark):
    rows = [("sDrive41e Sport", "Q7", None, "Diesel", 2449), (None, "Kalbaya 417 d lang", None, "Diesel", 1951), ("1.6 Blue HDI", "Fasota", None, "Diesel", 1560), (None, "Zenneridor", None, "Strom", 999), (None, "Schlicht", None, "Benzin", None),
            ("na 88 x", None, None, "Benzin", 1250), (None, "m 340 i", None, "Benzin", 0), (None, "a 45 z", None, "Benzin", None), ("12 na e", None, None, "Benzin", None)]
    df = K.with_engine(spark.createDataFrame(rows, "version string, title string, model string, fuel_type string, engine_displacement_cc int"))
    assert [(r.variant, r.engine) for r in df.select("variant", "engine").collect()] == [
        ("41e", "2400:41e"), ("417d", "2000:417d"), ("16", "1600:bluehdi"), ("na", "electric"), ("na", "na"), ("88", "1200:88"), ("m340i", "m340i"), ("a45", "a45"), ("12e", "12e")]


def test_contains_tokens(spark):
    df = spark.createDataFrame([("fasota_rs_black", "rs"), ("fasota_rsx", "rs"), ("neu_fasota_rs", "fasota_rs"), ("rs", "rs")], "h string, n string")
    assert [r[0] for r in df.select(contains_tokens(F.col("h"), F.col("n"))).collect()] == [True, False, True, True]
