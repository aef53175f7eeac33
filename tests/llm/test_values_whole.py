"""Canonical values: what the cosine decides, what the edit distance only confirms, and spellings the words were not chosen on."""

from lonja.llm.canonical_values import ALIASES, FUEL_WORDS, ORDER, map_values

#: Spellings written for this test; none stands in the word list as it is.
HELD_OUT = {
    "gasoline": ["Super Benzin 95", "Normalbenzin", "gasolina súper", "benzine", "Petrol (95 RON)", "benzyna bezołowiowa", "gazolina", "petrl"],
    "diesel": ["Dieselkraftstoff mit AdBlue", "motor diésel", "biodiesel", "gasoleo A", "Diesl", "moteur gazole", "clean diesel"],
    "electric": ["Elektromotor", "eléctrica 100 %", "full electric", "reines Elektroauto", "batterieelektrisch", "elektriskt", "electrica pura"],
    "hybrid": ["Hybridantrieb", "full hybrid petrol", "híbrida", "hybride essence", "hybrid ohne Stecker"],
    "phev": ["Plugin-Hybrid Diesel", "híbrida enchufable", "plug-in", "PHEV (Benzin)"],
    "lpg": ["Autogas/Benzin", "GPL/benzina", "LPG Gasanlage", "gas licuado GLP"],
    "cng": ["Erdgasantrieb", "gasolina con GNC", "metano/benzina", "CNG (Biogas)"],
    "hydrogen": ["Wasserstoff (Brennstoffzelle)", "hidrogeno verde", "Hydrogen FCEV"],
    "ethanol": ["Bioetanol E85", "Ethanol/Benzin", "etanol anhidro"],
    None: ["ohne Angabe", "desconocido", "unbekannt", "other", "Kohle", "wood", "por consultar", "keine"],
}


def test_cosine_decides_and_edits_confirm(spark):
    longer = ["kalmorit" + 4 * c for c in "bcdfghjnpq"]
    canon = spark.createDataFrame([(i, "make", x) for i, x in enumerate([*longer, "kxlmxrit"], 1)], "canon_id long, list_name string, canon_value string")
    got = lambda v, c: [(r.canon_id, r.how) for r in map_values(spark.createDataFrame([("make", v)], "list_name string, value string"), c).collect()]
    assert got("kalmorit", canon) == [(11, "cosine")]  # the least edits, and the least that one of them has beyond it
    assert got("kalmorit", canon.where("canon_id < 11")) == [(-1, "none")]  # ten entries share the best score: no margin


def test_held_out_fuels(spark):
    rows = [(want, v) for want, vs in HELD_OUT.items() for v in vs]
    canon = spark.createDataFrame([(i, "fuel_type", x) for i, x in enumerate(FUEL_WORDS)], "canon_id long, list_name string, canon_value string")
    names = dict(enumerate(FUEL_WORDS))
    df = spark.createDataFrame([("fuel_type", v) for _, v in rows], "list_name string, value string")
    got = {r.value: names.get(r.canon_id) for r in map_values(df, canon, ALIASES, ORDER).collect()}
    assert sum(got[v] == want for want, v in rows) >= 0.9 * len(rows)


def test_order_and_negation(spark):
    canon = spark.createDataFrame([(i, "fuel_type", x) for i, x in enumerate(FUEL_WORDS)], "canon_id long, list_name string, canon_value string")
    names = dict(enumerate(FUEL_WORDS))
    vals = ["hybrid diesel", "híbrido no enchufable", "diesel sin benzin", "no", "", None, "diesel diesel", "z" * 20_000]
    got = {r.value: names.get(r.canon_id) for r in map_values(spark.createDataFrame([("fuel_type", v) for v in vals], "list_name string, value string"), canon, ALIASES, ORDER).collect()}
    assert got == {"hybrid diesel": "hybrid", "híbrido no enchufable": "hybrid", "diesel sin benzin": "diesel", "no": None, "": None, "diesel diesel": "diesel", "z" * 20_000: None}
