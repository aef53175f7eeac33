"""Consistent text forms and canonical values."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lonja.llm import canon_text as C
from lonja.llm.canonical_values import ALIASES, inexact_values, map_values, normal, osa


@pytest.mark.parametrize("text,want", [
    ("Βusiness", "Business"), ("69ΡS", "69PS"), ("e-Vοlt", "e-Volt"), ("𝗲-𝗩𝗼𝗹𝘁", "e-Volt"), ("85㎾", "85kW"), ("verf﻿ügbar", "verfügbar"), ("a‑b c　d", "a-b c d"), ("ﬁn", "fin"), ("café", "café"),
    ("гаранция", "гаранция"), ("ευκαιρία ® ★", "ευκαιρία ® ★"), ("гaранция", "гаранция"), ("Ⅲ", "III"), ("", ""), (None, None), ("Ñandal ¡Sí!", "Ñandal ¡Sí!"), ("й", "й"),
])
def test_forms(text, want):
    assert C.canonical(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_form_is_stable_and_normal(text):
    once = C.canonical(text)
    assert C.canonical(once) == once and unicodedata.is_normalized("NFKC", once)


def test_sequences_are_keys_of_the_one_table():
    t = C.transducer()
    assert t.apply("e\u0301") == "é" and t.apply("e\u200d\u0301") == "é" and t.apply("a\u0323\u0302") == t.apply("a\u0302\u0323") == "ậ"
    assert t.apply("c\u0323\u0327") == unicodedata.normalize("NFKC", "c\u0323\u0327")  # a mark reaches its letter over another
    assert t.apply("ﾊﾟ") == "パ" and t.apply("한") == "한"
    assert t.apply("а\u0301", "Latin") == "á" and t.apply("а\u0301") == "а\u0301"  # a look-alike only in the context of its word


PIECES = st.sampled_from([*"aeoANcqåâệｶﾊカбгМіωΑ①½ﬁᄀ각 -9", "ᅡ", "ᆨ", "ﾞ", "\u3099", *map(chr, (0x200D, 0x200B, 0xAD, 0xFE0F, 0x3000, 0x2011, 0x300, 0x301, 0x302, 0x323, 0x327, 0x328, 0x338, 0x345, 0x5B4))])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=7).map("".join))
def test_clusters_are_normal_without_a_normaliser(text):
    once = C.canonical(text)
    assert C.canonical(once) == once and unicodedata.is_normalized("NFKC", once)


def test_conflicts_are_found():
    with pytest.raises(C.ConflictError):
        C.Transducer({"a": "b", "b": "c"})
    with pytest.raises(C.ConflictError):
        C._put({"a": "b"}, "a", "c")
    t = C.Transducer({"ab": "x", "a": "y"})
    assert t.apply("aba") == "xy"


def test_fields(spark):
    df = spark.createDataFrame([(1, "plain", "Ｍ", 9), (2, None, None, 9), (3, "", "x" * 200_000 + "​", 9), (1, "plain", "Ｍ", 9)], "row_id long, title string, model string, changed int")
    assert sorted(tuple(r) for r in C.changed_fields(df, ["title", "model"]).collect()) == [(1, "model"), (1, "model"), (3, "model")]
    forms = {(r.row_id, r.field): (r.form, r.changed) for r in C.consistent_fields(df, ["title", "model"]).collect()}
    assert forms[1, "model"] == ("M", True) and forms[3, "title"] == ("", False) and (2, "title") not in forms and len(forms[3, "model"][0]) == 200_000
    assert C.changed_fields(df.limit(0), ["title"]).count() == 0


def test_edit_distance():
    assert [osa("contigo", "tontiog"), osa("", "ab"), osa("ab", "ba"), osa("abc", "abc")] == [2, 2, 1, 0]
    assert normal("Marke: Ｓøｒbу (D)") == "sorby" and normal("x / EU") == "x" and normal("???") == ""


def test_values(spark):
    canon = spark.createDataFrame([(1, "make", "Veltora"), (2, "make", "Veldara"), (3, "make", "Casa Lorente"), (4, "make", "Plößner"), (5, "make", "QRV"), (101, "fuel_type", "gasoline"), (105, "fuel_type", "phev")], "canon_id long, list_name string, canon_value string")
    vals = ["VELTORA", "Vetlora", "Veldra", "CL", "Casa Lorentee", "Plossner", "QR​V", "Oldtimer", "n/a", "-", "", None, "Marke: Veldara", "Veltora", "y" * 50_000]
    df = spark.createDataFrame([("make", v) for v in vals + ["Vetlora"]] + [("fuel_type", "Plugin Hybrid"), ("fuel_type", "Benzn"), ("fuel_type", "Dampf")], "list_name string, value string")
    got = {(r.list_name, r.value): r.canon_id for r in map_values(df, canon, ALIASES).collect()}
    want = {"VELTORA": 1, "Vetlora": 1, "Veldra": 2, "CL": 3, "Casa Lorentee": 3, "Plossner": 4, "QR​V": 5, "Oldtimer": -1, "n/a": -1, "-": -1, "": -1, "Marke: Veldara": 2, "Veltora": 1, "y" * 50_000: -1}
    assert {k[1]: v for k, v in got.items() if k[0] == "make"} == want
    assert got["fuel_type", "Plugin Hybrid"] == 105 and got["fuel_type", "Benzn"] == 101 and got["fuel_type", "Dampf"] == -1
    rows = spark.createDataFrame([("make", "make", i, v) for i, v in enumerate(["VELTORA", "PLÖSSNER", "Vetlora", None, "Otros"])], "field string, list_name string, row_id long, value string")
    assert {(r.row_id, r.canon_id) for r in inexact_values(rows, canon).collect()} == {(2, 1), (4, -1)}
    assert map_values(df.limit(0), canon).count() == 0
