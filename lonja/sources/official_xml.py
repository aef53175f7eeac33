"""The annual official order as tables: values by brand, generic bands, depreciation, and the version's metadata."""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import re
import unicodedata
import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Headings of the order that open a category, folded.
HEADINGS = [("autocaravanas", "motorhome"), ("motocicletas electricos", "electric_motorcycle"), ("motor de combustion", "combustion_motorcycle"), ("quads", "quad"), ("buggys", "buggy")]
# The categories of the two depreciation tables in their order.
WEAR = ["conventional_vehicle", "motorhome"]
VALUES = "category string, brand string, model_type string, commercial_start int, commercial_end int, displacement_cc int, cylinders int, fuel_code string, power_kw int, fiscal_hp double, power_cv int, value_eur int"


class OrderError(ValueError):
    """The document lacks a part it must have."""


@dataclass
class Order:
    meta: dict
    values: list[tuple]
    bands: list[tuple]
    depreciation: list[tuple]

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {
            "versions": spark.createDataFrame([tuple(self.meta.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in self.meta.items())),
            "values": spark.createDataFrame(self.values, VALUES),
            "bands": spark.createDataFrame(self.bands, "category string, criterion string, value_eur int, ordinal int"),
            "depreciation": spark.createDataFrame(self.depreciation, "category string, usage string, percentage int, ordinal int"),
        }


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def _text(e: ET.Element | None) -> str:
    return "" if e is None else " ".join("".join(e.itertext()).split())


def _int(s: str, needed: bool = True) -> int | None:
    d = s.strip().replace(".", "")
    if not d and not needed:
        return None
    if not re.fullmatch(r"[+-]?\d+", d):
        raise OrderError(f"no whole number: {s!r}")
    return int(d)


def _dec(s: str) -> float | None:
    d = s.strip().replace(".", "").replace(",", ".")
    if not d:
        return None
    if not re.fullmatch(r"[+-]?\d+(\.\d*)?", d):
        raise OrderError(f"no number: {s!r}")
    return float(d)


def _day(s: str) -> str:
    try:
        return dt.date(int(s[:4]), int(s[4:6]), int(s[6:8])).isoformat()
    except ValueError as e:
        raise OrderError(f"no date: {s!r}") from e


def _cells(table: ET.Element, width: int, what: str) -> list[list[str]]:
    rows = [[_text(c) for c in tr.findall("td")] for tr in table.findall("./tbody/tr")]
    for i, r in enumerate(rows):
        if len(r) != width:
            raise OrderError(f"row {i + 1} of {what} has {len(r)} cells, not {width}")
    return rows


def _value(category: str, brand: str, r: list[str]) -> tuple:
    opt = lambda x: _int(x, False)
    return (category, brand, r[0], opt(r[1]), opt(r[2]), opt(r[3]), opt(r[4]), r[5], opt(r[6]), _dec(r[7]), _int(r[8]), _int(r[9]))


def parse_order(xml: bytes | str, source_url: str = "") -> Order:
    """One yearly document, read on the driver: a table's category depends on the heading before it, so order matters. A
    document without one of its annexes, metadata, tables or the note after them, and a row of a wrong width, raise."""
    raw = xml.encode() if isinstance(xml, str) else xml
    try:
        root = ET.fromstring(raw)
    except ET.ParseError as e:
        raise OrderError("no XML") from e
    body = root.find("texto")
    if root.tag != "documento" or body is None:
        raise OrderError("no text")
    parts = _annexes(list(body))
    if missing := {"I", "II", "IV"} - parts.keys():
        raise OrderError(f"annexes are missing: {sorted(missing)}")
    meta = {k: _text(root.find(f"metadatos/{tag}")) for k, tag in (("boe_id", "identificador"), ("order_code", "numero_oficial"), ("publication_date", "fecha_publicacion"), ("effective_date", "fecha_vigencia"))}
    if gaps := [k for k, v in meta.items() if not v]:
        raise OrderError(f"metadata are missing: {gaps}")
    meta |= {k: _day(meta[k]) for k in ("publication_date", "effective_date")}
    values, bands = _annex_one(parts["I"])
    wear, note = _annex_four(parts["IV"])
    meta |= {"exercise": _exercise(parts["I"]), "source_url": source_url, "sha256": hashlib.sha256(raw).hexdigest(), "depreciation_note": note, "vehicle_count": len(values), "band_count": len(bands), "depreciation_count": len(wear)}
    return Order(meta, values, bands, wear)


def _annexes(children: list[ET.Element]) -> dict[str, list[ET.Element]]:
    """The elements of each annex by its numeral."""
    out: dict[str, list[ET.Element]] = {}
    now: list[ET.Element] = []
    for e in children:
        if e.tag == "p" and (m := re.fullmatch(r"ANEXO ([IVX]+)", _text(e))):
            now = out[m[1]] = []
        else:
            now.append(e)
    return out


def _exercise(annex: list[ET.Element]) -> int:
    for e in itertools.takewhile(lambda e: e.tag != "table", annex):
        if m := re.search(r"Valores para el ejercicio\s+(\d{4})", _text(e)):
            return int(m[1])
    raise OrderError("no exercise")


def _annex_one(annex: list[ET.Element]) -> tuple[list[tuple], list[tuple]]:
    values, bands, category = [], [], "passenger_vehicle"
    for e in annex:
        if e.tag == "p" and e.get("class") == "centro_negrita":
            folded = _fold(_text(e))
            category = next((c for words, c in HEADINGS if words in folded), category)
        elif e.tag == "table":
            brand = re.search(r"Marca:\s*(.+?)\s+Modelo-Tipo", _text(e.find("thead")) if e.find("thead") is not None else "")
            if brand:
                values += [_value(category, brand[1].strip(), r) for r in _cells(e, 10, brand[1])]
            elif category not in ("passenger_vehicle", "motorhome"):
                bands += [(category, r[0], _int(r[1]), i) for i, r in enumerate(_cells(e, 2, category))]
    if not values or not bands:
        raise OrderError("values or bands are missing")
    return values, bands


def _annex_four(annex: list[ET.Element]) -> tuple[list[tuple], str]:
    tables = [i for i, e in enumerate(annex) if e.tag == "table"]
    if len(tables) != len(WEAR):
        raise OrderError(f"{len(tables)} depreciation tables")
    wear = [(kind, r[0], _int(r[1]), n) for kind, i in zip(WEAR, tables) for n, r in enumerate(_cells(annex[i], 2, kind))]
    notes = [t for e in annex[tables[-1] + 1 :] if e.tag == "p" and (t := _text(e))]
    if not wear or not notes:
        raise OrderError("depreciation or its note is missing")
    return wear, notes[-1]
