"""Filters for a remote source: a request body, a query string, remote vocabularies, sort orders and lists of words."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.operators.filters import ListingFilter

# What two remote vocabularies call the fuels, gearboxes and sort terms.
FUEL_WORDS = {
    "words_es": {"gasoline": "Gasolina", "diesel": "Diesel", "electric": "Eléctrico", "hybrid": "Híbrido", "hybrid_gasoline": "Híbrido (Gasolina)", "hybrid_diesel": "Híbrido (Diesel)", "ethanol": "Etanol", "lpg": "Gas licuado", "cng": "Gas natural", "hydrogen": "Hidrógeno"},
    "words_en": {"gasoline": "gasoline", "diesel": "diesel", "electric": "electric", "hybrid": "hybrid", "hybrid_gasoline": "hybrid_gasoline", "hybrid_diesel": "hybrid_diesel", "lpg": "lpg", "cng": "cng"},
}
GEARBOX_WORDS = {"words_es": {"manual": "Manual", "automatic": "Automático", "semi_automatic": "Semiautomático"}, "words_en": {"manual": "manual", "automatic": "automatic", "semi_automatic": "semi_automatic"}}
# Sort orders by name: column, direction, and the remote terms.
SORTS = {
    "price_asc": ("price_eur", True, "price.asc"), "price_desc": ("price_eur", False, "price.desc"), "year_desc": ("first_registration.year", False, "year.desc"), "year_asc": ("first_registration.year", True, "year.asc"),
    "mileage_asc": ("mileage_km", True, "mileage.asc"), "mileage_desc": ("mileage_km", False, "mileage.desc"),
}
# Words by which users name fuels, gearboxes and sort orders.
FUEL_NAMES = {"gasolina": "gasoline", "gasoline": "gasoline", "diesel": "diesel", "electrico": "electric", "electric": "electric", "hibrido": "hybrid", "hybrid": "hybrid", "lpg": "lpg", "cng": "cng"}
GEARBOX_NAMES = {"manual": "manual", "automatico": "automatic", "automatic": "automatic", "semiautomatico": "semi_automatic", "semi_automatic": "semi_automatic"}
SORT_NAMES = {
    "relevancia": "relevance", "relevance": "relevance", "precio_asc": "price_asc", "price_asc": "price_asc", "precio_desc": "price_desc", "price_desc": "price_desc", "año_desc": "year_desc", "year_desc": "year_desc",
    "año_asc": "year_asc", "year_asc": "year_asc", "km_asc": "mileage_asc", "mileage_asc": "mileage_asc", "km_desc": "mileage_desc", "mileage_desc": "mileage_desc",
}
HP_PER_KW = 1.36


def remote_word(c: Column, words: Mapping[str, str]) -> Column:
    """What a remote calls a value; a value it has no word for stays as it is."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), c), c)


def parse_words(text: str | None, names: Mapping[str, str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The values that a list of words parted by commas names, and the words that name none."""
    words = [w.strip() for w in (text or "").lower().split(",") if w.strip()]
    return tuple(names[w] for w in words if w in names), tuple(w for w in words if w not in names)


def parse_sort(text: str | None) -> str:
    return SORT_NAMES.get((text or "").strip().lower(), "relevance")


def sort_listings(df: DataFrame, order: str, tie: str = "row_id") -> DataFrame:
    """The remote's order applied to a frame: nulls last, equal rows by `tie`; relevance leaves the order as it is."""
    if order == "relevance":
        return df
    column, up, _ = SORTS[order]
    c = F.col(column)
    return df.orderBy(c.asc_nulls_last() if up else c.desc_nulls_last(), tie)


def _ranges(f: ListingFilter) -> dict[str, tuple]:
    return {k: (getattr(f, f"min_{k}") or None, getattr(f, f"max_{k}") or None) for k in ("price", "year", "km", "hp")}


def request_body(f: ListingFilter, page: int = 1, size: int = 30, order: str = "relevance", makes: Mapping[str, int] | None = None, models: Mapping[tuple[str, str], int] | None = None,
                 fuels: Mapping[str, int] | None = None, gearboxes: Mapping[str, int] | None = None) -> dict:
    """The part of a filter that a JSON interface takes over. What its vocabularies lack, a version, a body or several
    gearboxes at once stays with `refine`. A bound of zero is no bound."""
    term, _, direction = ("relevance", "", "asc") if order == "relevance" else SORTS[order][2].partition(".")
    out: dict = {"pagination": {"page": page, "size": size}, "sort": {"term": term, "order": direction}, "filters": {k: {"from": None if a is None else int(a), "to": None if b is None else int(b)} for k, (a, b) in _ranges(f).items()}}
    make = (f.make or "").upper()
    if makes and make in makes:
        vehicle = {"make": make, "makeId": makes[make], "model": None, "modelId": 0}
        if f.model and models and (found := models.get((make, f.model.upper()))):
            vehicle |= {"model": f.model.upper(), "modelId": found}
        out["filters"]["vehicles"] = [vehicle]
    if ids := [fuels[x] for x in f.fuels if fuels and x in fuels]:
        out["filters"]["fuelTypeIds"] = ids
    if len(f.transmissions) == 1 and gearboxes and f.transmissions[0] in gearboxes:
        out["filters"]["transmissionTypeId"] = gearboxes[f.transmissions[0]]
    out["filters"]["sellerTypeId"] = 1 if f.dealer_only else 2 if f.private_only else 0
    return out


def query_string(f: ListingFilter, page: int = 1, makes: Mapping[str, int] | None = None, models: Mapping[tuple[str, str], int] | None = None, fuels: Mapping[str, str] | None = None,
                 gearboxes: Mapping[str, str] | None = None) -> str:
    """The part of a filter that a search address takes over: closed ranges as `low:high`, power in whole kW cut off, damaged
    vehicles always left out."""
    out: list[tuple[str, str]] = [("isSearchRequest", "true"), ("dam", "false")]
    make = (f.make or "").upper()
    if makes and make in makes:
        model = models.get((make, f.model.upper()), "") if f.model and models else ""
        out.append(("ms", f"{makes[make]};{model};"))
    for key, (lo, hi) in zip(("p", "fr", "ml", "pw"), _ranges(f).values()):
        lo, hi = [None if x is None else int(x / HP_PER_KW) if key == "pw" else int(x) for x in (lo, hi)]
        if lo or hi:
            out.append((key, f"{lo or ''}:{hi or ''}"))
    out += [("cn", f.country.upper())] if f.country else []
    out += [("ft", fuels[x]) for x in f.fuels if fuels and x in fuels] + [("tr", gearboxes[x]) for x in f.transmissions if gearboxes and x in gearboxes]
    out += [("st", "DEALER")] if f.dealer_only else [("st", "FSBO")] if f.private_only else []
    out += [("pageNumber", str(page))] if page > 1 else []
    return "&".join(f"{k}={quote(v, safe='')}" for k, v in out)
