"""Units as exponent vectors with scale and offset, a small grammar for quantities, and its native column form.

A unit is (exponents over the base dimensions, scale, offset): canonical value = figure * scale + offset. Products,
quotients, integer powers and decimal prefixes are parsed by `parse_unit`; offset units may only stand alone. A currency is
a unit of money whose scale is a rate known only with the row. `convert` is the one place where figures change units.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = ("length", "mass", "time", "temperature", "money")


@dataclass(frozen=True)
class Unit:
    dim: tuple[int, ...]
    scale: float
    offset: float = 0.0
    rate: str | None = None  # the currency whose rate multiplies the scale

    def __mul__(self, other: "Unit") -> "Unit":
        if self.offset or other.offset:
            raise ValueError("a unit with an offset cannot be part of a product")
        if self.rate and other.rate:
            raise ValueError("a product of two currencies")
        return Unit(tuple(a + b for a, b in zip(self.dim, other.dim)), self.scale * other.scale, 0.0, self.rate or other.rate)

    def __pow__(self, n: int) -> "Unit":
        if (self.offset or self.rate) and n != 1:
            raise ValueError("a unit with an offset or a rate cannot be raised to a power")
        return replace(self, dim=tuple(a * n for a in self.dim), scale=self.scale**n)

    def to(self, other: "Unit", figure: float) -> float:
        if self.dim != other.dim or self.rate != other.rate:
            raise ValueError("the dimensions differ")
        return (figure * self.scale + self.offset - other.offset) / other.scale


def _d(**exp: int) -> tuple[int, ...]:
    return tuple(exp.get(b, 0) for b in BASE)


POWER, MONEY = _d(length=2, mass=1, time=-3), _d(money=1)

# Unit symbols of the SI and of trade, with their scale to the SI base units and their offset.
ATOMS: dict[str, Unit] = {
    "m": Unit(_d(length=1), 1.0), "g": Unit(_d(mass=1), 1e-3), "s": Unit(_d(time=1), 1.0), "K": Unit(_d(temperature=1), 1.0),
    "W": Unit(POWER, 1.0), "J": Unit(_d(length=2, mass=1, time=-2), 1.0), "N": Unit(_d(length=1, mass=1, time=-2), 1.0),
    "h": Unit(_d(time=1), 3600.0), "min": Unit(_d(time=1), 60.0), "l": Unit(_d(length=3), 1e-3), "t": Unit(_d(mass=1), 1000.0),
    "°C": Unit(_d(temperature=1), 1.0, 273.15), "°F": Unit(_d(temperature=1), 5 / 9, 459.67 * 5 / 9),
    "PS": Unit(POWER, 735.49875), "bhp": Unit(POWER, 745.69987), "EUR": Unit(MONEY, 1.0), "mi": Unit(_d(length=1), 1609.344),
}
# Currencies beside the euro; ISO 4217.
ATOMS |= {c: Unit(MONEY, 1.0, 0.0, c.lower()) for c in ("CHF", "PLN", "CZK", "GBP", "SEK", "DKK", "NOK")}
PREFIX = {"": 1.0, "k": 1e3, "M": 1e6, "m": 1e-3, "c": 1e-2, "µ": 1e-6, "d": 1e-1, "h": 1e2}

# Spellings of units in listings, in lower case, and the unit expression each stands for.
POWER_WORDS = {
    "kw": "kW", "kilowatt": "kW", "kilovatios": "kW", "ps": "PS", "pferdestärken": "PS", "cv": "PS", "caballos": "PS", "ch": "PS",
    "km": "PS", "hk": "PS", "pk": "PS", "hp": "PS", "bhp": "bhp", "brake hp": "bhp", "watt": "W", "w": "W",
}
# Spellings of currencies in lower case. `kr` alone is the krona or krone of the row's country.
MONEY_WORDS = {
    "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "chf": "CHF", "sfr": "CHF", "fr": "CHF", "zł": "PLN", "zl": "PLN", "pln": "PLN",
    "plz": "PLN", "kč": "CZK", "kc": "CZK", "czk": "CZK", "£": "GBP", "gbp": "GBP", "pfund": "GBP", "sek": "SEK", "skr": "SEK", "nok": "NOK",
    "nkr": "NOK", "dkk": "DKK", "dkr": "DKK", "kr": "kr",
}
# The currency of each country.
COUNTRY_MONEY = {"DE": "EUR", "AT": "EUR", "ES": "EUR", "FR": "EUR", "CH": "CHF", "PL": "PLN", "CZ": "CZK", "GB": "GBP", "SE": "SEK", "DK": "DKK", "NO": "NOK"}
# Words that scale a price, and the decimal prefix each stands for.
SCALE_WORDS = {"tsd": "k", "mil": "k", "k": "k", "cent": "c", "ct": "c"}
# The unit expressions of the codes of measure_units; a code is otherwise its quantity's unit times its factor.
CODE_UNITS = {"kw": "kW", "ps": "PS", "bhp": "bhp", "w": "W", "eur": "EUR", "eur_k": "kEUR", "eur_cent": "cEUR"}
CANONICAL = {"power": "kW", "price": "EUR"}


def parse_unit(text: str) -> Unit:
    """Unit expression: factor (('*' | '·' | '/' | ' ') factor)*, factor = prefix? symbol ('^'? integer)?"""
    out, sign = Unit(_d(), 1.0), 1
    parts = re.findall(r"[*·/]|\s+|[^\s*·/]+", text.strip())
    if not parts:
        raise ValueError("an empty unit")
    for part in parts:
        if part.isspace() or part in "*·":
            continue
        if part == "/":
            sign = -1
            continue
        part = part.replace("²", "2").replace("³", "3")
        m = re.fullmatch(r"([^\d^-]+?)\^?(-?\d+)?", part)
        if not m:
            raise ValueError(f"no unit: {part}")
        name, power = m[1], sign * int(m[2] or 1)
        sign = 1
        if name in ATOMS:
            unit = ATOMS[name]
        else:
            pre = next((p for p in PREFIX if p and name.startswith(p) and name[len(p):] in ATOMS), None)
            if pre is None:
                raise ValueError(f"no unit: {part}")
            unit = ATOMS[name[len(pre):]]
            unit = replace(unit, scale=unit.scale * PREFIX[pre])
        out = unit**power if len([p for p in parts if not p.isspace()]) == 1 else out * unit**power
    return out


def code_unit(code: str, quantity: str, factor: float | None) -> Unit:
    """The unit of a row of measure_units. Its expression is parsed where the grammar knows the code; else it is the
    quantity's canonical unit times the factor. Raises where the dimension is not the quantity's, or where the factor
    contradicts the expression by more than a tenth of a per cent."""
    base = parse_unit(CANONICAL[quantity])
    if code in CODE_UNITS or code.upper() in ATOMS:
        unit = parse_unit(CODE_UNITS.get(code, code.upper()))
    elif factor is None:
        raise ValueError(f"a unit without expression or factor: {code}")
    else:
        unit = replace(base, scale=base.scale * factor)
    if unit.dim != base.dim:
        raise ValueError(f"{code} does not measure {quantity}")
    if factor is not None and abs(unit.scale / base.scale / factor - 1) > 1e-3:
        raise ValueError(f"the factor of {code} is not that of its unit")
    return unit


def convert(c: Column, unit: Unit, to: Unit, rates: Column | None = None) -> Column:
    """A figure in another unit: scale, offset and, for a currency, the rate of the row's map `rates`. Null without a rate.
    Raises where the dimensions differ."""
    if unit.dim != to.dim:
        raise ValueError("the dimensions differ")
    if to.rate:
        raise ValueError("figures are not converted into a currency with a rate")
    value = c * F.lit(unit.scale / to.scale)
    if unit.offset or to.offset:
        value = value + F.lit((unit.offset - to.offset) / to.scale)
    return value * F.try_element_at(rates, F.lit(unit.rate)) if unit.rate else value


def convert_by_code(c: Column, code: Column, units: dict[str, Unit], to: Unit, rates: Column | None = None) -> Column:
    """The same where each row names its unit; null for a code that is not among `units`."""
    return F.coalesce(*[F.when(code == k, convert(c, u, to, rates)) for k, u in units.items()], F.lit(None).cast("double"))


def literal_map(d: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


#: A figure: digits with group marks (blank, apostrophe, dot, comma) and an optional decimal part.
FIGURE = r"\d+(?:[.,'’]\d+| \d{3}(?!\d))*"
#: In running text a blank parts two figures ("1.2 55 kW"), so a power figure has no blank in it.
POWER_FIGURE = r"\d+(?:[.,'’]\d+)*"


def figure(c: Column, decimal_comma_only: Column | None = None) -> Column:
    """The number a figure denotes. A last mark before one or two digits, or before any digits where
    `decimal_comma_only` holds (a scale word follows), is the decimal mark; all other marks group digits."""
    tight = F.regexp_replace(c, r"[ '’]", "")
    dec = F.regexp_extract(tight, r"[.,](\d{1,2})$", 1)
    if decimal_comma_only is not None:
        dec = F.when(decimal_comma_only, F.regexp_extract(tight, r"[.,](\d+)$", 1)).otherwise(dec)
    head = F.when(dec != "", F.regexp_replace(tight, r"[.,]\d+$", "")).otherwise(tight)
    number = F.concat(F.regexp_replace(head, "[.,]", ""), F.lit("."), F.when(dec != "", dec).otherwise(F.lit("0")))
    return F.when(tight != "", number).try_cast("double")


def _alternatives(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def spelt(words: dict[str, str], units: dict[str, Unit]) -> dict[str, str]:
    """word -> code of the unit that the word's expression denotes; words of a unit that no code has are left out."""
    by_unit = {(u.dim, round(u.scale, 6), u.offset, u.rate): code for code, u in reversed(units.items())}
    out = {}
    for w, expression in words.items():
        u = parse_unit(expression)
        if (code := by_unit.get((u.dim, round(u.scale, 6), u.offset, u.rate))) is not None:
            out[w] = code
    return out


def first_power(c: Column, units: dict[str, Unit]) -> Column:
    """struct<value, unit> of the first power quantity in a text; unit is a code of `units`, null where there is none."""
    words = spelt(POWER_WORDS, units)
    pat = rf"(?iu)(?<![\p{{L}}\p{{N}}.,])({POWER_FIGURE})\s*({_alternatives(words)})(?![\p{{L}}\p{{N}}])"
    unit = F.lower(F.regexp_extract(c, pat, 2))
    return F.struct(figure(F.regexp_extract(c, pat, 1)).alias("value"), literal_map(words)[F.when(unit != "", unit)].alias("unit"))


def price_units(units: dict[str, Unit]) -> dict[str, Unit]:
    """The units of `units` and those a scale word makes of a currency that has no code of its own, as `chf_k`."""
    out = dict(units)
    for code, u in units.items():
        if u.scale == 1.0:
            for suffix, prefix in (("_k", "k"), ("_cent", "c")):
                out.setdefault(code + suffix, replace(u, scale=u.scale * PREFIX[prefix]))
    return out


def first_price(c: Column, country: Column) -> Column:
    """struct<value, unit> of the price in a text: a currency before or after a figure, with a scale word between."""
    low = F.lower(c)
    num = F.regexp_extract(low, rf"({FIGURE})", 1)
    scale = F.regexp_extract(low, r"\d[\s]*(" + "|".join(SCALE_WORDS) + r")(?![\p{L}])", 1)
    money = F.regexp_extract(low, rf"(?<![\p{{L}}])({_alternatives(MONEY_WORDS)})(?![\p{{L}}])", 1)
    code = literal_map(MONEY_WORDS)[F.when(money != "", money)]
    code = F.lower(F.when(code == "kr", literal_map(COUNTRY_MONEY)[country]).otherwise(code))
    prefix = literal_map(SCALE_WORDS)[F.when(scale != "", scale)]
    unit = F.concat(code, F.coalesce(literal_map({"k": "_k", "c": "_cent"})[prefix], F.lit("")))
    return F.struct(figure(num, scale != "").alias("value"), F.when(num != "", unit).alias("unit"))
