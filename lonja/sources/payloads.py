"""Semi-structured payloads as listing rows: embedded framework chunks, JSON after a marker, JSON-LD, localised numbers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTING_SCHEMA = T.StructType([
    T.StructField("listing_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("version", T.StringType()), T.StructField("make", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("price_eur", T.DoubleType()), T.StructField("price_net_eur", T.DoubleType()), T.StructField("mileage_km", T.IntegerType()),
    T.StructField("first_registration", T.StructType([T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])),
    T.StructField("fuel_type", T.StringType()), T.StructField("transmission", T.StringType()), T.StructField("power_kw", T.IntegerType()), T.StructField("power_hp", T.IntegerType()),
    T.StructField("engine_displacement_cc", T.IntegerType()), T.StructField("country_code", T.StringType()), T.StructField("city", T.StringType()), T.StructField("seller_type", T.StringType()),
])
_ITEM = "struct<id:string,shortTitle:string,subTitle:string,make:struct<localized:string>,model:struct<localized:string>,attr:map<string,string>,contact:struct<enumType:string>,price:struct<grs:struct<amount:double>,net:struct<amount:double>>>"


def localized_integer(c: Column) -> Column:
    """`1.368` or `82.500 km` as a whole number: the first figure with its group marks."""
    return F.regexp_replace(F.regexp_extract(c, r"(\d[\d.\s ']*)", 1), r"\D", "").try_cast("int")


def localized_decimal(c: Column) -> Column:
    """`10,61` or `1.234,5` as a number with a decimal comma."""
    return F.replace(F.replace(F.regexp_extract(c, r"(\d[\d.]*(?:,\d+)?)", 1), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def registration(c: Column) -> Column:
    """`03/2020`, `2020-03` or a bare year as struct<year, month>; null where there is no year."""
    y = F.regexp_extract(c, r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)", 1).try_cast("int")
    m = F.coalesce(F.regexp_extract(c, r"^\s*(\d{1,2})[/.](?:19|20)\d{2}", 1).try_cast("int"), F.regexp_extract(c, r"(?:19|20)\d{2}-(\d{1,2})", 1).try_cast("int"))
    return F.when(y.isNotNull(), F.struct(y.alias("year"), F.when(m.between(1, 12), m).alias("month")))


def litres_to_cc(c: Column, fuel: Column | None = None) -> Column:
    """`2.0 TDI` as 2000; a figure outside half a litre to nine is none, and an electric vehicle has none."""
    v = F.replace(F.regexp_extract(c, r"(?:^|[^\d.,])(\d[.,]\d)(?![\d.,]|\s*(?:kw|kwh|km))", 1), F.lit(","), F.lit(".")).try_cast("double")
    electric = F.lit(False) if fuel is None else F.coalesce(F.lower(fuel).rlike("^(?:elec|elek|eléc|élec)"), F.lit(False))
    return F.when(v.between(0.5, 9.0) & ~electric, F.round(v * 1000).cast("int"))


def framework_chunks(html: Column) -> Column:
    """The texts pushed as `self.__next_f.push([1,"..."])`, decoded and joined."""
    raw = F.regexp_extract_all(html, F.lit(r'self\.__next_f\.push\(\[1,("(?:[^"\\]|\\.)*")\]\)'), F.lit(1))
    return F.array_join(F.transform(raw, lambda x: F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v")), "")


def json_after(text: str | None, marker: str) -> list[str]:
    """The JSON values that follow each occurrence of a marker; what does not parse is passed over."""
    out, at, dec = [], 0, json.JSONDecoder()
    while text and (at := text.find(marker, at)) >= 0:
        at += len(marker)
        while at < len(text) and text[at].isspace():
            at += 1
        try:
            value, end = dec.raw_decode(text, at)
        except ValueError:
            continue
        out.append(json.dumps(value, ensure_ascii=False))
        at = end
    return out


def json_after_marker(c: Column, marker: str) -> Column:
    """array<string> of the JSON after a marker; where a value ends is not regular, so this leaves the JVM."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([json_after(x, marker) for x in s])

    return run(c)


def summary_listings(pages: DataFrame, html: str = "html") -> DataFrame:
    """Listings of embedded search results. A page without results and a malformed item give no row."""
    found = pages.select(F.explode(json_after_marker(framework_chunks(F.col(html)), '"searchResults":')).alias("j"))
    raw = found.select(F.explode(F.from_json(F.get_json_object("j", "$.listings"), "array<string>")).alias("r"))
    items = raw.select(F.from_json("r", _ITEM).alias("x")).where("x.id is not null")
    a = lambda k: F.col("x.attr")[k]
    power = lambda unit: F.regexp_extract(F.lower(a("pw")), rf"(\d+)\s*{unit}", 1).try_cast("int")
    return items.select(
        F.col("x.id").alias("listing_id"), F.col("x.shortTitle").alias("title"), F.col("x.subTitle").alias("version"), F.col("x.make.localized").alias("make"), F.col("x.model.localized").alias("model"),
        F.col("x.price.grs.amount").alias("price_eur"), F.col("x.price.net.amount").alias("price_net_eur"), localized_integer(a("ml")).alias("mileage_km"), registration(a("fr")).alias("first_registration"),
        a("ft").alias("fuel_type"), a("tr").alias("transmission"), power("kw").alias("power_kw"), power("(?:cv|ps|hp)").alias("power_hp"), localized_integer(a("cc")).alias("engine_displacement_cc"),
        a("cn").alias("country_code"), a("loc").alias("city"), F.lower("x.contact.enumType").alias("seller_type"),
    )


def result_total(pages: DataFrame, html: str = "html") -> DataFrame:
    """total and has_next of each page of results."""
    t = framework_chunks(F.col(html))
    return pages.select("*", F.regexp_extract(t, r'"numResultsTotal":\s*(\d+)', 1).try_cast("long").alias("total"), F.coalesce(F.regexp_extract(t, r'"hasNextPage":\s*(true|false)', 1) == "true", F.lit(False)).alias("has_next"))


def linked_ids(html: Column) -> Column:
    """Ids in anchors, in order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="[^"]*[?&]id=(\d+)'), F.lit(1)))


def tag_values(json_text: Column) -> Column:
    """[{tag, value}, ...] as a map; the last value of a repeated tag wins."""
    entries = F.from_json(json_text, "array<struct<tag:string,value:string>>")
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x.tag), F.create_map(x.tag, x.value)))


def _walk(v) -> Iterator[dict]:
    stack = [v]
    while stack:
        x = stack.pop(0)
        if isinstance(x, dict):
            yield x
            stack += x.values()
        elif isinstance(x, list):
            stack += x


_KINDS = {"vehicle", "car", "product"}


def jsonld_vehicle(html: str | None) -> dict | None:
    """The first vehicle object in the page's JSON-LD scripts, by breadth."""
    for m in re.finditer(r'<script[^>]*application/ld\+json[^>]*>(.*?)</script>', html or "", re.S | re.I):
        try:
            data = json.loads(m[1])
        except ValueError:
            continue
        for obj in _walk(data):
            kinds = obj.get("@type")
            if {str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])} & _KINDS:
                return obj
    return None


def _name(v) -> str | None:
    return v.get("name") if isinstance(v, dict) else v if isinstance(v, str) else None


def jsonld_listings(pages: DataFrame, html: str = "html") -> DataFrame:
    """One listing for each page with a JSON-LD vehicle; pages without one give no row."""
    schema = "title string, make string, model string, price_raw string, mileage string, registered string, fuel_type string, cc string, power string, power_unit string, seller string, body string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        val = lambda v: None if v is None else str(v.get("value")) if isinstance(v, dict) else str(v)
        for pdf in batches:
            out = []
            for page in pdf[html]:
                if (o := jsonld_vehicle(page)) is None:
                    continue
                engine, offer = o.get("vehicleEngine") or {}, o.get("offers") or {}
                offer = offer[0] if isinstance(offer, list) and offer else offer
                power = engine.get("enginePower") if isinstance(engine, dict) else None
                out.append((o.get("name"), _name(o.get("brand")), _name(o.get("model")), val(offer.get("price")), val(o.get("mileageFromOdometer")), val(o.get("dateVehicleFirstRegistered")), val(o.get("fuelType")),
                            val(engine.get("engineDisplacement")) if isinstance(engine, dict) else None, val(power), power.get("unitCode") if isinstance(power, dict) else None, (offer.get("seller") or {}).get("@type"), re.sub(r"<script.*?</script>|<[^>]+>", " ", page, flags=re.S)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    d = pages.select(html).mapInPandas(run, schema)
    return d.select(
        "title", "make", "model", localized_integer(F.col("price_raw")).cast("double").alias("price_eur"), localized_integer(F.col("mileage")).alias("mileage_km"), registration(F.col("registered")).alias("first_registration"), "fuel_type",
        localized_integer(F.col("cc")).alias("engine_displacement_cc"), F.when(F.coalesce("power_unit", F.lit("KWT")) == "KWT", F.col("power").try_cast("int")).alias("power_kw"),
        F.regexp_extract("body", r"CO[₂2]\s*(\d+)", 1).try_cast("int").alias("co2_emissions_g_km"), F.coalesce(F.col("body").rlike("(?i)mwst\\.? ausweisbar|iva deducible"), F.lit(False)).alias("vat_deductible"),
        F.when(F.col("seller") == "Person", "private").when(F.col("seller").isNotNull(), "dealer").otherwise("unknown").alias("seller_type"),
    )


def script_listings(pages: DataFrame, html: str = "html") -> DataFrame:
    """Items of the page state script (`__NEXT_DATA__`), projected by schema in the JVM."""
    body = F.regexp_extract(html, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    item = "struct<id:string,price:struct<priceFormatted:string>,url:string,vehicle:struct<make:string,model:string,modelVersionInput:string,fuel:string,transmission:string,mileageInKm:string>,vehicleDetails:array<struct<data:string,iconName:string>>>"
    x = pages.select(F.explode(F.from_json(F.get_json_object(body, "$.props.pageProps.listings"), f"array<{item}>")).alias("x"))
    # the first detail under one of the icons that holds a power: the icon of the speedometer also stands by the mileage
    power = F.filter("x.vehicleDetails", lambda d: d.iconName.isin("speedometer", "power") & d.data.rlike(r"\d\s*kW"))
    kw = F.regexp_extract(F.try_element_at(power, F.lit(1)).data, r"(\d+)\s*kW", 1).try_cast("int")
    return x.select(
        F.col("x.id").alias("listing_id"), F.col("x.vehicle.make").alias("make"), F.col("x.vehicle.model").alias("model"), F.col("x.vehicle.modelVersionInput").alias("version"), F.col("x.vehicle.fuel").alias("fuel_type"),
        F.col("x.vehicle.transmission").alias("transmission"), localized_integer(F.col("x.vehicle.mileageInKm")).alias("mileage_km"), localized_integer(F.col("x.price.priceFormatted")).cast("double").alias("price_eur"),
        kw.alias("power_kw"), litres_to_cc(F.col("x.vehicle.modelVersionInput"), F.col("x.vehicle.fuel")).alias("engine_displacement_cc"),
    )


_KWH_FIGURE = re.compile(r"(?<![\d.,])\d{1,3}(?:[.,]\d\d?)?(?=\s*kwh\b)", re.I)
_BARE_FIGURE = re.compile(r"\d+(?:[.,]\d+)?")
# Keys under which a battery's capacity is declared, letters only, lower case; and what a battery can hold.
_CAPACITY_KEYS = {"batterycapacity", "batterycapacityinkwh", "batterycapacitykwh", "usablebatterycapacity"}
_LEAST_KWH, _MOST_KWH = 1, 250


def _capacity_texts(payload) -> Iterator[tuple[bool, str]]:
    """(declared, text) of every value of nested JSON: of an object what its keys declare, then all it holds, depth first."""
    stack: list[tuple[bool, object]] = [(False, payload)]
    while stack:
        declared, node = stack.pop()
        if declared or not isinstance(node, dict | list):
            yield declared, "" if node is None else str(node)
            continue
        below = [(False, v) for v in (node.values() if isinstance(node, dict) else node)]
        named = [(True, v) for k, v in node.items() if re.sub("[^a-z]", "", str(k).lower()) in _CAPACITY_KEYS] if isinstance(node, dict) else []
        stack += reversed(named + below)


def battery_kwh(payload) -> float | None:
    """The first sound capacity in nested JSON. A text needs its unit, except under a key that declares a capacity."""
    for declared, text in _capacity_texts(payload):
        m = _KWH_FIGURE.search(text) or (_BARE_FIGURE.fullmatch(text.strip()) if declared else None)
        if m and _LEAST_KWH <= (kwh := float(m[0].replace(",", "."))) <= _MOST_KWH:
            return round(kwh, 2)
    return None


@F.pandas_udf(T.DoubleType())
def battery_capacity(s: pd.Series) -> pd.Series:
    """Battery capacity of JSON texts; null for null, empty or malformed ones."""

    def one(t):
        try:
            return battery_kwh(json.loads(t)) if t else None
        except ValueError:
            return None

    return pd.Series([one(t) for t in s], dtype="float64")


def image_urls(json_text: Column, most: int = 8) -> Column:
    """The first distinct image addresses anywhere in a JSON text: those that say they are one, by word or by ending."""
    url = r"https?://[^\s\"\\\\]+"
    by_word = rf'"({url})"'
    found = F.regexp_extract_all(json_text, F.lit(by_word), F.lit(1))
    tells = F.filter(found, lambda u: F.lower(u).rlike("image|photo|jpg|jpeg|png|webp"))
    return F.slice(F.array_distinct(tells), 1, most)


def route_url(url: Column, hosts: dict[str, str]) -> Column:
    """struct<source, listing_id> of an address: only https, only the hosts allowed (each with its source), and an id of
    digits in the query or before `.html`, or a UUID at the end; null for all others."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    source = F.try_element_at(F.create_map(*[F.lit(x) for kv in hosts.items() for x in kv]), host)
    asked = F.try_parse_url(url, F.lit("QUERY"), F.lit("id"))
    path = F.try_parse_url(url, F.lit("PATH"))
    ends = F.coalesce(F.nullif(F.regexp_extract(path, r"/(\d+)\.html$", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})/?$", 1), F.lit("")))
    lid = F.coalesce(F.when(asked.rlike(r"^\d+$"), asked), ends)
    return F.when((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & source.isNotNull() & lid.isNotNull(), F.struct(source.alias("source"), lid.alias("listing_id")))
