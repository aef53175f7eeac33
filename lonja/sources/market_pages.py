"""Marketplace payloads: result pages of a JSON interface, detail pages (embedded object or markup), claims in attributes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.operators.filters import ListingFilter
from lonja.sources.payloads import framework_chunks, image_urls, localized_integer, registration, tag_values

# Gearbox ids of the JSON interface, and the horsepower it counts to a kW.
GEARBOX_IDS = {1: "automatic", 2: "manual", 3: "semi_automatic"}
HP_PER_KW_TRUNCATED = 1.36
_ITEM = """struct<id:string,url:string,title:string,make:string,model:string,price:struct<amount:double>,year:int,km:int,hp:int,fuelType:string,cubicCapacity:int,transmissionTypeId:int,
location:struct<regionLiteral:string,mainProvince:string,cityLiteral:string>,seller:struct<name:string,isProfessional:boolean>,phone:string,creationDate:string,publishedDate:string>"""


def interface_listings(pages: DataFrame, body: str = "body", source: str = "market_b", base_url: str = "", country: str = "ES") -> DataFrame:
    """Listings of result pages of the JSON interface, projected by schema in the JVM, with `total` and `has_next` of their page.

    The version is the title without its leading make and model, letter case aside. A malformed page and an item without
    id give no row; a seller or place that is not there is null. Optional columns of the pages: `page_num`, from which
    has_next is told."""
    page_num = F.col("page_num") if "page_num" in pages.columns else F.lit(1)
    j = F.col(body)
    meta = F.from_json(F.get_json_object(j, "$.meta"), "struct<totalResults:long,totalPages:int>")
    p = pages.select(page_num.alias("page_num"), meta.alias("m"), F.from_json(F.get_json_object(j, "$.items"), "array<string>").alias("items"))
    x = p.select(F.coalesce("m.totalResults", F.lit(0)).alias("total"), (F.col("page_num") < F.coalesce("m.totalPages", F.lit(0))).alias("has_next"), F.explode("items").alias("raw"))
    x = x.withColumn("x", F.from_json("raw", _ITEM)).where(F.coalesce("x.id", F.lit("")) != "")
    prefix = F.concat_ws(" ", F.nullif("x.make", F.lit("")), F.nullif("x.model", F.lit("")))
    leads = (prefix != "") & F.startswith(F.lower("x.title"), F.lower(prefix))
    version = F.when(leads, F.nullif(F.trim(F.substring(F.col("x.title"), F.length(prefix) + 1, F.length("x.title"))), F.lit(""))).otherwise(F.col("x.title"))
    url = F.when(F.startswith("x.url", F.lit("/")), F.concat(F.lit(base_url), "x.url")).otherwise(F.col("x.url"))
    gearbox = F.create_map(*[F.lit(v) for kv in GEARBOX_IDS.items() for v in kv])
    return x.select(
        F.col("x.id").alias("listing_id"), F.lit(source).alias("source"), url.alias("url"), "x.title", "x.make", "x.model", version.alias("version"), F.col("x.price.amount").alias("price_eur"), F.col("x.km").alias("mileage_km"),
        F.when(F.coalesce("x.year", F.lit(0)) != 0, F.struct(F.col("x.year").alias("year"), F.lit(None).cast("int").alias("month"))).alias("first_registration"), F.col("x.hp").alias("power_hp"),
        F.floor(F.nullif("x.hp", F.lit(0)) / HP_PER_KW_TRUNCATED).cast("int").alias("power_kw"), F.col("x.fuelType").alias("fuel_type"), F.col("x.cubicCapacity").alias("engine_displacement_cc"),
        F.try_element_at(gearbox, F.col("x.transmissionTypeId")).alias("transmission"), F.when(F.col("x.location").isNotNull(), F.lit(country)).alias("country_code"), F.col("x.location.regionLiteral").alias("region"),
        F.col("x.location.mainProvince").alias("province"), F.col("x.location.cityLiteral").alias("city"), F.when(F.col("x.seller").isNotNull(), F.when(F.col("x.seller.isProfessional"), "dealer").otherwise("private")).alias("seller_type"),
        F.col("x.seller.name").alias("seller_name"), F.col("x.phone").alias("seller_phone"), F.coalesce("x.publishedDate", "x.creationDate").try_cast("timestamp").alias("publish_date"), image_urls(F.col("raw")).alias("images"), "total", "has_next",
    )


def refine(listings: DataFrame, wanted: ListingFilter, limit: int | None = None) -> DataFrame:
    """The remote result once more by the filter itself, for a remote may answer more widely; at most `limit` rows."""
    out = wanted.apply(listings)
    return out if limit is None else out.limit(limit)


def object_with_id(text: str | None, marker: str, wanted: str) -> dict | None:
    """The first JSON object after any occurrence of a marker whose `id` is the wanted one. An object of another id does not
    end the search, and the next marker may lie inside it."""
    dec = json.JSONDecoder()
    for m in re.finditer(re.escape(marker) + r"\s*", text or ""):
        try:
            value, _ = dec.raw_decode(text, m.end())
        except ValueError:
            continue
        if isinstance(value, dict) and str(value.get("id")) == wanted:
            return value
    return None


def detail_objects(pages: DataFrame, html: str = "html", listing_id: str = "listing_id", marker: str = '"listing":') -> DataFrame:
    """listing_id, payload (JSON text) of detail pages that embed the listing they are of."""

    @F.pandas_udf(T.StringType())
    def find(texts: pd.Series, ids: pd.Series) -> pd.Series:
        got = [object_with_id(t, marker, i) for t, i in zip(texts, ids)]
        return pd.Series([None if g is None else json.dumps(g, ensure_ascii=False) for g in got], dtype="object")

    return pages.select(F.col(listing_id).alias("listing_id"), find(framework_chunks(F.col(html)), F.col(listing_id)).alias("payload")).where("payload is not null")


def detail_attributes(details: DataFrame) -> DataFrame:
    """listing_id and what the attribute list of an embedded listing says: a fuel, gearbox, figures, condition claims."""
    a = tag_values(F.get_json_object("payload", "$.attributes"))
    d = details.select("listing_id", "payload", a.alias("a"))
    reg = registration(F.col("a")["firstRegistration"])
    return d.select(
        "listing_id", F.get_json_object("payload", "$.title").alias("title"), attribute_fuel(F.col("a")).alias("fuel_type"), F.col("a")["transmission"].alias("transmission"), localized_integer(F.col("a")["mileage"]).alias("mileage_km"),
        localized_integer(F.col("a")["cubicCapacity"]).alias("engine_displacement_cc"), F.regexp_extract(F.lower(F.col("a")["power"]), r"(\d+)\s*kw", 1).try_cast("int").alias("power_kw"), reg.alias("first_registration"),
        accident_free(F.col("a")["damageCondition"]).alias("accident_free"), unregistered_new(F.col("a")["damageCondition"], reg).alias("unregistered_new"),
    )


class _Labelled(HTMLParser):
    """Texts by the `data-testid` they stand under: of a block all its text, of a <dt> the text of the <dd> that follows."""

    BLOCKS = {"br", "p", "div", "li", "dt", "dd", "tr", "h1", "h2", "h3"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.texts: dict[str, list[str]] = {}
        self.all: list[str] = []
        self.images: list[str] = []
        self.pending: str | None = None
        self.heading: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "img" or (tag == "meta" and (a.get("property") or a.get("name")) in ("og:image", "twitter:image")):
            self.images += [u for u in (a.get("content"), a.get("src"), a.get("data-src")) if u]
        if tag in self.BLOCKS:
            self.all.append("\n")
        if tag in ("meta", "img", "br", "input", "link", "hr"):
            for _, key in self.open:
                if key and tag == "br":
                    self.texts.setdefault(key, []).append("\n")
            return
        key = a.get("data-testid")
        if tag == "dt":
            self.pending, key = key, None
        elif tag == "dd":
            key, self.pending = self.pending, None
        self.open.append((tag, key))

    def handle_endtag(self, tag):
        while self.open:
            if self.open.pop()[0] == tag:
                break

    def handle_data(self, data):
        tags = {t for t, _ in self.open}
        if tags & {"script", "style"}:
            return
        self.all.append(data)
        if tags & {"h1", "h2"}:
            self.heading.append(data)
        for _, key in self.open:
            if key:
                self.texts.setdefault(key, []).append(data)


# The labels of the parts of a detail page.
DETAIL_LABELS = {
    "price_raw": "prime-price", "mileage": "vip-key-features-list-item-mileage", "power": "vip-key-features-list-item-power", "fuel_type": "vip-key-features-list-item-fuel", "transmission": "vip-key-features-list-item-transmission",
    "registered": "vip-key-features-list-item-firstRegistration", "owners": "vip-key-features-list-item-numberOfPreviousOwners", "co2": "envkv.co2Emissions-item", "consumption": "envkv.consumptionDetails.fuel-item",
    "cc": "cubicCapacity-item", "sticker": "emissionsSticker-item", "description": "vip-vehicle-description-text", "seller": "vip-seller",
}
_DETAIL = ", ".join(f"{c} string" for c in ("listing_id", "title", *DETAIL_LABELS, "body")) + ", images array<string>"
# Words of an image that is none of the vehicle, and of a private seller.
_NO_PHOTO, _PRIVATE = ("logo", "icon", "sprite", "dealer-rating"), ("particular", "privat")


def detail_markup(pages: DataFrame, html: str = "html", listing_id: str = "listing_id") -> DataFrame:
    """Listings of detail pages by their markup: labelled features, and CO2, consumption and doors from the running text
    where no label has them. A null or empty page gives a row of nulls; broken markup is read as far as it goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lid, page in zip(pdf[listing_id], pdf[html]):
                p = _Labelled()
                p.feed(page if isinstance(page, str) else "")
                text = {k: "".join(v).strip() for k, v in p.texts.items()}
                photos = [u for u in dict.fromkeys(p.images) if u.startswith("http") and not any(w in u.lower() for w in _NO_PHOTO)]
                out.append((lid, " ".join("".join(p.heading).split()) or None, *[text.get(label) or None for label in DETAIL_LABELS.values()], "".join(p.all), photos[:8]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DETAIL.split(", ")])

    d = pages.select(listing_id, html).mapInPandas(run, _DETAIL)
    first = lambda pattern, *cs: F.coalesce(*[F.nullif(F.regexp_extract(F.col(c), pattern, 1), F.lit("")) for c in cs])
    gear = F.lower("transmission")
    words = F.split("title", " ")
    return d.select(
        "listing_id", "title", F.nullif(words[0], F.lit("")).alias("make"), F.nullif(F.array_join(F.slice(words, 2, 1_000), " "), F.lit("")).alias("model"), localized_integer(F.col("price_raw")).cast("double").alias("price_eur"),
        localized_integer(F.col("mileage")).alias("mileage_km"), first(r"(?i)(\d+)\s*kW", "power").try_cast("int").alias("power_kw"), first(r"(?i)\((\d+)\s*(?:cv|ps|hp)\)", "power").try_cast("int").alias("power_hp"), "fuel_type",
        F.when(gear.contains("manual"), "Manual").when(gear.contains("automát"), "Automático").otherwise(F.col("transmission")).alias("transmission"), registration(F.col("registered")).alias("first_registration"),
        first(r"(\d+)", "owners").try_cast("int").alias("previous_owners"), first(r"(?i)(\d+)\s*g/km", "co2", "body").try_cast("int").alias("co2_emissions_g_km"),
        F.replace(first(r"(?i)(\d+[,.]?\d*)\s*l/100\s*km", "consumption", "body"), F.lit(","), F.lit(".")).try_cast("double").alias("consumption_combined_l_100km"), localized_integer(F.col("cc")).alias("engine_displacement_cc"),
        F.col("sticker").alias("environment_badge"), "description", first(r"(?i)(\d)\s*(?:puertas|türen|doors)", "body").try_cast("int").alias("doors"),
        F.when(F.col("seller").isNotNull(), F.when(F.lower("seller").rlike("|".join(_PRIVATE)), "private").otherwise("dealer")).alias("seller_type"), "images",
    )


# Claims about accidents, folded; a claim of none wins.
ACCIDENT_FREE = ["sin accidentes", "unfallfrei", "accident free", "no accident"]
ACCIDENT = ["accidentado", "vehiculo accidentado", "unfallfahrzeug", "beschadigt", "damaged", "accident vehicle"]
# Words of an electric drive in energy labels, and the starts of a condition that means new.
ELECTRIC_WORDS = ["electric", "eléctric", "elektro", "elektrisch", "electricidad", "strom"]
NEW_STARTS = ["nuevo", "neu", "new", "neuf"]
ELECTRIC_LABEL = "Eléctrico"


def accident_free(c: Column) -> Column:
    """True or false by an explicit claim, null without one."""
    n = F.translate(F.lower(c), "áäéíóöúü", "aaeioouu")
    any_of = lambda words: n.rlike("|".join(words))
    return F.when(any_of(ACCIDENT_FREE), True).when(any_of(ACCIDENT), False)


def attribute_fuel(a: Column) -> Column:
    """The declared fuel of an attribute map; else electric by the energy label; else electric by a battery without a
    displacement or cylinders; else null."""
    get = lambda k: F.nullif(F.try_element_at(a, F.lit(k)), F.lit(""))
    label = F.lower(F.concat_ws(" ", get("envkv.engineType"), get("envkv.otherEnergySource")))
    battery = F.coalesce(get("battery"), get("batteryCapacity")).isNotNull() & get("cubicCapacity").isNull() & get("cylinder").isNull()
    return F.coalesce(get("fuel"), F.when(label.rlike("|".join(ELECTRIC_WORDS)) | battery, F.lit(ELECTRIC_LABEL)))


def unregistered_new(condition: Column, registered: Column) -> Column:
    """Whether a vehicle was never registered: no registration, and a condition that begins with new."""
    return registered.isNull() & F.coalesce(F.ltrim(F.lower(condition)).rlike("^(?:" + "|".join(NEW_STARTS) + ")"), F.lit(False))


def co2_value(df: DataFrame, order: tuple[str, ...] = ("co2_emissions_g_km", "co2_original_g_km", "co2_inferred_g_km")) -> Column:
    """The first of the CO2 columns that has a value; columns the frame lacks count as null."""
    return F.coalesce(*[F.col(c).cast("int") if c in df.columns else F.lit(None).cast("int") for c in order])
