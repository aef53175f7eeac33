"""Queries over claims, payload round trips, remote vocabularies, sort orders, catalogues and contracts; with DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lonja.functions.keys import fuel_category
from lonja.operators import enrich, matching, profile, rows
from lonja.plans import listing_queries as L
from lonja.session import table
from lonja.sources import contracts, market_pages, pushdown

TOP = 50


def accident_claims(spark, d):
    return table(spark, d, "documents").select("doc_id", market_pages.accident_free(F.col("text")).alias("accident_free"))


def unregistered_new(spark, d):
    return table(spark, d, "listings").select("row_id", market_pages.unregistered_new(F.col("title"), F.col("first_registration")).alias("is_new"))


def interface_roundtrip(spark, d):
    """Listings written as items of the JSON interface, one page a source, and read back."""
    l = table(spark, d, "listings").where("listing_id is not null")
    item = F.struct(F.col("row_id").cast("string").alias("id"), "title", "make", "model", F.struct(F.col("price_eur").alias("amount")).alias("price"), F.col("first_registration.year").alias("year"), F.col("mileage_km").alias("km"), F.col("power_hp").alias("hp"), F.col("fuel_type").alias("fuelType"),
                    F.col("engine_displacement_cc").alias("cubicCapacity"), F.struct(F.col("city").alias("cityLiteral")).alias("location"), F.struct((F.col("seller_type") == "dealer").alias("isProfessional")).alias("seller"))
    body = F.concat(F.lit('{"items":['), F.to_json(item), F.lit('],"meta":{"totalResults":1,"totalPages":1}}'))
    got = market_pages.interface_listings(l.select(body.alias("body")))
    return got.select(F.col("listing_id").cast("long").alias("row_id"), "version", "price_eur", F.col("first_registration.year").alias("year"), "mileage_km", "power_hp", "power_kw", "fuel_type", "engine_displacement_cc", "city", "seller_type")


def remote_fuels(spark, d):
    n = fuel_category(F.col("fuel_type"))
    return table(spark, d, "listings").select("row_id", pushdown.remote_word(n, pushdown.FUEL_WORDS["words_es"]).alias("word_es"), pushdown.remote_word(n, pushdown.FUEL_WORDS["words_en"]).alias("word_en"))


def sort_orders(spark, d):
    """The first fifty listings of each sort order: a top-k report."""
    l = table(spark, d, "listings")
    return reduce(lambda a, b: a.unionByName(b), [pushdown.sort_listings(l, o).limit(TOP).select(F.lit(o).alias("sort_order"), "row_id") for o in pushdown.SORTS])


def co2_effective(spark, d):
    """The first CO2 value of a listing: stated, or inferred from the memory's plain mean."""
    df = table(spark, d, "listings")
    memory = enrich.memory_mean(df).select(F.col("key").alias("m_key"), F.bround("co2_avg").cast("int").alias("co2_inferred_g_km"))
    j = df.join(memory, L.K.co2_memory_key(df) == F.col("m_key"), "left")
    return j.select("row_id", market_pages.co2_value(j).alias("co2_g_km"))


def model_lookup(spark, d):
    """The models of the listings in a catalogue of the models that the snapshots name, within their make."""
    s = table(spark, d, "listing_snapshots").where("make is not null and model is not null").select("make", "model").distinct()
    entries = s.groupBy(F.lower("make").alias("make"), "model").agg(F.lit(1)).select("make", F.col("model").alias("id"), F.col("model").alias("name"))
    wanted = table(spark, d, "listings").where("make is not null and model is not null").select("make", F.col("model").alias("wanted"))
    return profile.lookup_within(wanted, entries, "make")


def catalogue_names(spark, d):
    """The names of a catalogue in their order: sources, and the dealers of each."""
    return profile.catalogue_names(table(spark, d, "listings"), "source", "seller_dealer_id")


def contract_report(spark, d):
    return contracts.Contract((), ("source", "listing_id")).report(table(spark, d, "listings"))


def wide_export(spark, d):
    return contracts.wide_export(table(spark, d, "listings")).select("listing_id", "source", "price_gross_eur", "year", "month", "country_code", "city", "seller_type", "seller_dealer_id", "original_price", "original_currency")


def pair_decisions(spark, d):
    """Why each German target of one source and a Spanish listing of its model do or do not match."""
    l = table(spark, d, "listings")
    return matching.pair_decisions(matching.keyed(l.where("country_code = 'DE'")), matching.keyed(l.where("country_code = 'ES'")))


def idle_dealers_anti(spark, d):
    """Dealers of documents that have no listing."""
    dealers = table(spark, d, "documents").where("dealer_id is not null").select(F.col("dealer_id").alias("seller_dealer_id")).distinct()
    return rows.unused(dealers, table(spark, d, "listings").where("country_code = 'ES'"), "seller_dealer_id")


def union_markets(spark, d):
    """One union over all countries, each as a frame of its own."""
    l = table(spark, d, "listings")
    countries = ("DE", "AT", "ES", "FR", "CH", "PL", "CZ", "GB", "SE", "DK", "NO")
    parts = [l.where(F.col("country_code") == c).select("row_id", F.lit(c).alias("market"), "price_eur") for c in countries]
    return reduce(lambda a, b: a.unionByName(b), [*parts, l.where(F.col("country_code").isNull() | ~F.col("country_code").isin(*countries)).select("row_id", F.lit("other").alias("market"), "price_eur")])


QUERIES = {f.__name__: f for f in (accident_claims, unregistered_new, interface_roundtrip, remote_fuels, sort_orders, co2_effective, model_lookup, catalogue_names, contract_report, wide_export, pair_decisions, idle_dealers_anti, union_markets)}

_FOLDED = "translate(lower(text), 'áäéíóöúü', 'aaeioouu')"
_FUEL = f"(SELECT row_id, {L._fuel('fuel_n')} AS f FROM (SELECT row_id, {L.N('fuel_type')} AS fuel_n FROM listings))"
ORACLE = {
    "accident_claims": f"SELECT doc_id, CASE WHEN regexp_matches({_FOLDED}, 'sin accidentes|unfallfrei|accident free|no accident') THEN true WHEN regexp_matches({_FOLDED}, 'accidentado|unfallfahrzeug|beschadigt|damaged|accident vehicle') THEN false END AS accident_free FROM documents",
    "unregistered_new": "SELECT row_id, first_registration IS NULL AND coalesce(regexp_matches(ltrim(lower(title), ' '), '^(nuevo|neu|new)'), false) AS is_new FROM listings",
    "interface_roundtrip": """SELECT row_id, CASE WHEN coalesce(pre, '') <> '' AND starts_with(lower(title), lower(pre)) THEN nullif(trim(substr(title, length(pre) + 1), ' '), '') ELSE title END AS version, price_eur, nullif(y, 0) AS year, mileage_km, power_hp,
      CAST(floor(nullif(power_hp, 0) / 1.36::double) AS int) AS power_kw, fuel_type, engine_displacement_cc, city, CASE WHEN seller_type = 'dealer' THEN 'dealer' ELSE 'private' END AS seller_type
      FROM (SELECT *, first_registration.year AS y, concat_ws(' ', nullif(make, ''), nullif(model, '')) AS pre FROM listings WHERE listing_id IS NOT NULL)""",
    "remote_fuels": f"""SELECT row_id, CASE f WHEN 'gasoline' THEN 'Gasolina' WHEN 'diesel' THEN 'Diesel' WHEN 'electric' THEN 'Eléctrico' WHEN 'hybrid' THEN 'Híbrido' WHEN 'ethanol' THEN 'Etanol' WHEN 'lpg' THEN 'Gas licuado' WHEN 'cng' THEN 'Gas natural' WHEN 'hydrogen' THEN 'Hidrógeno' ELSE f END AS word_es, f AS word_en FROM {_FUEL}""",
    "sort_orders": " UNION ALL ".join(f"(SELECT '{o}' AS sort_order, row_id FROM listings ORDER BY {c} {'ASC' if up else 'DESC'} NULLS LAST, row_id LIMIT 50)" for o, c, up in (
        ("price_asc", "price_eur", 1), ("price_desc", "price_eur", 0), ("year_desc", "first_registration.year", 0), ("year_asc", "first_registration.year", 1), ("mileage_asc", "mileage_km", 1), ("mileage_desc", "mileage_km", 0))),
    "co2_effective": f"WITH {L._MEMORY} SELECT row_id, coalesce(co2_emissions_g_km, CAST(round_even(co2_avg, 0) AS int)) AS co2_g_km FROM (SELECT *, {L._MEM} AS key FROM listings) LEFT JOIN mem USING (key)",
    "model_lookup": """WITH e AS (SELECT DISTINCT lower(make) AS mk, model AS id, lower(model) AS n FROM listing_snapshots WHERE make IS NOT NULL AND model IS NOT NULL), w AS (SELECT DISTINCT lower(make) AS mk, model AS wanted, lower(trim(model, ' ')) AS w FROM listings WHERE make IS NOT NULL AND model IS NOT NULL),
      s AS (SELECT w.mk, wanted, min(id) AS id, 'equal' AS how FROM w JOIN e ON w.mk = e.mk AND w = n GROUP BY 1, 2), p AS (SELECT w.mk, wanted, min(id) AS id, 'part' AS how FROM w JOIN e ON w.mk = e.mk AND (contains(n, w) OR contains(w, n)) WHERE w <> '' AND (w.mk, wanted) NOT IN (SELECT (mk, wanted) FROM s) GROUP BY 1, 2)
      SELECT mk AS make, wanted, id, how FROM s UNION ALL SELECT * FROM p""",
    "catalogue_names": "SELECT source AS top, string_agg(DISTINCT seller_dealer_id, ',' ORDER BY seller_dealer_id) AS names FROM listings WHERE source IS NOT NULL GROUP BY source",
    "contract_report": "WITH k AS (SELECT source, listing_id, count(*) AS n FROM listings GROUP BY 1, 2) SELECT CAST(sum(n) AS bigint) AS rows, CAST(coalesce(sum(n) FILTER (coalesce(source, '') = '' OR coalesce(listing_id, '') = ''), 0) AS bigint) AS keyless, count(*) FILTER (coalesce(source, '') <> '' AND coalesce(listing_id, '') <> '' AND n > 1) AS repeated_keys FROM k",
    "wide_export": "SELECT listing_id, source, price_eur AS price_gross_eur, first_registration.year AS year, first_registration.month AS month, country_code, city, seller_type, seller_dealer_id, original_price, original_currency FROM listings",
    "pair_decisions": f"""WITH {L.PAIRS} SELECT t.id AS target_id, c.id AS candidate_id, p.level, CASE WHEN p.level IS NULL THEN CASE WHEN coalesce(abs(t.year - c.year) > 4, true) THEN 'year' WHEN coalesce(abs(t.km - c.km) > 60000, true) THEN 'mileage' WHEN t.engine <> 'na' AND c.engine <> 'na' AND t.engine <> c.engine THEN 'engine'
      WHEN abs(t.cc - c.cc) > 500 THEN 'displacement' WHEN abs(t.hp - c.hp) > greatest(60, floor(coalesce(t.hp, 0) * 0.25::double)) THEN 'power' END END AS reason
      FROM k t JOIN k c ON t.make_n = c.make_n AND t.model_k = c.model_k AND t.fuel = c.fuel LEFT JOIN p ON p.target_id = t.id AND p.candidate_id = c.id
      WHERE t.country_code = 'DE' AND c.country_code = 'ES' AND t.make_n <> 'na' AND t.model_k <> 'na' AND t.fuel <> 'na'""",
    "idle_dealers_anti": "SELECT DISTINCT dealer_id AS seller_dealer_id FROM documents WHERE dealer_id IS NOT NULL AND dealer_id NOT IN (SELECT seller_dealer_id FROM listings WHERE country_code = 'ES' AND seller_dealer_id IS NOT NULL)",
    "union_markets": "SELECT row_id, CASE WHEN country_code IN ('DE', 'AT', 'ES', 'FR', 'CH', 'PL', 'CZ', 'GB', 'SE', 'DK', 'NO') THEN country_code ELSE 'other' END AS market, price_eur FROM listings",
}
