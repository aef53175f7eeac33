"""Queries over listings: keys, filters, export, dedupe, matching, value memory; with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.functions import keys as K
from lonja.functions.text import LATIN, MANY, PLAIN, normalize_text
from lonja.operators import enrich, matching, rows
from lonja.operators.filters import ListingFilter
from lonja.session import spread, table

UNIFIED = ListingFilter(min_price=5_000, max_price=30_000, min_year=2015, max_year=2023, max_km=120_000, fuels=("diesel", "gasoline"), transmissions=("manual",), country="DE", dealer_only=True)
BODIES = ListingFilter(bodies=("suv", "kombi", "familiar"), min_hp=80, max_hp=250, private_only=True)
TOKENS = ListingFilter(model="monfesora 9", version="terranova")


def _l(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "listings")


def _heavy(spark: SparkSession, d: str) -> DataFrame:
    """Listings for queries that key every text."""
    return spread(_l(spark, d))


def listings_projection(spark, d):
    df = _l(spark, d)
    return df.select("row_id", "listing_id", "source", K.effective_year(df).alias("year"), F.col("first_registration.month").alias("month"), F.col("price_eur").alias("price_gross_eur"), "mileage_km", "country_code")


def export_flat(spark, d):
    return rows.export_frame(_l(spark, d))


def filter_unified(spark, d):
    return UNIFIED.apply(_l(spark, d)).select("row_id", "source", "price_eur", "mileage_km")


def filter_bodies(spark, d):
    """Bodies as normalised text, power and private sellers."""
    return BODIES.apply(_l(spark, d)).select("row_id", "body_type", "power_hp")


def filter_tokens(spark, d):
    return TOKENS.apply(_l(spark, d)).select("row_id", "source", "price_eur")


def text_keys(spark, d):
    return _heavy(spark, d).select("row_id", normalize_text(F.col("make")).alias("make_n"), normalize_text(F.col("title")).alias("title_n"), K.model_key(F.col("model")).alias("model_k"), K.fuel_category(F.col("fuel_type")).alias("fuel"), K.transmission_kind(F.col("transmission")).alias("tx"), K.body_category(F.col("body_type")).alias("body"), K.power_hp(F.col("power_hp"), F.col("power_kw")).alias("hp"))


def engine_keys(spark, d):
    return K.with_engine(_heavy(spark, d)).select("row_id", "variant", "engine")


def vehicle_signature(spark, d):
    df = K.with_engine(_heavy(spark, d))
    return df.select("row_id", K.vehicle_signature(df).alias("signature"), K.co2_memory_key(df).alias("memory_key"), K.market_key(F.col("make"), F.col("model"), F.col("fuel")).alias("market_key"))


def dedupe_best(spark, d):
    return rows.dedupe_listings(_heavy(spark, d)).select("row_id", "source", "listing_id")


def missing_fields(spark, d):
    df = _heavy(spark, d)
    return df.select("row_id", rows.missing_fields(df).alias("missing"))


def _pairs(spark, d, deduped=False):
    df = _heavy(spark, d)
    pool = df.where("country_code = 'ES'")
    return matching.comparable_pairs(matching.keyed(df.where("country_code = 'DE'")), matching.keyed(rows.dedupe_listings(matching.narrow(pool)) if deduped else pool))


def match_pairs(spark, d):
    return _pairs(spark, d).select("target_id", "candidate_id", "level", "year_delta", "km_delta", "same_tx")


def match_checks(spark, d):
    c = F.col("checks")
    return _pairs(spark, d).select("target_id", "candidate_id", *[c[k].alias(f"check_{k}") for k in ("make", "model", "fuel", "version", "year", "mileage", "transmission", "battery")])


def match_level_counts(spark, d):
    return matching.level_counts(_pairs(spark, d))


def market_reference(spark, d):
    """The statistics of each target's comparables, repeated cards of one vehicle left out of the pool."""
    return matching.market_statistics(_pairs(spark, d, deduped=True))


def market_reference_level_first(spark, d):
    return matching.market_statistics(_pairs(spark, d, deduped=True), price_first=False)


def market_reference_undeduped(spark, d):
    """The same over the pool as it is."""
    return matching.market_statistics(_pairs(spark, d))


def search_envelope(spark, d):
    return matching.search_envelope(matching.keyed(_heavy(spark, d).where("country_code = 'DE'")))


def co2_memory(spark, d):
    return enrich.memory_mean(_heavy(spark, d))


def co2_memory_fold(spark, d):
    return enrich.memory_fold(_heavy(spark, d))


def co2_enrich(spark, d):
    """Enriched from what a stepwise update leaves in the memory."""
    df = _heavy(spark, d)
    return enrich.enrich_co2(df, enrich.memory_fold(df))


QUERIES = {f.__name__: f for f in (
    market_reference, listings_projection, export_flat, filter_unified, filter_bodies, filter_tokens, text_keys, engine_keys, vehicle_signature, dedupe_best, missing_fields, match_pairs, match_checks,
    match_level_counts, market_reference_level_first, market_reference_undeduped, search_envelope, co2_memory, co2_memory_fold, co2_enrich,
)}


# ---- DuckDB side -------------------------------------------------------------------------------------------------


def N(x: str) -> str:
    """Normalised text in DuckDB."""
    spread = x
    for ch, plain in MANY.items():
        spread = f"replace({spread}, '{ch}', '{plain}')"
    q = lambda s: s.replace("'", "''")
    t = f"lower(regexp_replace(translate({spread}, '{q(LATIN)}', '{q(PLAIN)}'), '[^[:ascii:]]', '', 'g'))"
    return f"coalesce(nullif(trim(regexp_replace({t}, '[^a-z0-9]+', '_', 'g'), '_'), ''), 'na')"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# literals of its own from here on, so that a wrong list of the engine shows
def _fuel(n: str) -> str:
    tk = f"string_split({n}, '_')"
    has = lambda words: f"list_has_any({tk}, [{words}])"
    hyb = f"({has("'hybrid', 'hibrido'")} OR contains({n}, 'mild_hybrid'))"
    plug = f"({has("'enchufable', 'plugin', 'plug'")} OR contains({n}, 'plug_in'))"
    return f"""CASE WHEN {n} = 'na' THEN 'na' WHEN {has("'phev'")} THEN 'phev' WHEN {has("'lpg', 'glp', 'autogas', 'flussiggas'")} THEN 'lpg' WHEN {has("'cng', 'gnc', 'erdgas', 'methan', 'metano'")} OR contains({n}, 'gas_natural') THEN 'cng'
      WHEN {has("'hydrogen', 'hydrogenium', 'hidrogeno', 'wasserstoff'")} THEN 'hydrogen' WHEN {has("'ethanol', 'etanol', 'flexifuel'")} OR contains({n}, 'flex_fuel') THEN 'ethanol' WHEN {hyb} AND {plug} THEN 'phev' WHEN {hyb} THEN 'hybrid'
      WHEN {n} = 'di_esel' OR contains({n}, 'diesel') THEN 'diesel' WHEN {has("'gasolina', 'gasoline', 'benzin', 'petrol'")} THEN 'gasoline' WHEN {has("'electrico', 'elektrisch', 'electric', 'electricity', 'strom'")} THEN 'electric' ELSE 'other' END"""


def _model_key(n: str) -> str:
    tk = f"list_filter(string_split({n}, '_'), lambda x: x <> '' AND x <> 'na')"
    return f"CASE WHEN len({tk}) = 0 THEN 'na' WHEN len({tk}) >= 2 AND ({tk}[1] IN ('clase', 'serie') OR length({tk}[1]) = 1) THEN {tk}[1] || '_' || {tk}[2] ELSE {tk}[1] END"


def _variant(tk: str) -> str:
    pair = f"""CASE WHEN regexp_full_match({tk}[i], '\\d+') AND {tk}[i + 1] IN ('d', 'e', 'i') THEN {tk}[i] || {tk}[i + 1]
      WHEN length({tk}[i]) = 1 AND regexp_full_match({tk}[i + 1], '\\d+') THEN {tk}[i] || {tk}[i + 1] || CASE WHEN {tk}[i + 2] IN ('d', 'e', 'i') THEN {tk}[i + 2] ELSE '' END END"""
    return f"""coalesce(list_filter(list_transform({tk}, lambda x: regexp_extract(x, '(?:xdrive|sdrive)?(\\d{{2,3}}[a-z]{{1,2}})$', 1)), lambda x: x <> '')[1],
      list_filter(list_transform(range(1, len({tk}) + 1), lambda i: {pair}), lambda x: x IS NOT NULL)[1],
      list_filter({tk}, lambda x: regexp_full_match(x, '[a-z]?\\d{{2,3}}[a-z]?'))[1], 'na')"""


def _tx(n: str) -> str:
    return f"CASE WHEN {n} IN ('automatic', 'automatico', 'automatik') THEN 'automatic' WHEN {n} IN ('manual', 'cambio_manual', 'schaltgetriebe') THEN 'manual' WHEN {n} IN ('semi_automatic', 'semiautomatico') THEN 'semi_automatic' END"


_FAMILIES = ["pure_?tech", "blue_?hdi", "e_?tsi", "e_?hybrid", "tfsi", "tsi", "thp", "hdi", "tce", "dci", "cdi", "crdi", "cdti", "multijet", "jtd", "ecoboost", "skyactiv", "d_?4d"]


def _engine() -> str:
    fam = "CASE WHEN fuel = 'electric' THEN 'electric' " + " ".join(f"WHEN regexp_matches(text, '(?:^|_){p}(?:_|$)') THEN '{p.replace('_?', '')}'" for p in _FAMILIES) + " ELSE nullif(variant, 'na') END"
    return f"CASE WHEN ({fam}) IS NULL THEN 'na' WHEN coalesce(cc, 0) <> 0 AND fuel <> 'electric' THEN CAST(CAST(round_even(cc / 100.0, 0) AS int) * 100 AS varchar) || ':' || ({fam}) ELSE ({fam}) END"


_HP = "coalesce(power_hp, CAST(round_even(power_kw * 1.35962::double, 0) AS int))"
_JOINED = "concat_ws(' ', nullif(version, ''), nullif(title, ''), nullif(model, ''))"
KEYED = f"""n AS (
  SELECT row_id AS id, source, country_code, {N('make')} AS make_n, {N('model')} AS model_n, {N('fuel_type')} AS fuel_n, {N('transmission')} AS tx_n, {N(_JOINED)} AS text,
    engine_displacement_cc AS cc, {_HP} AS hp, first_registration.year AS year, mileage_km AS km, price_eur AS price FROM listings),
m AS (SELECT *, {_model_key('model_n')} AS model_k, {_fuel('fuel_n')} AS fuel, {_tx('tx_n')} AS tx, list_filter(string_split(text, '_'), lambda x: x <> '' AND x <> 'na') AS tk FROM n),
v AS (SELECT *, {_variant('tk')} AS variant FROM m),
k AS (SELECT *, {_engine()} AS engine FROM v)"""

_BEST = f"""SELECT row_id FROM (SELECT *, row_number() OVER (PARTITION BY {N('make')}, {N('model')}, first_registration.year, mileage_km, CAST(round(price_eur * 100) AS bigint), power_hp, {_fuel('fuel_n')}, {N('transmission')}
  ORDER BY (coalesce(version, '') <> '')::int + (engine_displacement_cc IS NOT NULL)::int + (coalesce(transmission, '') <> '')::int + (coalesce(seller_dealer_id, '') <> '')::int DESC, row_id) AS rn FROM (SELECT *, {N('fuel_type')} AS fuel_n FROM listings WHERE country_code = 'ES')) WHERE rn = 1"""


def _pairs_sql(pool: str) -> str:
    return f"""{KEYED},
j AS (
  SELECT t.id AS target_id, c.id AS candidate_id, c.price, c.source AS candidate_source, t.fuel, abs(t.year - c.year) AS year_delta, abs(t.km - c.km) AS km_delta, abs(t.cc - c.cc) AS dcc, abs(t.hp - c.hp) AS dhp,
    coalesce(t.tx = c.tx, false) AS same_tx, t.tx AS ttx, c.tx AS ctx, t.engine <> 'na' AND t.engine = c.engine AS same
  FROM k t JOIN {pool} c ON t.make_n = c.make_n AND t.model_k = c.model_k AND t.fuel = c.fuel AND abs(t.year - c.year) <= 4 AND abs(t.km - c.km) <= 60000
  WHERE t.country_code = 'DE' AND c.country_code = 'ES' AND t.make_n <> 'na' AND t.model_k <> 'na' AND t.fuel <> 'na'
    AND NOT (t.engine <> 'na' AND c.engine <> 'na' AND t.engine <> c.engine) AND coalesce(abs(t.cc - c.cc), 0) <= 500 AND coalesce(abs(t.hp - c.hp), 0) <= greatest(60, floor(coalesce(t.hp, 0) * 0.25::double))),
p AS (
  SELECT *, CASE WHEN same AND (fuel = 'electric' OR coalesce(dcc <= 150, false)) AND coalesce(dhp <= 15, false) AND year_delta <= 1 AND km_delta <= 15000 AND same_tx AND fuel NOT IN ('electric', 'phev') THEN 'exact'
    WHEN same AND (fuel = 'electric' OR coalesce(dcc <= 300, false)) AND coalesce(dhp <= 30, false) AND year_delta <= 2 AND km_delta <= 35000 AND fuel NOT IN ('electric', 'phev') THEN 'near' ELSE 'broad' END AS level FROM j)"""


PAIRS, DEDUPED_PAIRS = _pairs_sql("k"), _pairs_sql(f"(SELECT * FROM k WHERE id IN ({_BEST}))")


def _reference(price_first: bool, pairs: str = DEDUPED_PAIRS) -> str:
    pool = "(SELECT * FROM p WHERE price IS NOT NULL)" if price_first else "p"
    return f"""WITH {pairs},
r AS (SELECT *, CASE level WHEN 'exact' THEN 1 WHEN 'near' THEN 2 ELSE 3 END AS rank FROM {pool}),
b AS (SELECT * FROM (SELECT *, min(rank) OVER (PARTITION BY target_id) AS best FROM r) WHERE rank = best AND price IS NOT NULL),
x AS (SELECT *, bool_or(same_tx) OVER (PARTITION BY target_id) AS any_tx, count(*) OVER (PARTITION BY target_id) AS at_level FROM b),
s AS (SELECT target_id, level, count(*) AS n, sum(CAST(round(price * 100) AS bigint)) AS c, median(price) AS median, min(price) AS least, max(price) AS greatest, min(at_level) AS at_level,
  string_agg(DISTINCT candidate_source, '+' ORDER BY candidate_source) AS sources FROM x WHERE level <> 'near' OR NOT any_tx OR same_tx GROUP BY target_id, level)
SELECT target_id, level, n, CAST(c AS double) / 100.0 / n AS average, median, least, greatest, CASE level WHEN 'exact' THEN 'high' WHEN 'near' THEN 'medium' ELSE 'low' END AS confidence, sources,
  concat_ws(',', CASE WHEN level = 'broad' THEN 'broad_only' END, CASE WHEN level = 'broad' THEN 'battery_open' END, CASE WHEN level = 'near' AND n < at_level THEN 'same_gearbox_preferred' END, CASE WHEN n < 3 THEN 'small_sample' END) AS warnings
FROM s"""


_BODY_N = "trim(regexp_replace(regexp_replace(lower(trim(translate(coalesce(body_type, ''), '{a}', '{b}'))), '[-/]', ' ', 'g'), '\\s+', ' ', 'g'))".format(a=LATIN.replace("'", "''"), b=PLAIN.replace("'", "''"))
_BODY = """CASE WHEN list_has_any(string_split(body_n, ' '), ['suv', 'offroad', 'todoterreno', 'gelandewagen']) THEN 'suv'
  WHEN list_has_any(string_split(body_n, ' '), ['monovolumen', 'minivan', 'van']) OR contains(body_n, 'multi purpose') THEN 'monovolumen'
  WHEN list_has_any(string_split(body_n, ' '), ['deportivo', 'sportscar', 'sportwagen', 'coupe', 'cabrio', 'roadster']) OR contains(body_n, 'sports car') THEN 'deportivo_gama_alta'
  WHEN list_has_any(string_split(body_n, ' '), ['familiar', 'estate', 'estatecar', 'kombi']) OR contains(body_n, 'station wagon') THEN 'familiar'
  WHEN list_has_any(string_split(body_n, ' '), ['turismo', 'berlina', 'sedan', 'saloon', 'limousine', 'hatchback', 'compact', 'smallcar']) OR contains(body_n, 'small car') THEN 'turismo' END"""
_MEM = f"CASE WHEN first_registration.year IS NOT NULL AND coalesce(make, '') <> '' AND coalesce(model, '') <> '' AND coalesce(version, '') <> '' THEN {N('make')} || '|' || {N('model')} || '|' || {N('version')} || '|' || first_registration.year END"
_MEMORY = f"mem AS (SELECT key, count(*) AS samples, min(co2_emissions_g_km) AS co2_min, max(co2_emissions_g_km) AS co2_max, CAST(sum(co2_emissions_g_km) AS double) / count(*) AS co2_avg FROM (SELECT *, {_MEM} AS key FROM listings) WHERE key IS NOT NULL AND co2_emissions_g_km IS NOT NULL AND source NOT IN ('manual', 'user', 'public') GROUP BY key)"
_FOLD = f"mem AS (SELECT key, count(*) AS samples, min(co2_emissions_g_km) AS co2_min, max(co2_emissions_g_km) AS co2_max, list_reduce(list(co2_emissions_g_km::double ORDER BY row_id), lambda a, x, i: round_even((a * (i - 1) + x) / i, 2)) AS co2_avg FROM (SELECT *, {_MEM} AS key FROM listings) WHERE key IS NOT NULL AND co2_emissions_g_km IS NOT NULL AND source NOT IN ('manual', 'user', 'public') GROUP BY key)"
_EXPORT = "listing_id, source, scraped_at, title, make, model, version, price_eur AS price_gross_eur, price_net_eur, original_price, original_currency, price_raw, vat_deductible, mileage_km, fuel_type, transmission, power_hp, power_kw, power_raw, engine_displacement_cc, body_type, color_exterior, co2_emissions_g_km, country_code, city, seller_type, seller_dealer_id, unregistered_new"

ORACLE = {
    "listings_projection": "SELECT row_id, listing_id, source, first_registration.year AS year, first_registration.month AS month, price_eur AS price_gross_eur, mileage_km, country_code FROM listings",
    "export_flat": f"SELECT row_id, {_EXPORT}, first_registration.year AS first_registration_year, first_registration.month AS first_registration_month FROM listings",
    "filter_unified": f"""SELECT row_id, source, price_eur, mileage_km FROM (SELECT *, {N('fuel_type')} AS fn, {N('transmission')} AS tn FROM listings)
      WHERE price_eur BETWEEN 5000 AND 30000 AND first_registration.year BETWEEN 2015 AND 2023 AND mileage_km <= 120000 AND ({_fuel('fn')}) IN ('diesel', 'gasoline') AND tn IN ('manual', 'cambio_manual', 'schaltgetriebe') AND lower(country_code) = 'de' AND lower(seller_type) = 'dealer'""",
    "filter_bodies": f"SELECT row_id, body_type, power_hp FROM listings WHERE {N('body_type')} IN ('suv', 'kombi', 'familiar') AND power_hp BETWEEN 80 AND 250 AND lower(seller_type) = 'private'",
    "filter_tokens": f"""SELECT row_id, source, price_eur FROM (SELECT *, '_' || {N('model')} || '_' AS m, '_' || {N('title')} || '_' AS t, '_' || {N('version')} || '_' AS v FROM listings)
      WHERE (contains(m, '_monfesora_9_') OR contains(t, '_monfesora_9_')) AND (contains(v, '_terranova_') OR contains(t, '_terranova_'))""",
    "text_keys": f"""SELECT row_id, make_n, title_n, {_model_key('model_n')} AS model_k, {_fuel('fuel_n')} AS fuel, {_tx('tx_n')} AS tx, {_BODY} AS body, hp
      FROM (SELECT row_id, {N('make')} AS make_n, {N('title')} AS title_n, {N('model')} AS model_n, {N('fuel_type')} AS fuel_n, {N('transmission')} AS tx_n, {_BODY_N} AS body_n, {_HP} AS hp FROM listings)""",
    "engine_keys": f"WITH {KEYED} SELECT id AS row_id, variant, engine FROM k",
    "vehicle_signature": f"""WITH {KEYED} SELECT id AS row_id, concat_ws('|', make_n, model_k, variant, coalesce(CAST(k.year AS varchar), 'na'), fuel, coalesce(CAST(power_hp AS varchar), 'na'), coalesce(CAST(cc AS varchar), 'na'), 'na', tx_n) AS signature,
      {_MEM} AS memory_key, make_n || '|' || model_k || '|' || fuel AS market_key FROM k JOIN listings ON id = row_id""",
    "dedupe_best": f"""SELECT row_id, source, listing_id FROM (SELECT *, row_number() OVER (PARTITION BY {N('make')}, {N('model')}, first_registration.year, mileage_km, CAST(round(price_eur * 100) AS bigint), power_hp, {_fuel('fuel_n')}, {N('transmission')}
      ORDER BY (coalesce(version, '') <> '')::int + (engine_displacement_cc IS NOT NULL)::int + (coalesce(transmission, '') <> '')::int + (coalesce(seller_dealer_id, '') <> '')::int DESC, row_id) AS rn FROM (SELECT *, {N('fuel_type')} AS fuel_n FROM listings)) WHERE rn = 1""",
    "missing_fields": f"""SELECT row_id, concat_ws(',', CASE WHEN coalesce(make, '') = '' THEN 'make' END, CASE WHEN coalesce(model, '') = '' THEN 'model' END, CASE WHEN price_eur IS NULL THEN 'price_eur' END,
      CASE WHEN first_registration.year IS NULL AND NOT coalesce(unregistered_new, false) THEN 'first_registration' END, CASE WHEN coalesce(fuel_type, '') = '' THEN 'fuel_type' END,
      CASE WHEN engine_displacement_cc IS NULL AND ({_fuel('fuel_n')}) NOT IN ('electric', 'hydrogen') THEN 'engine_displacement_cc' END, CASE WHEN power_kw IS NULL AND power_hp IS NULL THEN 'power' END, CASE WHEN mileage_km IS NULL THEN 'mileage_km' END) AS missing
      FROM (SELECT *, {N('fuel_type')} AS fuel_n FROM listings)""",
    "match_pairs": f"WITH {PAIRS} SELECT target_id, candidate_id, level, year_delta, km_delta, same_tx FROM p",
    "match_checks": f"""WITH {PAIRS} SELECT target_id, candidate_id, 'match' AS check_make, 'match' AS check_model, 'match' AS check_fuel, 'match' AS check_mileage, CASE WHEN level IN ('exact', 'near') THEN 'match' WHEN same THEN 'relaxed' ELSE 'unavailable' END AS check_version, CASE WHEN level = 'broad' THEN 'relaxed' ELSE 'match' END AS check_year,
      CASE WHEN ttx IS NULL OR ctx IS NULL THEN 'unavailable' WHEN same_tx THEN 'match' WHEN level = 'exact' THEN 'mismatch' ELSE 'relaxed' END AS check_transmission, 'unavailable' AS check_battery FROM p""",
    "match_level_counts": f"WITH {PAIRS} SELECT target_id, count(*) FILTER (level = 'exact') AS exact_n, count(*) FILTER (level = 'near') AS near_n, count(*) FILTER (level = 'broad') AS broad_n FROM p WHERE price IS NOT NULL GROUP BY target_id",
    "market_reference": _reference(True),
    "market_reference_level_first": _reference(False),
    "market_reference_undeduped": _reference(True, PAIRS),
    "search_envelope": f"""WITH {KEYED}, s AS (SELECT *, greatest(60, CAST(round_even(hp * 0.25::double, 0) AS int)) AS span FROM k WHERE country_code = 'DE') SELECT id, year - 4 AS min_year, year + 4 AS max_year, greatest(0, km - 60000) AS min_km, km + 60000 AS max_km,
      greatest(0, hp - span) AS min_hp, hp + span AS max_hp, CASE WHEN fuel NOT IN ('phev', 'other', 'na') THEN fuel END AS fuel FROM s""",
    "co2_memory": f"WITH {_MEMORY} SELECT * FROM mem",
    "co2_memory_fold": f"WITH {_FOLD} SELECT * FROM mem",
    "co2_enrich": f"""WITH {_FOLD}, l AS (SELECT *, {_MEM} AS key, {N('fuel_type')} AS fuel_n FROM listings), f AS (SELECT *, {_fuel('fuel_n')} AS fuel FROM l)
      SELECT row_id, CASE WHEN co2_emissions_g_km IS NOT NULL THEN co2_emissions_g_km WHEN fuel = 'electric' THEN 0 WHEN co2_avg IS NOT NULL THEN CAST(round_even(co2_avg, 0) AS int) END AS co2_g_km,
      CASE WHEN co2_emissions_g_km IS NOT NULL THEN 'listing' WHEN fuel = 'electric' THEN 'electric_zero' WHEN co2_avg IS NOT NULL THEN 'memory' ELSE 'missing' END AS co2_source,
      CASE WHEN co2_emissions_g_km IS NOT NULL OR fuel = 'electric' THEN 1.0 WHEN co2_avg IS NOT NULL THEN 0.9 ELSE 0.0 END::double AS co2_confidence FROM f LEFT JOIN mem USING (key)""",
}
