"""Queries over the official value table: version join, candidates, choice, spread, funnel; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lonja.functions.text import LATIN, PLAIN
from lonja.operators import official as O
from lonja.plans.listing_queries import MANY
from lonja.session import table


def _official(spark, d):
    return O.latest_official(table(spark, d, "boe_valores"), table(spark, d, "boe_dataset_versions"))


def _base(spark, d):
    return O.base_candidates(table(spark, d, "vehiculos"), _official(spark, d))


def official_latest(spark, d):
    return _official(spark, d).select("id", "brand", "model_type", "order_code", "exercise", "value_eur")


def boe_candidates(spark, d):
    return O.technical_candidates(_base(spark, d)).select("vehiculo_id", "boe_id", "gearbox", "value_eur")


def boe_pick(spark, d):
    """The official row by the full likeness, with the block ratio."""
    return O.pick_official(O.technical_candidates(_base(spark, d)))


def boe_pick_tokens(spark, d):
    """The official row by the token part of the likeness, which stays in the JVM."""
    return O.pick_official(O.technical_candidates(_base(spark, d)), with_ratio=False)


def boe_trace_tokens(spark, d):
    """What became of each technical candidate, by the token part of the likeness."""
    return O.candidate_trace(O.technical_candidates(_base(spark, d)), with_ratio=False)


def boe_audit_tokens(spark, d):
    """The funnel of each vehicle with its label, missing facts and warning."""
    return O.resolution_audit(table(spark, d, "vehiculos"), _base(spark, d), with_ratio=False)


def fallback_cause(spark, d):
    return O.fallback_cause(table(spark, d, "vehiculos"), _base(spark, d))


def fallback_profile(spark, d):
    return fallback_cause(spark, d).groupBy("cause").agg(F.count("*").alias("vehicles"))


QUERIES = {f.__name__: f for f in (official_latest, boe_candidates, boe_pick, boe_pick_tokens, boe_trace_tokens, boe_audit_tokens, fallback_cause, fallback_profile)}


def _plain(x: str) -> str:
    for ch, p in MANY.items():
        x = f"replace({x}, '{ch}', '{p}')"
    return f"translate({x}, '{LATIN.replace(chr(39), chr(39) * 2)}', '{PLAIN.replace(chr(39), chr(39) * 2)}')"


def _n(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace(lower({_plain(x)}), '[^a-z0-9]+', ' ', 'g')), '\\b(\\d+)\\s+([a-z])\\b', '\\1\\2', 'g')"


# literals of its own, so that a wrong list of the engine shows
_FUELS = {
    "G": "'G', 'GASOLINA', 'GASOLINE', 'PETROL'", "D": "'D', 'DIESEL'", "ELC": "'E', 'ELC', 'ELECTRICO', 'ELECTRIC'",
    "HYBRID": "'HYBRID', 'HIBRIDO', 'HYBRID GASOLINE', 'HYBRID DIESEL', 'GYE', 'DYE', 'SYE'", "PHEV": "'PHEV'",
    "GAS": "'S', 'GLP', 'LPG', 'GNC', 'CNG'", "H": "'H', 'HYDROGEN', 'HIDROGENO'", "FLEX_FUEL": "'M', 'ETHANOL', 'ETANOL'",
}
_AUTO = "'aut', 'automatic', 'automatico', 'cvt', 'dct', 'dsg', 'eat6', 'eat8', 'edc', 'etg5', 'etg6', 'multitronic', 'powershift', 'steptronic', 'tiptronic'"


def _family(n: str) -> str:
    return "CASE " + " ".join(f"WHEN upper({n}) IN ({ws}) THEN '{k}'" for k, ws in _FUELS.items()) + f" ELSE nullif(upper({n}), '') END"


def _head(n: str) -> str:
    t = f"string_split({n}, ' ')"
    return f"CASE WHEN {t}[1] = 'e' AND len({t}) > 1 THEN {t}[2] WHEN regexp_full_match({t}[1], '\\d+[a-z]') THEN regexp_extract({t}[1], '^(\\d+)', 1) ELSE {t}[1] END"


BASE = f"""lo AS (SELECT v.*, order_code, exercise FROM boe_valores v JOIN boe_dataset_versions d ON d.id = v.dataset_id WHERE exercise = (SELECT max(exercise) FROM boe_dataset_versions)),
v0 AS (SELECT vehiculo_id, {_n('marca')} AS own, {_n('modelo')} AS text, year(fecha_primera_matriculacion) AS year, cilindrada_cc AS cc, potencia_kw AS kw, {_n('combustible')} AS fuel_n FROM vehiculos),
va AS (SELECT *, CASE upper(own) WHEN 'VW' THEN 'VOLKSWAGEN' WHEN 'MERCEDES BENZ' THEN 'MERCEDES' ELSE upper(own) END AS brand_n, CASE WHEN own <> '' AND starts_with(text, own || ' ') THEN substr(text, length(own) + 2) ELSE text END AS query,
  CASE WHEN text IN ('automatic', 'automatico', 'semi automatic', 'semiautomatico') OR list_has_any(string_split(text, ' '), [{_AUTO}, 'automatik']) THEN 'automatic' WHEN list_has_any(string_split(text, ' '), ['manual', 'schaltgetriebe']) THEN 'manual' END AS wanted FROM v0),
vb AS (SELECT *, {_head('query')} AS head, {_family('fuel_n')} AS fam FROM va),
vc AS (SELECT *, CASE WHEN fam IN ('G', 'D') AND (list_has_any(string_split(query, ' '), ['hybrid', 'hibrido', 'hev', 'mhev', 'etsi']) OR contains(query, 'mild hybrid')) THEN 'HYBRID' ELSE fam END AS fuel FROM vb),
oa AS (SELECT id AS boe_id, upper({_n('brand')}) AS o_brand, {_n('model_type')} AS name, commercial_start, commercial_end, displacement_cc, {_n('fuel_code')} AS fn, power_kw, value_eur FROM lo),
ob AS (SELECT *, {_head('name')} AS o_head, {_family('fn')} AS o_fuel,
  CASE WHEN list_has_any(string_split(name, ' '), [{_AUTO}]) OR len(list_filter(string_split(name, ' '), lambda x: regexp_full_match(x, '[5-9]g(tronic)?'))) > 0 THEN 'automatic' ELSE 'manual' END AS gearbox FROM oa),
base AS (SELECT *, coalesce(commercial_start, 0) <= year AND coalesce(commercial_end, 9999) >= year AS p,
  CASE WHEN fuel IN ('ELC', 'H') THEN coalesce(displacement_cc, 0) = 0 ELSE coalesce(displacement_cc = cc, false) END AS d, coalesce(o_fuel = fuel, false) AS f, coalesce(abs(power_kw - kw) <= 2.0::double, false) AS k
  FROM vc JOIN ob ON brand_n = o_brand AND head = o_head AND query <> ''),
tech AS (SELECT * FROM base WHERE p AND d AND f AND k)"""

_CAUSE = f"""WITH {BASE}, per AS (SELECT vehiculo_id AS v, bool_or(p) AS p, bool_or(p AND d) AS d, bool_or(p AND d AND f) AS f, bool_or(p AND d AND f AND k) AS k FROM base GROUP BY 1)
SELECT vehiculo_id, CASE WHEN fecha_primera_matriculacion IS NULL THEN 'no_date' WHEN v IS NULL THEN 'model' WHEN NOT coalesce(p, false) THEN 'period' WHEN NOT d THEN 'displacement' WHEN NOT f THEN 'fuel' WHEN NOT k THEN 'power' ELSE 'resolved' END AS cause
FROM vehiculos LEFT JOIN per ON vehiculo_id = v"""

RANKED = f"""{BASE}, s AS (SELECT *, list_distinct(string_split(query, ' ')) AS qt, list_distinct(string_split(name, ' ')) AS nt FROM tech),
u AS (SELECT *, round(CASE WHEN query = name THEN 1.5 ELSE 0.40::double * len(list_intersect(qt, nt)) / len(qt) + 0.15::double * len(list_intersect(qt, nt)) / len(nt) + CASE WHEN starts_with(name, query) THEN 0.15::double WHEN contains(name, query) THEN 0.10::double ELSE 0 END END, 4) AS score,
  coalesce(CASE WHEN wanted IS NOT NULL AND o_fuel NOT IN ('ELC', 'H') THEN gearbox = wanted END, true) AS fits FROM s),
x AS (SELECT *, bool_or(fits) OVER (PARTITION BY vehiculo_id) AS any_fit FROM u),
y AS (SELECT *, fits OR NOT any_fit AS in_pool FROM x),
z AS (SELECT *, count(*) FILTER (in_pool) OVER (PARTITION BY vehiculo_id) AS pool, row_number() OVER (PARTITION BY vehiculo_id ORDER BY in_pool DESC, score DESC, value_eur DESC, boe_id) AS rk,
  (max(value_eur) FILTER (in_pool) OVER (PARTITION BY vehiculo_id) - min(value_eur) FILTER (in_pool) OVER (PARTITION BY vehiculo_id)) / CAST(min(value_eur) FILTER (in_pool) OVER (PARTITION BY vehiculo_id) AS double) AS spread FROM y),
b AS (SELECT *, max(score) FILTER (rk = 1) OVER (PARTITION BY vehiculo_id) AS best FROM z),
r AS (SELECT *, count(*) FILTER (in_pool AND score = best) OVER (PARTITION BY vehiculo_id) > 1 AS tied, CASE WHEN pool = 1 OR (spread <= 0.05 AND any_fit) THEN 'high' ELSE 'non_conclusive' END AS label FROM b)"""

ORACLE = {
    "official_latest": "SELECT v.id, brand, model_type, order_code, exercise, value_eur FROM boe_valores v JOIN boe_dataset_versions d ON d.id = v.dataset_id WHERE exercise = (SELECT max(exercise) FROM boe_dataset_versions)",
    "boe_candidates": f"WITH {BASE} SELECT vehiculo_id, boe_id, gearbox, value_eur FROM tech",
    "boe_pick_tokens": f"WITH {RANKED} SELECT vehiculo_id, boe_id, score, pool, round_even(spread * 100, 2) AS spread_pct, label AS confidence, tied FROM r WHERE rk = 1",
    "boe_trace_tokens": f"""WITH {RANKED} SELECT vehiculo_id, boe_id, score, gearbox, rk = 1 AS chosen,
  CASE WHEN rk = 1 AND tied THEN 'tie_highest_value' WHEN rk = 1 THEN 'best_likeness' WHEN NOT fits THEN 'gearbox_differs' WHEN score = best THEN 'tie_lower_value' ELSE 'lower_likeness' END AS decision FROM r""",
    "boe_audit_tokens": f"""WITH {RANKED}, pb AS (SELECT vehiculo_id, count(*) AS base FROM base WHERE p GROUP BY 1),
pt AS (SELECT vehiculo_id, count(*) AS technical, count(*) FILTER (fits) AS with_gearbox, max(label) FILTER (rk = 1) AS label, max(spread) FILTER (rk = 1) AS spread, bool_or(any_fit) AS any_fit FROM r GROUP BY 1),
m AS (SELECT vehiculo_id, text, nullif(concat_ws(',', CASE WHEN cc IS NULL AND coalesce(fam, '') NOT IN ('ELC', 'H') THEN 'displacement_cc' END, CASE WHEN kw IS NULL THEN 'power_kw' END, CASE WHEN fam IS NULL THEN 'fuel_code' END), '') AS missing, own IS NULL OR text IS NULL AS nameless FROM vb)
SELECT m.vehiculo_id, coalesce(base, 0) AS base, coalesce(technical, 0) AS technical, coalesce(with_gearbox, 0) AS with_gearbox, coalesce(label, 'none') AS confidence, round_even(spread * 100, 2) AS spread_pct, coalesce(missing, '') AS missing,
  CASE WHEN nameless THEN 'no_brand_or_model' WHEN missing IS NOT NULL THEN 'facts_missing' WHEN technical IS NULL THEN 'no_technical_row' WHEN label = 'non_conclusive' AND NOT any_fit THEN 'gearbox_conflict' WHEN label = 'non_conclusive' THEN 'values_differ' END AS warning
FROM m LEFT JOIN pb USING (vehiculo_id) LEFT JOIN pt USING (vehiculo_id)""",
    "fallback_cause": _CAUSE,
    "fallback_profile": f"SELECT cause, count(*) AS vehicles FROM ({_CAUSE}) GROUP BY cause",
}
