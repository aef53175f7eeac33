"""Summaries, set operations, activity tables, timelines and JSON payloads; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lonja.operators import matching, profile, rows, timelines
from lonja.plans import listing_queries as L
from lonja.session import table
from lonja.sources import files


def snapshot_payloads(spark, d):
    """Orders as rows of an immutable snapshot: key, hash of the payload, flags."""
    o = table(spark, d, "orders")
    return files.snapshot_rows(o, ["o_orderkey"], ["o_custkey"], {"finished": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT"})


def price_summary(spark, d):
    return profile.price_summary(table(spark, d, "listings"), ["source"])


def comparison_summary(spark, d):
    return profile.comparison_summary(L.market_reference(spark, d))


def profile_counts(spark, d):
    return profile.frequencies(table(spark, d, "listings"), ["source", "transmission", "body_type", "seller_type", "country_code", "vat_deductible"])


def missing_profile(spark, d):
    m = L.missing_fields(spark, d).select(F.explode(F.split("missing", ",")).alias("field")).where("field <> ''")
    return m.groupBy("field").agg(F.count("*").alias("rows"))


def quartile_outliers(spark, d):
    return profile.quartile_outliers(table(spark, d, "listings"), ["source"], "price_eur")


def catalogue(spark, d):
    return profile.catalogue(table(spark, d, "listings"), "source", "seller_dealer_id")


def catalogue_lookup(spark, d):
    entries = table(spark, d, "canonical_values").where("list_name = 'make'").select(F.col("canon_id").alias("id"), F.col("canon_value").alias("name"))
    return profile.catalogue_lookup(table(spark, d, "boe_valores").select(F.col("brand").alias("wanted")), entries)


def nearest_five(spark, d):
    return profile.nearest_values(table(spark, d, "boe_valores"), "fuel_code", "power_kw", 100.0)


def top_listings(spark, d):
    """The hundred dearest listings: a top-k report."""
    return table(spark, d, "listings").where("price_eur is not null").select("row_id", "source", "price_eur").orderBy(F.desc("price_eur"), "row_id").limit(100)


def dashboard_activity(spark, d):
    o = table(spark, d, "orders")
    return o.agg(F.count("*").alias("calculations"), F.countDistinct("o_custkey").alias("visitors"), (F.sum(matching.cents(F.col("o_totalprice"))) / 100.0 / F.count("*")).alias("mean_total"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


def calc_with_lead(spark, d):
    return rows.with_flag(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "has_lead")


def latest_lead(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderkey", "o_orderstatus")
    return rows.with_latest(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "at", ["o_orderkey", "o_orderstatus"])


def gdpr_erase(spark, d):
    return rows.erase(table(spark, d, "customer"), F.lower("c_mktsegment") == "building", ["c_name", "c_acctbal"])


def upsert_latest(spark, d):
    """The last scrape of each advert: what an upsert by (source, listing_id) leaves."""
    df = table(spark, d, "listings").select("source", F.lower(F.trim("listing_id")).alias("listing_id"), "scraped_at", "row_id", "price_eur")
    return rows.latest_per_key(df, ["source", "listing_id"], ["scraped_at", "row_id"])


def unused_ids_anti(spark, d):
    """Customers without an urgent order."""
    return rows.unused(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


def overlap_ids(spark, d):
    l, s = table(spark, d, "listings"), table(spark, d, "listing_snapshots")
    ids = lambda x: x.select("source", F.lower(F.trim("listing_id")).alias("listing_id"))
    return ids(l).intersect(ids(s))


def ordered_distinct(spark, d):
    """Each source's makes in order of first scrape, without repeats."""
    l = table(spark, d, "listings").where("make is not null").groupBy("source", "make").agg(F.min("row_id").alias("first_row"))
    return l.select("source", "make", F.row_number().over(Window.partitionBy("source").orderBy("first_row")).alias("place"))


def offered_load_window(spark, d):
    return timelines.offered_load(table(spark, d, "events"), "user_id", "ts", 60).select("event_id", "user_id", "load")


def rate_limit_exact(spark, d):
    return timelines.rate_limit(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 3600)


def advert_history(spark, d):
    return timelines.advert_history(table(spark, d, "listing_snapshots"))


def json_props(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_id", "event_type", F.col("p.k").alias("k"))


def event_hours(spark, d):
    """Events in hourly tumbling windows by type."""
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return e.groupBy("hour", "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 1000).cast("bigint")).alias("milli"))


QUERIES = {f.__name__: f for f in (
    snapshot_payloads, price_summary, comparison_summary, profile_counts, missing_profile, quartile_outliers, catalogue, catalogue_lookup, nearest_five, top_listings, dashboard_activity, calc_with_lead, latest_lead, gdpr_erase,
    upsert_latest, unused_ids_anti, overlap_ids, ordered_distinct, offered_load_window, rate_limit_exact, advert_history, json_props, event_hours,
)}

_REF = L.ORACLE["market_reference"]
ORACLE = {
    "snapshot_payloads": """SELECT o_orderkey, '{"o_custkey":' || o_custkey || '}' AS payload, sha256('{"o_custkey":' || o_custkey || '}') AS payload_hash, o_orderstatus = 'F' AS finished, o_orderpriority = '1-URGENT' AS urgent FROM orders""",
    "price_summary": "SELECT source, count(*) AS listings, count(nullif(price_eur, 0)) AS priced, CAST(sum(CAST(round(nullif(price_eur, 0) * 100) AS bigint)) AS double) / 100.0 / nullif(count(nullif(price_eur, 0)), 0) AS average, min(nullif(price_eur, 0)) AS least, max(nullif(price_eur, 0)) AS greatest FROM listings GROUP BY source",
    "comparison_summary": f"SELECT count(*) AS targets, count(*) FILTER (level = 'exact') AS exact_targets, count(*) FILTER (level = 'near') AS near_targets, count(*) FILTER (level = 'broad') AS broad_targets, CAST(coalesce(sum(n), 0) AS bigint) AS comparables, max(n) AS largest_sample, CAST(sum(CAST(round(median * 100) AS bigint)) AS double) / 100.0 / nullif(count(median), 0) AS mean_median FROM ({_REF})",
    "profile_counts": "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce(CAST({c} AS varchar), '(none)') AS value FROM listings" for c in ("source", "transmission", "body_type", "seller_type", "country_code", "vat_deductible")) + ") SELECT field, value, count(*) AS rows, round_even(CAST(count(*) * 100.0::double / sum(count(*)) OVER (PARTITION BY field) AS decimal(18, 10)), 2)::double AS percent FROM c GROUP BY field, value",
    "missing_profile": f"SELECT field, count(*) AS rows FROM (SELECT unnest(string_split(missing, ',')) AS field FROM ({L.ORACLE['missing_fields']})) WHERE field <> '' GROUP BY field",
    "quartile_outliers": "WITH q AS (SELECT source, quantile_cont(price_eur, 0.25) AS q1, quantile_cont(price_eur, 0.5) AS q2, quantile_cont(price_eur, 0.75) AS q3 FROM listings WHERE price_eur IS NOT NULL GROUP BY source) SELECT source, q1, q2, q3, count(*) AS n, count(*) FILTER (price_eur < q1 - 1.5 * (q3 - q1) OR price_eur > q3 + 1.5 * (q3 - q1)) AS outliers FROM listings JOIN q USING (source) WHERE price_eur IS NOT NULL GROUP BY source, q1, q2, q3",
    "catalogue": "SELECT source, count(DISTINCT seller_dealer_id) AS entries, count(*) AS rows FROM listings WHERE source IS NOT NULL GROUP BY source",
    "catalogue_lookup": """WITH e AS (SELECT canon_id AS id, lower(canon_value) AS n FROM canonical_values WHERE list_name = 'make'), w AS (SELECT DISTINCT brand AS wanted, lower(trim(brand, ' ')) AS w FROM boe_valores),
      s AS (SELECT wanted, min(id) AS id, 'equal' AS how FROM w JOIN e ON w = n GROUP BY wanted), p AS (SELECT wanted, min(id) AS id, 'part' AS how FROM w JOIN e ON contains(n, w) OR contains(w, n) WHERE w <> '' AND wanted NOT IN (SELECT wanted FROM s) GROUP BY wanted)
      SELECT * FROM s UNION ALL SELECT * FROM p""",
    "nearest_five": "SELECT fuel_code, power_kw, place FROM (SELECT *, row_number() OVER (PARTITION BY fuel_code ORDER BY abs(power_kw - 100.0), power_kw) AS place FROM (SELECT DISTINCT fuel_code, power_kw FROM boe_valores WHERE power_kw IS NOT NULL)) WHERE place <= 5",
    "top_listings": "SELECT row_id, source, price_eur FROM listings WHERE price_eur IS NOT NULL ORDER BY price_eur DESC, row_id LIMIT 100",
    "dashboard_activity": "SELECT count(*) AS calculations, count(DISTINCT o_custkey) AS visitors, CAST(sum(CAST(round(o_totalprice * 100) AS bigint)) AS double) / 100.0 / count(*) AS mean_total, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders",
    "calc_with_lead": "SELECT c_custkey, c_mktsegment, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_lead FROM customer",
    "latest_lead": "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) ON o_custkey = c_custkey",
    "gdpr_erase": "SELECT c_custkey, CASE WHEN lower(c_mktsegment) = 'building' THEN NULL ELSE c_name END AS c_name, c_nationkey, CASE WHEN lower(c_mktsegment) = 'building' THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment, lower(c_mktsegment) = 'building' AS erased FROM customer",
    "upsert_latest": "SELECT source, listing_id, scraped_at, row_id, price_eur FROM (SELECT source, lower(trim(listing_id)) AS listing_id, scraped_at, row_id, price_eur, row_number() OVER (PARTITION BY source, lower(trim(listing_id)) ORDER BY scraped_at DESC, row_id DESC) AS rn FROM listings) WHERE rn = 1",
    "unused_ids_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')",
    "overlap_ids": "SELECT source, lower(trim(listing_id)) AS listing_id FROM listings INTERSECT SELECT source, lower(trim(listing_id)) FROM listing_snapshots",
    "ordered_distinct": "SELECT source, make, row_number() OVER (PARTITION BY source ORDER BY min(row_id)) AS place FROM listings WHERE make IS NOT NULL GROUP BY source, make",
    "offered_load_window": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS load FROM events",
    "rate_limit_exact": """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      r AS (SELECT event_id, user_id, ts, i, true AS accepted, [epoch_us(ts)] AS kept FROM e WHERE i = 1 UNION ALL
      SELECT event_id, user_id, ts, i, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, epoch_us(ts)) ELSE live END
      FROM (SELECT e.*, list_filter(r.kept, lambda x: x > epoch_us(e.ts) - 3600000000) AS live FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.i = r.i + 1))
      SELECT event_id, user_id, ts, accepted FROM r""",
    "advert_history": """WITH a AS (SELECT snapshot_id, snapshot_date, source, lower(trim(listing_id)) AS listing_id, arg_max(coalesce(CAST(round(price_eur * 100) AS bigint), -1), (scraped_at, coalesce(CAST(round(price_eur * 100) AS bigint), -1))) AS c FROM listing_snapshots GROUP BY 1, 2, 3, 4),
      t AS (SELECT source, snapshot_id, row_number() OVER (PARTITION BY source ORDER BY snapshot_id) AS turn FROM (SELECT DISTINCT source, snapshot_id FROM a)),
      s AS (SELECT *, lag(turn) OVER w AS before, lag(c) OVER w AS old FROM a JOIN t USING (source, snapshot_id) WINDOW w AS (PARTITION BY source, listing_id ORDER BY snapshot_id))
      SELECT source, listing_id, min(snapshot_id) AS first_seen, max(snapshot_id) AS last_seen, count(*) AS deliveries, count(*) FILTER (before IS NULL OR turn - before > 1) AS spells,
      nullif(arg_min(c, snapshot_id), -1) AS first_cents, nullif(arg_max(c, snapshot_id), -1) AS last_cents, count(*) FILTER (before IS NOT NULL AND c <> old) AS price_changes, date_diff('day', min(snapshot_date), max(snapshot_date)) AS days FROM s GROUP BY 1, 2""",
    "json_props": "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS bigint) AS k FROM events",
    "event_hours": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value * 1000) AS bigint)) AS bigint) AS milli FROM events GROUP BY 1, 2",
}
