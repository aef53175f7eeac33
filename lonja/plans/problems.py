"""Queries p1_ and p2_: quantities in different units, and changes between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.operators.snapshots import snapshot_changes
from lonja.operators.units import misrecorded_fields, normalise_quantities
from lonja.session import table


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    return normalise_quantities(table(spark, d, "listings"), table(spark, d, "measure_units"), table(spark, d, "fx_rates"), table(spark, d, "vat_rates"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return misrecorded_fields(_quantities(spark, d))


def p1_quantities(spark: SparkSession, d: str) -> DataFrame:
    q = _quantities(spark, d)
    return q.withColumn("power_kw_value", F.round("power_kw_value", 3)).withColumn("net_eur", F.round("net_eur", 2))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "listing_snapshots")).select("source", "listing_id", "snapshot_id", "change_kind")


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "listing_snapshots"))


QUERIES = {"p1_found": p1_found, "p1_quantities": p1_quantities, "p2_found": p2_found, "p2_changes": p2_changes}

_CHANGES_SQL = """
WITH p AS (
  SELECT snapshot_id, source, lower(trim(listing_id)) AS listing_id,
         arg_max(coalesce(CAST(round(price_eur * 100) AS bigint), -1), (scraped_at, coalesce(CAST(round(price_eur * 100) AS bigint), -1))) AS c
  FROM listing_snapshots GROUP BY 1, 2, 3),
d AS (SELECT source, snapshot_id, lag(snapshot_id) OVER (PARTITION BY source ORDER BY snapshot_id) AS prev FROM (SELECT DISTINCT source, snapshot_id FROM p)),
cur AS (SELECT d.source, d.snapshot_id, p.listing_id, p.c FROM d JOIN p USING (source, snapshot_id) WHERE prev IS NOT NULL),
pre AS (SELECT d.source, d.snapshot_id, p.listing_id, p.c FROM d JOIN p ON p.source = d.source AND p.snapshot_id = d.prev),
j AS (
  SELECT coalesce(cur.source, pre.source) AS source, coalesce(cur.listing_id, pre.listing_id) AS listing_id,
         coalesce(cur.snapshot_id, pre.snapshot_id) AS snapshot_id,
         CASE WHEN pre.listing_id IS NULL THEN 'added' WHEN cur.listing_id IS NULL THEN 'removed' WHEN cur.c <> pre.c THEN 'changed' END AS change_kind,
         nullif(pre.c, -1) AS old_cents, nullif(cur.c, -1) AS new_cents
  FROM cur FULL JOIN pre ON cur.source = pre.source AND cur.snapshot_id = pre.snapshot_id AND cur.listing_id = pre.listing_id)
"""
ORACLE = {
    "p2_found": _CHANGES_SQL + "SELECT source, listing_id, snapshot_id, change_kind FROM j WHERE change_kind IS NOT NULL",
    "p2_changes": _CHANGES_SQL + "SELECT source, listing_id, snapshot_id, change_kind, old_cents, new_cents FROM j WHERE change_kind IS NOT NULL",
}
