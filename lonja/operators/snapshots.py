"""What changed between full snapshots: a bucketed key-to-hash index of the last delivery, probed by the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.session import delete_path, fresh_path, materialise

#: Rows of all deliveries that make a bucket, so that a bucket has a bound; and the buckets of small tables.
ROWS_PER_BUCKET, LEAST_BUCKETS = 500_000, 8
CHANGES = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("listing_id", T.StringType()), T.StructField("change_kind", T.StringType()),
    T.StructField("old_cents", T.LongType()), T.StructField("new_cents", T.LongType()),
])


class SnapshotIndex:
    """A bucketed table (source, listing_id) -> hash and the id of the delivery that holds the value.

    The table lies in the shared folder, bucketed on the key, so a probe reads it without a shuffle. `swap` writes the
    next index and drops the last one: at any time one complete index exists.
    """

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.name, self.path = spark, buckets, None, None

    def _save(self, df: DataFrame, what: str) -> tuple[str, str]:
        name, path = f"lonja_{what}_{uuid.uuid4().hex[:12]}", fresh_path(self.spark, what)
        df.write.format("parquet").bucketBy(self.buckets, "source", "listing_id").sortBy("source", "listing_id").option("path", path).saveAsTable(name)
        return name, path

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def swap(self, df: DataFrame) -> None:
        old_name, old_path = self.name, self.path
        self.name, self.path = self._save(df, "index")
        if old_name:
            self.spark.sql(f"DROP TABLE IF EXISTS {old_name}")
            delete_path(self.spark, old_path)


def prepare_deliveries(snapshots: DataFrame) -> DataFrame:
    """One row per delivery and advert: id trimmed and lower-cased, price in whole cents (NaN as null), the row with the
    latest scraped_at kept; among equal times the higher price, so that the result does not depend on the order of rows.
    Rows without snapshot_id, source or listing_id have no key and are left out."""
    cents = F.round(F.when(~F.isnan("price_eur"), F.col("price_eur")) * 100).cast("long")
    df = snapshots.select("snapshot_id", "source", F.lower(F.trim("listing_id")).alias("listing_id"), "scraped_at", cents.alias("cents")).dropna(subset=["snapshot_id", "source", "listing_id"])
    best = F.max(F.struct("scraped_at", F.coalesce("cents", F.lit(-1)).alias("tie"), "cents"))
    return df.groupBy("snapshot_id", "source", "listing_id").agg(best.alias("b")).select("snapshot_id", "source", "listing_id", F.col("b.cents").alias("cents"))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """The adverts added, removed or changed in price between each delivery of a source and that source's next.

    Out: source, listing_id, snapshot_id (the later delivery), change_kind, old_cents, new_cents. A source's first
    delivery has no cases; a source that skips a delivery is compared with its last one. One delivery at a time: the
    index of the last state is probed with the new rows by hash, old values are fetched for the adverts whose hash
    differs (which also settles hash collisions), and the index is swapped. Empty input gives an empty result.
    """
    spark = snapshots.sparkSession
    # one bucket for ROWS_PER_BUCKET rows of all deliveries, however many that makes; few for small tables, so that these do
    # not become many tiny files
    buckets = max(LEAST_BUCKETS, -(-snapshots.count() // ROWS_PER_BUCKET))
    name, path = f"lonja_deliveries_{uuid.uuid4().hex[:12]}", fresh_path(spark, "deliveries")
    prepared = prepare_deliveries(snapshots).withColumn("h", F.xxhash64(F.coalesce("cents", F.lit(-1)), F.col("cents").isNull()))
    prepared = prepared.repartition(buckets, "source", "listing_id")
    prepared.write.format("parquet").partitionBy("snapshot_id").bucketBy(buckets, "source", "listing_id").sortBy("source", "listing_id").option("path", path).saveAsTable(name)
    rows = spark.table(name)
    delivered = [(r.snapshot_id, set(r.sources)) for r in rows.groupBy("snapshot_id").agg(F.collect_set("source").alias("sources")).orderBy("snapshot_id").collect()]
    out = fresh_path(spark, "changes")
    spark.createDataFrame([], _with_id()).write.mode("overwrite").parquet(out)
    index = SnapshotIndex(spark, buckets)
    known: set[str] = set()
    last: dict[str, int] = {}
    for sid, sources in delivered:
        new = rows.where(F.col("snapshot_id") == sid).select("source", "listing_id", "h", F.col("snapshot_id").alias("at"), "cents")
        if index.name is None:
            index.swap(new.drop("cents"))
            known |= sources
            last |= dict.fromkeys(sources, sid)
            continue
        old = index.read()
        j = old.alias("o").join(new.alias("n"), ["source", "listing_id"], "full_outer")
        here = F.col("source").isin(*sources)
        kind = F.when(F.col("n.h").isNull(), F.when(here, F.lit("removed"))).when(F.col("o.h").isNull(), F.when(F.col("source").isin(*known) if known else F.lit(False), F.lit("added"))).when(F.col("o.h") != F.col("n.h"), F.lit("changed"))
        # the new value comes along with the probe; what is found is written first, so that its size is known where the old
        # values are fetched: those of changed and removed adverts only, from the deliveries this one follows
        probed = j.select("source", "listing_id", kind.alias("change_kind"), F.col("o.at").alias("old_at"), F.col("n.cents").alias("new_cents"))
        found = materialise(probed.where(F.col("change_kind").isNotNull()), "found")
        before = sorted({last[x] for x in sources if x in last})  # usually one or two
        olds = rows.where(F.col("snapshot_id").isin(*before) if before else F.lit(False)).select("source", "listing_id", F.col("snapshot_id").alias("old_at"), F.col("cents").alias("old_cents"))
        fetched = found.where("change_kind <> 'added'").join(olds, ["source", "listing_id", "old_at"], "left").where((F.col("change_kind") != "changed") | ~F.col("old_cents").eqNullSafe(F.col("new_cents")))
        added = found.where("change_kind = 'added'").withColumn("old_cents", F.lit(None).cast("long"))
        fetched = fetched.unionByName(added)
        fetched.select("source", "listing_id", F.lit(sid).cast("int").alias("snapshot_id"), "change_kind", "old_cents", "new_cents").write.mode("append").parquet(out)
        # swap: the new rows, and the state of the sources that delivered nothing this time
        index.swap(j.where(F.col("n.h").isNotNull() | ~here).select("source", "listing_id", F.coalesce("n.h", "o.h").alias("h"), F.coalesce("n.at", "o.at").alias("at")))
        known |= sources
        last |= dict.fromkeys(sources, sid)
    if index.name:
        spark.sql(f"DROP TABLE IF EXISTS {index.name}")
        delete_path(spark, index.path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete_path(spark, path)
    return spark.read.schema(_with_id()).parquet(out)


def _with_id() -> T.StructType:
    return T.StructType([CHANGES["source"], CHANGES["listing_id"], T.StructField("snapshot_id", T.IntegerType()), CHANGES["change_kind"], CHANGES["old_cents"], CHANGES["new_cents"]])
