"""Per-key sequences: an exact sliding-window limiter, offered load, and the market history of adverts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Windows that a slice of a key's time covers.
WINDOWS_PER_SLICE = 100


def offered_load(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Adds the number of the key's events in the last `seconds`, this one included. Keys are cut into slices of time; what
    the start of a slice has to look back on is copied into it, so a hot key is shared out over its slices. Null times have
    a load of null."""
    at, width = F.unix_micros(F.col(ts).cast("timestamp")), seconds * WINDOWS_PER_SLICE * 1_000_000
    own = df.withColumn("_at", at).withColumn("_slice", F.floor(F.col("_at") / width))
    into_next = F.col("_at") - F.col("_slice") * width > width - seconds * 1_000_000
    copies = F.when(into_next, F.array(F.struct(F.col("_slice").alias("s"), F.lit(False).alias("copy")), F.struct((F.col("_slice") + 1).alias("s"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("_slice").alias("s"), F.lit(False).alias("copy"))))
    cut = own.withColumn("_c", F.explode(copies))
    w = Window.partitionBy(key, F.col("_c.s")).orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return cut.withColumn("load", F.when(F.col("_at").isNotNull(), F.count("_at").over(w))).where(~F.col("_c.copy")).drop("_at", "_slice", "_c")


class Limiter:
    """Accepts at most `limit` events in any window; a rejected event is not counted."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds, self.kept = limit, seconds, deque()

    def accept(self, at: float) -> bool:
        while self.kept and self.kept[0] <= at - self.seconds:
            self.kept.popleft()
        if len(self.kept) >= self.limit:
            return False
        self.kept.append(at)
        return True


def rate_limit(df: DataFrame, key: str, ts: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """Adds `accepted`. Whether an event counts depends on all earlier decisions, so keys stream through sorted
    partitions; a task holds one key's window of at most `limit` times, never a key's events."""
    sorted_ = df.repartition(F.col(key)).sortWithinPartitions(key, ts, tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, lim = object(), Limiter(limit, seconds)
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[ts]):
                if k != last:
                    last, lim = k, Limiter(limit, seconds)
                out.append(lim.accept(t.value / 1e9))
            yield pdf.assign(accepted=out)

    return sorted_.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("accepted", T.BooleanType())]))


def advert_history(snapshots: DataFrame) -> DataFrame:
    """source, listing_id, first and last delivery, deliveries seen, spells (a gap starts a new one), first and last price,
    number of price changes and days between first and last sight."""
    key = ["source", "listing_id"]
    cents = F.round(F.when(~F.isnan("price_eur"), F.col("price_eur")) * 100).cast("bigint")
    base = snapshots.select("snapshot_id", "snapshot_date", "source", F.lower(F.trim("listing_id")).alias("listing_id"), "scraped_at", cents.alias("cents"))
    one = base.groupBy("snapshot_id", "snapshot_date", *key).agg(F.max_by("cents", F.struct("scraped_at", F.coalesce("cents", F.lit(-1)))).alias("cents"))
    turn = one.select("source", "snapshot_id").distinct().withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("snapshot_id")))
    w = Window.partitionBy(*key).orderBy("snapshot_id")
    s = one.join(turn, ["source", "snapshot_id"]).withColumn("before", F.lag("turn").over(w)).withColumn("old", F.lag("cents").over(w))
    seen = F.col("before").isNotNull()
    return s.groupBy(*key).agg(
        F.min("snapshot_id").alias("first_seen"), F.max("snapshot_id").alias("last_seen"), F.count("*").alias("deliveries"),
        (F.count_if(~seen | (F.col("turn") - F.col("before") > 1))).alias("spells"), F.min_by("cents", "snapshot_id").alias("first_cents"), F.max_by("cents", "snapshot_id").alias("last_cents"),
        F.count_if(seen & ~F.col("cents").eqNullSafe(F.col("old"))).alias("price_changes"), F.date_diff(F.max("snapshot_date"), F.min("snapshot_date")).alias("days"),
    )
