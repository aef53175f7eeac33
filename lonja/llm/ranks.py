"""Exact ranks and running totals within groups of any size: slices by hash, totals of slices, windows inside slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows a slice of one group should hold; the number of slices follows the rows, so no task holds a hot group.
SLICE_ROWS = 50_000


def sliced(df: DataFrame, group: str, order: list[str], rows: int, total: str | None = None) -> DataFrame:
    """Adds `rank` (0, 1, ... within the group) and, with `total`, `before` (the sum of `total` over earlier rows).

    Rows are ordered by a hash of `order` and then by `order`, which must be unique within a group. A group is cut into
    slices of the hash range; each slice's size and total are added up over the slices (a table of groups x slices), and
    the window functions run inside one slice.
    """
    n = max(1, -(-rows // SLICE_ROWS))
    cut = df.withColumn("_h", F.xxhash64(*order)).withColumn("_s", (F.shiftrightunsigned(F.col("_h"), 1) / F.lit(float(2**63)) * n).cast("int"))
    aggs = [F.count("*").alias("_n")] + ([F.sum(total).alias("_t")] if total else [])
    per = cut.groupBy(F.col(group).alias("_g"), F.col("_s").alias("_ps")).agg(*aggs)
    w = Window.partitionBy("_g").orderBy("_ps").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_g", "_ps", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"), *([F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_toff")] if total else []))
    inner = Window.partitionBy(group, "_s").orderBy("_h", *order)
    cut = cut.withColumn("_r", F.row_number().over(inner) - 1)
    if total:
        cut = cut.withColumn("_run", F.coalesce(F.sum(total).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = cut.join(per, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_ps")))
    out = out.withColumn("rank", F.col("_r") + F.col("_off"))
    if total:
        out = out.withColumn("before", F.col("_run") + F.col("_toff"))
    return out.drop("_h", "_s", "_r", "_run", "_g", "_ps", "_off", "_toff")
