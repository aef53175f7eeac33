"""Summaries and profiles: price statistics, frequency tables, quartiles and outliers, nearest neighbours on a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.operators.matching import cents


def price_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean, least and greatest price by group; a price of zero is no price."""
    p = F.nullif(F.when(~F.isnan("price_eur"), F.col("price_eur")), F.lit(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("listings"), F.count(p).alias("priced"), (F.sum(cents(p)) / 100.0 / F.nullif(F.count(p), F.lit(0))).alias("average"), F.min(p).alias("least"), F.max(p).alias("greatest"))


def comparison_summary(stats: DataFrame) -> DataFrame:
    """One row over the statistics of all targets: how many have a reference of each level, and their mean figures."""
    return stats.agg(
        F.count("*").alias("targets"), *[F.count_if(F.col("level") == lv).alias(f"{lv}_targets") for lv in ("exact", "near", "broad")],
        F.coalesce(F.sum("n"), F.lit(0)).alias("comparables"), F.max("n").alias("largest_sample"), (F.sum(cents(F.col("median"))) / 100.0 / F.nullif(F.count("median"), F.lit(0))).alias("mean_median"),
    )


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, value, rows, percent of the rows: one pass over all columns (an unpivot before one aggregate)."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("value")) for c in columns])
    per = df.select(F.inline(cells)).groupBy("field", "value").agg(F.count("*").alias("rows"))
    return per.withColumn("percent", F.bround((F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy("field"))).cast("decimal(18,10)"), 2).cast("double"))


def quartile_outliers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles by linear interpolation, and the number of values beyond 1.5 interquartile ranges."""
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    q = df.where(v.isNotNull()).groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(*[F.col(b).alias(f"_{b}") for b in by], F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"))
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    j = df.where(v.isNotNull()).join(q, on)
    iqr = F.col("q3") - F.col("q1")
    return j.groupBy(*by, "q1", "q2", "q3").agg(F.count("*").alias("n"), F.count_if((F.col(value) < F.col("q1") - 1.5 * iqr) | (F.col(value) > F.col("q3") + 1.5 * iqr)).alias("outliers"))


def catalogue(df: DataFrame, top: str, sub: str) -> DataFrame:
    """Sorted entries with their number of sub-entries and rows."""
    return df.where(F.col(top).isNotNull()).groupBy(top).agg(F.countDistinct(sub).alias("entries"), F.count("*").alias("rows")).orderBy(top)


#: Entries of a reference list that is looked up by containment in whole, at most.
MOST_ENTRIES = 100_000


def catalogue_names(df: DataFrame, top: str, sub: str) -> DataFrame:
    """top, names: the sub-entries of each entry, sorted, each once, joined by commas; the names of a catalogue, not its rows,
    meet in one array."""
    per = df.where(F.col(top).isNotNull()).groupBy(F.col(top).alias("top"), F.col(sub).alias("sub")).agg(F.lit(1))
    return per.groupBy("top").agg(F.nullif(F.array_join(F.array_sort(F.collect_list("sub")), ","), F.lit("")).alias("names"))


def lookup_within(wanted: DataFrame, entries: DataFrame, within: str) -> DataFrame:
    """within, wanted, id, how: the entry of the same `within` (letter case aside) with the same name; else the first that
    holds it or is held by it. All joins are on `within`, and names are distinct before they meet."""
    e = entries.where("name is not null").select(F.lower(within).alias("_e"), "id", F.lower("name").alias("n")).distinct()
    w = wanted.where("wanted is not null").select(F.lower(within).alias(within), "wanted", F.lower(F.trim("wanted")).alias("w")).distinct()
    same = w.join(e, (F.col(within) == F.col("_e")) & (F.col("w") == F.col("n"))).groupBy(within, "wanted").agg(F.min("id").alias("id"), F.lit("equal").alias("how"))
    rest = w.where("w <> ''").join(same, [within, "wanted"], "left_anti")
    part = rest.join(e, (F.col(within) == F.col("_e")) & (F.col("n").contains(F.col("w")) | F.col("w").contains(F.col("n")))).groupBy(within, "wanted").agg(F.min("id").alias("id"), F.lit("part").alias("how"))
    return same.unionByName(part)


def catalogue_lookup(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """wanted, id: the entry with the same name, letter case aside; else the first that holds it or is held by it.

    The first pass is an equi-join. Only the distinct names it leaves meet the entries by containment: either holds a
    triple of letters of the other, so they are joined on triples, and names under three letters with the whole list,
    which is a reference list of at most MOST_ENTRIES (more raise)."""
    e = entries.where("name is not null").select(F.col("id"), F.lower("name").alias("n")).distinct()
    w = wanted.select("wanted", F.lower(F.trim("wanted")).alias("w")).distinct()
    same = w.join(e, F.col("w") == F.col("n")).groupBy("wanted").agg(F.min("id").alias("id"), F.lit("equal").alias("how"))
    rest = w.where("w <> ''").join(same, "wanted", "left_anti")
    triples = lambda c: F.array_distinct(F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, F.lit(3)))))
    held = F.col("n").contains(F.col("w")) | F.col("w").contains(F.col("n"))
    long = rest.select("wanted", "w", F.explode(triples("w")).alias("g")).join(e.select("id", "n", F.explode(triples("n")).alias("g")), "g").where(held).select("wanted", "id")
    if e.where("n <> ''").limit(MOST_ENTRIES + 1).count() > MOST_ENTRIES:
        raise ValueError("the entries are no reference list")
    short = rest.join(F.broadcast(e), held & ((F.length("w") < 3) | (F.length("n") < 3))).select("wanted", "id")
    part = long.unionByName(short).groupBy("wanted").agg(F.min("id").alias("id"), F.lit("part").alias("how"))
    return same.unionByName(part)


def nearest_values(df: DataFrame, by: str, value: str, to: float, k: int = 5) -> DataFrame:
    """The k distinct values of each group nearest to a figure, nearest first, the smaller among equals."""
    w = Window.partitionBy(by).orderBy(F.abs(F.col(value) - to), value)
    return df.where(F.col(value).isNotNull()).select(by, value).distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
