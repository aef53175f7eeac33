"""Queries p5_, p8_ and p9_: percentiles, packing and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm.canon_text import consistent
from lonja.llm.canonical_values import map_values
from lonja.llm.mixing import mix, reached_shares
from lonja.llm.packing import CAPACITY, pack
from lonja.llm.percentiles import percentiles, rank_misses
from lonja.llm.tokens import with_tokens
from lonja.session import table

QS = [0.05, 0.25, 0.5, 0.75, 0.95]


def p5_price_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of price_eur by make and model, merged from one sketch a day. The make is the canonical entry where
    there is one; the model is its consistent form in lower case."""
    rows = table(spark, d, "listings").select("make", "model", "price_eur", F.to_date("scraped_at").alias("day"))
    canon = table(spark, d, "canonical_values").where("list_name = 'make'")
    makes = map_values(rows.select(F.lit("make").alias("list_name"), F.col("make").alias("value")), canon)
    names = makes.join(canon, ["list_name", "canon_id"]).select(F.col("value").alias("make"), "canon_value")
    rows = rows.join(names, "make", "left").select(F.coalesce("canon_value", F.trim("make")).alias("make"), F.lower(F.trim(consistent(F.col("model")))).alias("model"), "day", "price_eur")
    return percentiles(rows, ["make", "model"], "price_eur", QS, part="day")


def p5_source_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of price_eur by source, exact up to the size of one buffer."""
    return percentiles(table(spark, d, "listings"), ["source"], "price_eur", QS).select("source", "n", *[f"p{round(q * 100):02d}" for q in QS])


def p5_bound_check(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of all snapshot prices by source, from buffers so small that they collapse many times: whether they did,
    and whether each value lies within the stated bound of its rank by an exact count."""
    rows = table(spark, d, "listing_snapshots")
    got = percentiles(rows, ["source"], "price_eur", QS, k=64)
    return rank_misses(rows, ["source"], "price_eur", got, QS).select("source", "n", (F.col("rank_error") > 0).alias("collapsed"), (F.col("miss") <= F.col("rank_error")).alias("within_bound"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return with_tokens(table(spark, d, "documents"), ["doc_id", "source"])


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sizes(spark, d))[0]


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """What the containers came to: number, tokens, share filled, the least possible number, containers fixed by dominance."""
    placed, plan = pack(_sizes(spark, d))
    per = placed.where("size > 0").groupBy("container_id").agg(F.sum("size").alias("used"))
    tokens = F.coalesce(F.sum("used"), F.lit(0))
    return per.agg(F.count("*").alias("containers"), tokens.alias("tokens"), F.max("used").alias("fullest")).select(
        "containers", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * CAPACITY)).alias("filled_share"), F.ceil(F.col("tokens") / CAPACITY).alias("least_containers"), F.lit(plan.fixed).alias("fixed_containers")
    )


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sizes(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return reached_shares(mix(_sizes(spark, d), targets), targets)


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether all containers keep to their capacity, all tokens of every text are placed once, and only texts longer than a
    container are split."""
    sizes = _sizes(spark, d).select("doc_id", "n_tokens")
    placed = pack(sizes)[0]
    full = placed.groupBy("container_id").agg(F.sum("size").alias("used")).agg(F.coalesce(F.max("used") <= CAPACITY, F.lit(True)).alias("within_capacity"))
    per = sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).join(placed.groupBy("doc_id").agg(F.sum("size").alias("put"), F.count("*").alias("pieces")), "doc_id", "left")
    whole = per.agg(F.count("*").alias("texts"), F.min(F.coalesce(F.col("put") == F.col("n"), F.lit(False))).alias("all_placed"), F.min((F.col("n") > CAPACITY) | (F.col("pieces") == 1)).alias("none_split"))
    return full.join(whole, F.lit(True)).select("texts", "within_capacity", "all_placed", "none_split")


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """For each target: whether no text is used more than allowed, and whether the share reached lies within one text of it."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    got = mix(sizes, targets)
    total, longest = got.agg(F.sum("n_tokens").alias("all")), sizes.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    uses = got.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("n")).groupBy("source").agg(F.max("uses").alias("most"), F.sum("n").alias("n"))
    j = targets.join(uses, "source", "left").join(longest, "source", "left").join(total, F.lit(True))
    return j.select("source", (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("n") - F.col("target_share") * F.col("all")) <= F.col("longest")).alias("share_within_a_text"))


QUERIES = {"p5_price_percentiles": p5_price_percentiles, "p5_source_percentiles": p5_source_percentiles, "p5_bound_check": p5_bound_check, "p8_pack": p8_pack, "p8_fill": p8_fill, "p8_check": p8_check, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_check": p9_check}
ORACLE = {
    "p5_bound_check": "SELECT source, count(*) AS n, count(*) >= 128 AS collapsed, true AS within_bound FROM listing_snapshots WHERE price_eur IS NOT NULL GROUP BY source",
    "p8_check": "SELECT count(DISTINCT doc_id) AS texts, true AS within_capacity, true AS all_placed, true AS none_split FROM documents",
    "p9_check": "SELECT source, true AS within_repeats, true AS share_within_a_text FROM mix_targets",
    "p5_source_percentiles": "SELECT source, count(*) AS n, " + ", ".join(f"quantile_disc(price_eur, {q}) AS p{round(q * 100):02d}" for q in QS) + " FROM listings WHERE price_eur IS NOT NULL GROUP BY source",
}
