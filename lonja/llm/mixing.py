"""Mixing sources to target weights along a curriculum: integrate each source's weight, invert, range-sort by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.ranks import sliced
from lonja.session import materialise

#: How far the weights of the sources lean over the run: weight(t) = share * (1 + lean * (2 t - 1)), lean from -1 (early) to 1.
LEAN = 0.6
#: Share of a source's demand that may be missing before a further text joins; and rounds after which that is an error.
MISS, MOST_ROUNDS = 1e-4, 100


def length_leans(per_source: dict[str, tuple[int, int]]) -> dict[str, float]:
    """The default curriculum: sources of short texts early, of long ones late, evenly spaced by the rank of their mean
    number of tokens. per_source: tokens and texts."""
    order = sorted((s for s, (_, n) in per_source.items() if n), key=lambda s: (per_source[s][0] / per_source[s][1], s))
    return {s: LEAN * (2 * i / (len(order) - 1) - 1) if len(order) > 1 else 0.0 for i, s in enumerate(order)}


def mix_plan(totals: dict[str, int], targets: dict[str, tuple[float, int]], lean: dict[str, float], total_tokens: int | None = None) -> dict[str, dict]:
    """Demand, lean and share of each source. A source without tokens leaves its share to the others in proportion.

    Without `total_tokens` the mixture is the largest one that keeps every source within its repeats. Leans are shifted by
    their mean so that the weights add up to 1 at every moment, and shrunk so that none is negative.
    """
    live = {s: x for s, (x, _) in targets.items() if totals.get(s, 0) > 0 and x > 0}
    whole = sum(live.values())
    if not live:
        return {}
    share = {s: x / whole for s, x in live.items()}
    room = min(totals[s] * targets[s][1] / share[s] for s in live)
    size = min(room, total_tokens) if total_tokens else room
    mean = sum(share[s] * lean.get(s, 0.0) for s in live)
    a = {s: lean.get(s, 0.0) - mean for s in live}
    most = max(1.0, *(abs(x) for x in a.values()))
    return {s: {"share": share[s], "demand": share[s] * size, "lean": a[s] / most, "tokens": totals[s], "size": size} for s in live}


def mix(docs: DataFrame, targets: DataFrame, lean: dict[str, float] | None = None, total_tokens: int | None = None) -> DataFrame:
    """position, source, doc_id, use, n_tokens: the mixture in training order; docs(doc_id, source, n_tokens).

    Each source's texts stand in a fixed hashed order; use u of a text covers the source's tokens [u * tokens + before,
    ... + n_tokens). A use is taken if it ends within the source's demand; then further texts join until
    no more than MISS is missing or none comes nearer, each the one that comes nearest to what the demand still lacks. No text is used more than max_repeats times. The time t at which the source's cumulative weight
    share * (t + lean * (t * t - t)) reaches the place is its position, in tokens of the mixture. Texts of no tokens, of
    a null source or of a source without target are not part of the mixture. Empty input gives an empty result.
    """
    spark = docs.sparkSession
    t = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.where("source is not null").collect()}  # the reference list of sources
    docs = materialise(docs.where(F.col("source").isin(*t) & (F.col("n_tokens") > 0)).select("doc_id", "source", "n_tokens"), "mixdocs")
    per = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()
    plan = mix_plan({r.source: r.tokens for r in per}, t, length_leans({r.source: (r.tokens, r.n) for r in per}) if lean is None else lean, total_tokens)
    rows = [(s, p["demand"], p["lean"], p["share"], p["tokens"], p["size"], t[s][1]) for s, p in plan.items()]
    plans = spark.createDataFrame(rows, "p_source string, demand double, lean double, share double, tokens bigint, size double, max_repeats int")
    placed = sliced(docs, "source", ["doc_id"], sum(r.n for r in per), "n_tokens").join(plans, F.col("source") == F.col("p_source"))
    last = F.least(F.ceil(F.col("demand") / F.col("tokens")), F.col("max_repeats")).cast("int") - 1
    uses = placed.select("*", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).alias("use"))
    uses = uses.withColumn("end", F.col("use") * F.col("tokens") + F.col("before") + F.col("n_tokens"))
    materialised = materialise(uses.drop("p_source"), "uses")
    taken = materialised.where(F.col("end") <= F.col("demand"))
    uses = taken.withColumn("end", F.col("end").cast("double"))
    extra = _top_up(materialised, taken, {s: p["demand"] for s, p in plan.items()})
    if extra:
        few = spark.createDataFrame(extra, "source string, doc_id bigint, use int, place double")
        late = materialised.join(few, ["source", "doc_id", "use"]).withColumn("end", F.col("place") + F.col("n_tokens")).drop("place")
        uses = uses.unionByName(late)
    uses = uses.withColumn("at", F.least(F.col("end") - F.col("n_tokens") / 2, F.col("demand")))
    # invert x = t + lean * (t^2 - t) for x = at / demand
    x, b = F.col("at") / F.col("demand"), 1 - F.col("lean")
    time = F.when(F.abs("lean") < 1e-9, x).otherwise(2 * x / (b + F.sqrt(F.greatest(b * b + 4 * F.col("lean") * x, F.lit(0.0)))))
    out = uses.select(F.floor(time * F.col("size")).cast("long").alias("position"), "source", "doc_id", "use", "n_tokens")
    return out.orderBy("position", "source", "doc_id", "use")


def _top_up(uses: DataFrame, taken: DataFrame, demand: dict[str, float]) -> list[tuple]:
    """(source, doc_id, use, place) of further texts: in each round the one text of each source, from beyond its demand,
    that comes nearest to what it lacks. One row a source and round reaches the driver."""
    upto = {r.source: r.upto for r in taken.groupBy("source").agg(F.max("end").alias("upto")).collect()}
    lack = {s: d - (upto.get(s) or 0) for s, d in demand.items()}
    chosen: list[tuple] = []
    spark = uses.sparkSession
    for turn in range(MOST_ROUNDS + 1):
        open_ = [(s, float(x)) for s, x in lack.items() if x >= max(1.0, MISS * demand[s])]
        if not open_:
            break
        if turn == MOST_ROUNDS:
            raise RuntimeError("the sources do not come near their demand")
        table = spark.createDataFrame(open_, "source string, lack double")
        left = uses.where(F.col("end") > F.col("demand")).join(table, "source")
        if chosen:
            left = left.join(spark.createDataFrame([c[:3] for c in chosen], "source string, doc_id bigint, use int"), ["source", "doc_id", "use"], "left_anti")
        gap = F.abs(F.col("n_tokens") - F.col("lack"))
        got = left.where(gap < F.col("lack")).groupBy("source").agg(F.min(F.struct(gap.alias("gap"), "doc_id", "use", "n_tokens")).alias("b")).collect()
        for r in got:
            chosen.append((r.source, r.b.doc_id, r.b.use, demand[r.source] - lack[r.source]))
            lack[r.source] -= r.b.n_tokens
        if not got:
            break
    return chosen


def reached_shares(mixture: DataFrame, targets: DataFrame, phases: int = 4) -> DataFrame:
    """source, target_share, reached_share, tokens, texts, most_uses and the share in each phase of the run."""
    end = mixture.agg(F.max("position").alias("end"))
    m = mixture.join(end, F.lit(True))  # one row
    m = m.withColumn("phase", F.least(F.floor(F.col("position") * phases / (F.col("end") + 1)), F.lit(phases - 1)))
    per = m.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts"), (F.max("use") + 1).alias("most_uses"),
        *[F.sum(F.when(F.col("phase") == i, F.col("n_tokens")).otherwise(0)).alias(f"t{i}") for i in range(phases)],
    )
    whole = per.agg(F.sum("tokens").alias("all"), *[F.sum(f"t{i}").alias(f"all{i}") for i in range(phases)])
    per = targets.select("source", "target_share").join(per, "source", "left").join(whole, F.lit(True))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return per.select(
        "source", "target_share", (z("tokens") / F.col("all")).alias("reached_share"), z("tokens").alias("tokens"), z("texts").alias("texts"), z("most_uses").alias("most_uses"),
        *[(z(f"t{i}") / F.nullif(f"all{i}", F.lit(0))).alias(f"share_phase_{i + 1}") for i in range(phases)],
    )
