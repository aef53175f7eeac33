"""Matching entities across sources without keys: similarity vectors, a regularised Gaussian mixture without labels,
and transitivity inside expectation-maximisation.

Two official rows are different things, so if a vehicle matched both they would have to be one: the posteriors of a
vehicle's candidates share one unit of probability with the case that none fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.canonical_values import map_values, normal_udf
from lonja.llm.vehicle_text import Lexicon, model_likeness, read, tokens
from lonja.session import materialise

# Official fuel codes and the words that stand for them in the fiscal input.
FUEL_CODES = {
    "G": ["g", "gasolina", "gasoline", "petrol", "benzin"], "D": ["d", "diesel", "gasoil", "gasoleo"], "Elc": ["elc", "ev", "electrico", "electric"],
    "GyE": ["gye", "hibrido", "hybrid"], "PHEV": ["phev", "hibrido enchufable", "enchufable"], "S": ["s", "glp", "gnc", "gas natural", "autogas"],
}
FEATURES = ("model", "trim", "drive", "displacement", "power", "gearbox")
#: Likeness given where one side lacks the attribute.
UNKNOWN = 0.7
ROUNDS = 12
MODEL_LEAST = 0.75
#: Model names of the official table, at most: they are broadcast.
MOST_MODELS = 200_000
SCHEMA_PARSE = "litres double, cc int, kw double, drive string, trim string, trim_sim double, gear string, models array<struct<model:string,sim:double>>"


def learn_lexicon(official: DataFrame) -> Lexicon:
    """Drive words (those with one fuel code in many brands), trims (what follows them) and models (what stands before)
    of the official rows(brand_key, model_type, fuel_code). Only word counts reach the driver."""
    t = official.select("brand_key", "fuel_code", F.split(F.lower(normal_words("model_type")), " ").alias("w"))
    word = t.select("brand_key", "fuel_code", F.explode(F.array_distinct("w")).alias("word")).where(~F.col("word").rlike(r"^\d|^$"))
    per = word.groupBy("word", "fuel_code").agg(F.count("*").alias("n"), F.collect_set("brand_key").alias("brands"))
    per = per.groupBy("word").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("fuel_code", "n").alias("fuel"), F.size(F.array_distinct(F.flatten(F.collect_list("brands")))).alias("brands"))
    drive = {r.word: r.fuel for r in per.where("n >= 15 and top >= 0.97 * n and brands >= 4").collect()}
    if not drive:
        return Lexicon()
    at = F.array_position("w", F.try_element_at(F.array_intersect("w", F.array(*map(F.lit, drive))), F.lit(1)))
    t = t.withColumn("at", at.cast("int")).where("at > 0")
    after = F.filter(F.slice("w", F.col("at") + 1, 3), lambda x: ~x.rlike(r"^\d"))
    trims = [r.trim for r in t.select(F.try_element_at(after, F.lit(1)).alias("trim")).where("trim is not null").groupBy("trim").count().where("count >= 5").select("trim").collect()]
    before = F.filter(F.slice("w", 1, F.greatest(F.col("at") - 1, F.lit(0))), lambda x: ~x.rlike(r"^\d[.,]\d"))
    models = t.select("brand_key", F.array_join(before, " ").alias("model")).where("model <> ''").distinct().limit(MOST_MODELS + 1).collect()
    if len(models) > MOST_MODELS:
        raise ValueError("the official table is no reference table")
    by: dict[str, list[str]] = {}
    for r in models:
        by.setdefault(r.brand_key, []).append(r.model)
    return Lexicon(drive, tuple(sorted(trims)), {k: sorted(v) for k, v in by.items()})


def normal_words(c: str):
    @F.pandas_udf("string")
    def words(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else " ".join(tokens(x)))

    return words(F.col(c))


def parse(df: DataFrame, text: str, lex: Lexicon, own_model: bool = False) -> DataFrame:
    """Adds the readings of a text and all models of the row's brand that it may name, from MODEL_LEAST on; of a text that is
    of one model (`own_model`) the likest, of equal ones the longest."""
    lexicon = df.sparkSession.sparkContext.broadcast(lex)

    @F.pandas_udf(SCHEMA_PARSE)
    def run(texts: pd.Series, brands: pd.Series) -> pd.DataFrame:
        lx, out = lexicon.value, []
        for t, b in zip(texts, brands):
            r = read(t, lx)
            near = [{"model": m, "sim": s} for m in lx.models.get(b, ()) if (s := model_likeness(r.rest, m)) >= MODEL_LEAST]
            if own_model:
                near = sorted(near, key=lambda x: (-x["sim"], -len(x["model"]), x["model"]))[:1]
            out.append((r.litres, r.cc, r.kw, r.drive, r.trim, r.trim_sim, r.gear, near))
        cols = [x.split()[0] for x in SCHEMA_PARSE.split(", ")]
        pdf = pd.DataFrame(out, columns=cols)
        pdf["cc"] = pdf["cc"].astype("Int32")
        return pdf

    return df.withColumn("r", run(F.col(text), F.col("brand_key"))).select("*", "r.*").drop("r")


def brand_map(frames: list[tuple[DataFrame, str]], canon: DataFrame) -> DataFrame:
    """brand, brand_key of every typed brand of several frames, settled in one go: the canonical entry, or the normal form
    of a brand without one."""
    values = None
    for df, c in frames:
        one = df.select(F.lit("make").alias("list_name"), F.col(c).alias("value"))
        values = one if values is None else values.union(one)
    mapped = map_values(values, canon)
    key = F.when(F.col("canon_id") >= 0, F.col("canon_id").cast("string")).otherwise(normal_udf("value"))
    return materialise(mapped.select(F.col("value").alias("brand_value"), key.alias("brand_key")), "brands")


def with_brand_key(df: DataFrame, brand: str, brands: DataFrame) -> DataFrame:
    return df.join(brands, F.col(brand) == F.col("brand_value"), "left").drop("brand_value")


def candidates(vehicles: DataFrame, official: DataFrame, canon: DataFrame) -> DataFrame:
    """vk, cands: per distinct vehicle description, the official rows of its brand and model in whose commercial period
    its registration lies, with the similarity vector of each. A description's candidates are at most the official rows
    of its brand, so the array is bounded by the reference table."""
    brands = brand_map([(official, "brand"), (vehicles, "marca")], canon)
    off = materialise(with_brand_key(official.where("id is not null and model_type is not null"), "brand", brands).select("id", "brand_key", "model_type", "commercial_start", "commercial_end", "displacement_cc", "fuel_code", "power_kw", "power_cv"), "official")
    lex = learn_lexicon(off)
    off = parse(off, "model_type", lex, own_model=True).select(
        "id", "brand_key", F.try_element_at("models", F.lit(1)).model.alias("model"), "commercial_start", "commercial_end",
        F.col("displacement_cc").alias("b_cc"), "fuel_code", F.coalesce(F.col("power_kw").cast("double"), F.col("power_cv") * F.lit(0.735499)).alias("b_kw"),
        F.col("drive").alias("b_drive"), F.col("trim").alias("b_trim"),
        F.when(F.col("fuel_code").isin("Elc", "PHEV"), F.lit("automatic")).otherwise(F.coalesce("gear", F.lit("manual"))).alias("b_gear"), F.col("litres").alias("b_litres"),
    )
    v = with_brand_key(vehicles, "marca", brands).where("brand_key is not null")
    v = parse(v, "modelo", lex)
    fuel = F.lower(F.translate("combustible", "áéíóúÁÉÍÓÚ", "aeiouAEIOU"))
    code = F.lit(None).cast("string")
    for k, words in FUEL_CODES.items():
        code = F.when(fuel.isin(*words), F.lit(k)).otherwise(code)
    v = v.withColumn("v_fuel", code).withColumn("m", F.explode("models"))
    drive_fuel = F.create_map(*[F.lit(x) for kv in (lex.drive or {"": ""}).items() for x in kv])
    p = v.join(off, (v.brand_key == off.brand_key) & (v.m.model == off.model)).drop(off.brand_key)
    p = p.where((F.col("year") >= F.coalesce("commercial_start", F.lit(0))) & (F.col("year") <= F.coalesce("commercial_end", F.lit(9999))))

    unknown = F.lit(UNKNOWN)
    trim = F.when(F.col("trim").isNull() | F.col("b_trim").isNull(), unknown).when(F.col("trim") == F.col("b_trim"), F.col("trim_sim")).otherwise(0.0)
    v_drive_fuel = drive_fuel[F.col("drive")]
    drive = F.when(F.col("drive").isNotNull() & F.col("b_drive").isNotNull(), F.when(F.col("drive") == F.col("b_drive"), 1.0).otherwise(0.0)) \
        .when(F.col("v_fuel").isNull(), unknown).when(F.col("v_fuel") == F.col("fuel_code"), 0.95) \
        .when((F.col("v_fuel") == "G") & F.col("fuel_code").isin("GyE", "PHEV", "S"), unknown).otherwise(0.0)
    drive = F.when(v_drive_fuel.isNotNull() & (v_drive_fuel != F.col("fuel_code")), 0.0).otherwise(drive)
    cc = F.coalesce(F.col("cilindrada_cc").cast("double"), F.col("cc").cast("double"))
    gap_cc = F.abs(cc - F.col("b_cc"))
    b_litres = F.coalesce(F.col("b_litres"), F.round(F.col("b_cc") / 1000.0, 1))
    by_cc = F.when(gap_cc <= 55, 1 - gap_cc / 275).when(gap_cc > 55, F.greatest(F.lit(0.0), 0.5 - gap_cc / 500))
    gap_l = F.abs(F.col("litres") - b_litres)
    by_litres = F.when(gap_l < 0.06, 1.0).when(gap_l >= 0.06, 0.0)
    disp = F.when(F.col("b_cc").isNull(), F.when(cc.isNull() & F.col("litres").isNull(), 1.0).otherwise(0.0)).otherwise(F.coalesce(F.least(by_cc, by_litres), unknown))
    gap = lambda kw: F.abs(kw - F.col("b_kw")) / F.greatest(F.lit(2.0), F.col("b_kw") * 0.02)
    like = lambda kw: F.when(gap(kw) <= 1.6, 1 - gap(kw) * 0.1).when(gap(kw) > 1.6, F.greatest(F.lit(0.0), 0.6 - gap(kw) * 0.1))
    power = F.coalesce(F.least(like(F.col("potencia_kw")), like(F.col("kw"))), unknown)
    gear_v = F.when(F.col("fuel_code").isin("Elc", "PHEV"), F.lit("automatic")).otherwise(F.coalesce("gear", F.lit("manual")))
    gear = F.when(gear_v == F.col("b_gear"), 1.0).otherwise(0.0)
    x = F.array(F.col("m.sim"), trim, drive, disp, power, gear)
    return p.groupBy("vk").agg(F.collect_list(F.struct(F.col("id").alias("boe_id"), x.cast("array<double>").alias("x"))).alias("cands"))


class Mixture:
    """Two Gaussians over similarity vectors. Covariances are shrunk to their diagonal and widened by a share of the
    squared distance of the means, so a feature that hardly varies cannot decide alone."""

    def __init__(self, d: int):
        self.prior, self.mean = 0.1, [np.full(d, 0.95), np.full(d, 0.5)]
        self.cov = [np.eye(d) * 0.01, np.eye(d) * 0.1]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        for sign, m, c in ((1, self.mean[0], self.cov[0]), (-1, self.mean[1], self.cov[1])):
            z = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
            out += sign * (-0.5 * (z * z).sum(0) - 0.5 * np.linalg.slogdet(c)[1])
        return np.clip(out, -60, 60)

    def update(self, s: np.ndarray, d: int) -> None:
        """s: for each component the sum of weights, of weighted vectors and of weighted products."""
        parts = s.reshape(2, 1 + d + d * d)
        total = parts[:, 0].sum()
        for k in (0, 1):
            w = max(parts[k, 0], 1e-9)
            m = parts[k, 1 : 1 + d] / w
            c = parts[k, 1 + d :].reshape(d, d) / w - np.outer(m, m)
            self.mean[k], self.cov[k] = m, 0.5 * c + 0.5 * np.diag(np.diag(c))
        far = (self.mean[0] - self.mean[1]) ** 2
        for k in (0, 1):
            self.cov[k] = self.cov[k] + np.diag(0.05 * far + 1e-3)
        self.prior = float(np.clip(parts[0, 0] / max(total, 1e-9), 1e-4, 0.5))


def exclusive(logodds: np.ndarray) -> np.ndarray:
    """Posteriors of one vehicle's candidates under transitivity: at most one of them is the vehicle."""
    top = max(0.0, float(logodds.max(initial=0.0)))
    e = np.exp(logodds - top)
    return e / (np.exp(-top) + e.sum())


def fit_mixture(cands: DataFrame, rounds: int = ROUNDS) -> Mixture:
    """Expectation-maximisation over all candidate vectors; a round is one pass whose sums reach the driver."""
    d = len(FEATURES)
    mix = Mixture(d)
    for _ in range(rounds):
        now = mix

        def sums(batches: Iterator[pd.DataFrame], now: Mixture = now) -> Iterator[pd.DataFrame]:
            acc = np.zeros((2, 1 + d + d * d))
            for pdf in batches:
                for cs in pdf["cands"]:
                    x = np.array([c["x"] for c in cs])
                    g = exclusive(now.log_odds(x))
                    for k, w in ((0, g), (1, 1 - g)):
                        wx = x * w[:, None]
                        acc[k] += np.concatenate([[w.sum()], wx.sum(0), (wx.T @ x).ravel()])
            yield pd.DataFrame({"s": [acc.ravel().tolist()]})

        rows = cands.select("cands").mapInPandas(sums, "s array<double>").collect()
        total = np.sum([r.s for r in rows], axis=0) if rows else np.zeros(2 * (1 + d + d * d))
        if not total.any():
            break
        before = mix.mean[0].copy()
        mix.update(total, d)
        if np.abs(before - mix.mean[0]).max() < 1e-4:
            break
    return mix


def posteriors(cands: DataFrame, mix: Mixture) -> DataFrame:
    """vk, boe_id, x, posterior of every candidate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for vk, cs in zip(pdf["vk"], pdf["cands"]):
                x = np.array([c["x"] for c in cs])
                out += [(vk, c["boe_id"], row.tolist(), float(p)) for c, row, p in zip(cs, x, exclusive(mix.log_odds(x)))]
            yield pd.DataFrame(out, columns=["vk", "boe_id", "x", "posterior"])

    return cands.mapInPandas(run, "vk long, boe_id long, x array<double>, posterior double")


def match_official(vehiculos: DataFrame, official: DataFrame, canon: DataFrame) -> DataFrame:
    """vehiculo_id, boe_id, confidence: each vehicle's official row, if there is one.

    Equal descriptions are matched once and count each. The best candidate is taken if its posterior is at least a half
    and an exact check of what both sides state (trim, drive, displacement, power, gearbox) finds no contradiction; equal
    posteriors go to the lower id. Vehicles without brand, model or registration date have none. Empty tables give an
    empty result.
    """
    keys = ["marca", "modelo", "year", "combustible", "cilindrada_cc", "potencia_kw"]
    rows = vehiculos.select("vehiculo_id", "marca", "modelo", F.year("fecha_primera_matriculacion").alias("year"), "combustible", "cilindrada_cc", F.when(~F.isnan("potencia_kw"), F.col("potencia_kw")).alias("potencia_kw"))
    rows = materialise(rows.where("marca is not null and modelo is not null and year is not null"), "vehicles")
    # equal descriptions by their values, each with an id of its own
    texts = materialise(rows.select(*keys).distinct().withColumn("vk", F.monotonically_increasing_id()), "descriptions")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    rows = rows.alias("r").join(texts.alias("t"), same).select("vehiculo_id", "vk")
    cands = materialise(candidates(texts, official, canon), "cands")
    post = posteriors(cands, fit_mixture(cands))
    best = post.groupBy("vk").agg(F.max(F.struct("posterior", (-F.col("boe_id")).alias("neg"), "x")).alias("b")).select("vk", (-F.col("b.neg")).alias("boe_id"), F.col("b.posterior").alias("confidence"), F.col("b.x").alias("x"))
    x = F.col("x")
    sound = (x[0] >= MODEL_LEAST) & (x[1] >= 0.65) & (x[2] >= 0.65) & (x[3] >= 0.65) & (x[4] >= 0.65) & (x[5] == 1.0)
    return rows.select("vehiculo_id", "vk").join(best.where((F.col("confidence") >= 0.5) & sound), "vk").select("vehiculo_id", "boe_id", "confidence")
