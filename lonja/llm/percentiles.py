"""Percentiles of very large columns by deterministic buffer collapsing, with a tracked bound on the rank error.

A sketch holds sorted buffers of `k` values; a buffer of level l stands for each value 2**l times. Two full buffers of one
level collapse into one of the next by taking every other value of their merge (evenly spaced positions), from the first
or the second in turn. A collapse at level l moves a rank by at most 2**l; the sketch adds these up, so its bound is
certain, not probable. Sketches merge in any order and grouping: partitions, days, months.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values a buffer holds. The relative rank error stays below levels / (2 * K): 0.3 % at 10**10 rows.
K = 4096
#: Values a task keeps before it hands on its sketches, so that many groups do not exhaust its memory.
HELD = 2_000_000
#: Sketches of one group that a task merges before the last merge.
FAN_IN = 64


class Sketch:
    __slots__ = ("k", "n", "err", "low", "levels", "turn")

    def __init__(self, k: int = K):
        self.k, self.n, self.err, self.turn = k, 0, 0, 0
        self.low: list[np.ndarray] = []  # values not yet in a full buffer
        self.levels: dict[int, np.ndarray] = {}

    def update(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.low.append(np.asarray(values, dtype="float64"))
            self._fill()

    def _fill(self) -> None:
        if sum(map(len, self.low)) >= self.k:
            flat = np.concatenate(self.low)
            full = len(flat) // self.k * self.k
            for i in range(0, full, self.k):
                self._carry(0, np.sort(flat[i : i + self.k]))
            self.low = [flat[full:]] if full < len(flat) else []

    def _carry(self, level: int, buf: np.ndarray) -> None:
        while level in self.levels:
            both = np.sort(np.concatenate([self.levels.pop(level), buf]), kind="stable")
            buf = both[self.turn :: 2]
            self.turn ^= 1
            self.err += 1 << level
            level += 1
        self.levels[level] = buf

    def merge(self, other: "Sketch") -> None:
        self.n += other.n
        self.err += other.err
        self.low += other.low
        for level in sorted(other.levels):
            self._carry(level, other.levels[level])
        self._fill()

    def held(self) -> int:
        return sum(map(len, self.low)) + sum(map(len, self.levels.values()))

    def quantiles(self, qs: list[float]) -> list[float]:
        """The value at rank ceil(q * n) of the weighted buffers, for each q."""
        if not self.n:
            return [float("nan")] * len(qs)
        parts = [(np.concatenate(self.low), 1)] if self.low else []
        parts += [(b, 1 << level) for level, b in sorted(self.levels.items())]
        v = np.concatenate([p for p, _ in parts])
        w = np.concatenate([np.full(len(p), wt, dtype="int64") for p, wt in parts])
        order = np.argsort(v, kind="stable")
        cum = np.cumsum(w[order])
        ranks = np.clip(np.ceil(np.round(np.asarray(qs) * self.n, 9)), 1, self.n)
        return v[order][np.minimum(np.searchsorted(cum, ranks), len(v) - 1)].tolist()

    def dump(self) -> bytes:
        bufs = [(-1, np.concatenate(self.low))] if self.low else []
        bufs += sorted(self.levels.items())
        head = struct.pack("<iqqii", self.k, self.n, self.err, self.turn, len(bufs))
        return head + b"".join(struct.pack("<ii", lv, len(b)) + b.astype("<f8").tobytes() for lv, b in bufs)

    @classmethod
    def load(cls, raw: bytes) -> "Sketch":
        k, n, err, turn, m = struct.unpack_from("<iqqii", raw)
        s, at = cls(k), struct.calcsize("<iqqii")
        s.n, s.err, s.turn = n, err, turn
        for _ in range(m):
            lv, size = struct.unpack_from("<ii", raw, at)
            at += 8
            b = np.frombuffer(raw, "<f8", size, at)
            at += 8 * size
            if lv < 0:
                s.low = [b]
            else:
                s.levels[lv] = b
        return s


def _schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [T.StructField("sketch", T.BinaryType())])


def build_sketches(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """keys..., sketch: one or more sketches of each group and partition, without a shuffle. Null and NaN values are left
    out, so a group without values has no sketch; null keys are a group. A task hands on what it holds at HELD values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Sketch] = {}
        total = 0

        def out() -> pd.DataFrame:
            cols = list(zip(*held)) if held and keys else [[] for _ in keys]
            return pd.DataFrame({**{c: pd.Series(list(v), dtype="object") for c, v in zip(keys, cols)}, "sketch": pd.Series([s.dump() for s in held.values()], dtype="object")})

        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False)[value] if keys else [((), pdf[value])]
            for key, s in groups:
                key = tuple(None if x is None or x is pd.NaT or x != x else x for x in key)
                held.setdefault(key, Sketch(k)).update(s.to_numpy("float64"))
            total += len(pdf)
            if total >= HELD:
                yield out()
                held, total = {}, 0
        if held:
            yield out()

    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias(value)).mapInPandas(run, _schema(df, keys))


def _merge_sorted(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, acc, done = None, None, []
        for pdf in batches:
            vals = [pdf[c].astype("object").where(pdf[c].notna(), None).tolist() for c in keys]
            for key, raw in zip(zip(*vals) if keys else [()] * len(pdf), pdf["sketch"]):
                if key != last or acc is None:
                    if acc is not None:
                        done.append((*last, acc.dump()))
                    last, acc = key, Sketch.load(raw)
                else:
                    acc.merge(Sketch.load(raw))
                if len(done) >= 500:
                    yield pd.DataFrame(done, columns=[*keys, "sketch"]).astype("object")
                    done = []
        if acc is not None:
            done.append((*last, acc.dump()))
        if done:
            yield pd.DataFrame(done, columns=[*keys, "sketch"]).astype("object")

    return run


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., sketch: one sketch for each group, merged in two rounds, so that a hot group is shared by FAN_IN tasks.

    The rows of a group stream through a task sorted by key; only the growing sketch is in memory."""
    spread = F.pmod(F.xxhash64("sketch"), F.lit(FAN_IN)).cast("int")
    schema = _schema(sketches, keys)
    one = sketches.withColumn("_salt", spread).withColumn("_h", F.xxhash64("sketch"))
    one = one.repartition(*[F.col(k) for k in keys], "_salt").sortWithinPartitions(*keys, "_salt", "_h").drop("_h")
    first = one.mapInPandas(_merge_sorted([*keys, "_salt"]), T.StructType([*schema.fields[:-1], T.StructField("_salt", T.IntegerType()), schema.fields[-1]]))
    two = first.repartition(*[F.col(k) for k in keys]) if keys else first.coalesce(1)
    return two.sortWithinPartitions(*keys, "_salt").drop("_salt").mapInPandas(_merge_sorted(keys), schema)


def quantile_columns(sketch: Column, qs: list[float]) -> Column:
    """struct<n, rank_error, values>: the number of values, the bound on the rank error in rows, and the percentiles."""

    @F.pandas_udf("n long, rank_error long, values array<double>")
    def read(s: pd.Series) -> pd.DataFrame:
        sk = [Sketch.load(x) for x in s]
        return pd.DataFrame({"n": [x.n for x in sk], "rank_error": [x.err for x in sk], "values": [x.quantiles(qs) for x in sk]})

    return read(sketch)


def percentiles(df: DataFrame, keys: list[str], value: str, qs: list[float], part: str | None = None, k: int = K) -> DataFrame:
    """keys..., n, one column p05, p50, ... per percentile, rank_error and rank_error_share (error / n).

    With `part` (a day, say) the sketches that are merged are of one part each, as stored days would be; parts need no merge
    of their own before, for sketches merge in any order and grouping.
    The value reported for q has a rank within `rank_error` rows of ceil(q * n); up to `k` values it is exact.
    """
    sk = build_sketches(df, keys + ([part] if part else []), value, k)
    got = merge_sketches(sk.drop(part) if part else sk, keys).withColumn("_q", quantile_columns(F.col("sketch"), qs))
    # the sketch of a group is read once, and not again by each of its columns
    cols = [F.col("_q.values")[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(qs)]
    return got.select(*keys, F.col("_q.n").alias("n"), *cols, F.col("_q.rank_error").alias("rank_error"), (F.col("_q.rank_error") / F.col("_q.n")).alias("rank_error_share"))


def rank_misses(df: DataFrame, keys: list[str], value: str, got: DataFrame, qs: list[float]) -> DataFrame:
    """keys..., n, rank_error, miss: how far, in rows, the worst percentile of each group lies from its rank, by an exact
    count over the values. `got` is the result of percentiles(); the check joins a few figures a group to the values."""
    v = F.col(value).cast("double")
    cells = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"p{round(q * 100):02d}").alias("p")) for q in qs])
    asked = got.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "rank_error", F.inline(cells))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    per = df.where(v.isNotNull() & ~F.isnan(v)).join(asked, same).groupBy(*keys, "n", "rank_error", "q").agg(F.count_if(v < F.col("p")).alias("below"), F.count_if(v <= F.col("p")).alias("upto"))
    want = F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("n"), 9)))
    miss = F.greatest(F.lit(0), F.col("below") + 1 - want, want - F.col("upto"))
    return per.groupBy(*keys, "n", "rank_error").agg(F.max(miss).alias("miss"))
