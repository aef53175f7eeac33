"""Percentile sketches, packing, ranks, mixing and tokens."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lonja.llm.mixing import mix, mix_plan, reached_shares
from lonja.llm.packing import CAPACITY, _Sizes, best_fit, pack, plan_packing, reduce_dominated
from lonja.llm.percentiles import Sketch, build_sketches, merge_sketches, percentiles
from lonja.llm.ranks import sliced
from lonja.llm.tokens import token_count

QS = [0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("order", ["random", "sorted", "ties"])
def test_sketch_keeps_its_bound(order):
    rng = np.random.default_rng(1)
    v = {"random": rng.normal(size=60_000), "sorted": np.arange(60_000.0), "ties": rng.integers(0, 5, 60_000).astype(float)}[order]
    parts = [Sketch(256) for _ in range(7)]
    for s, x in zip(parts, np.array_split(v, 7)):
        for y in np.array_split(x, 13):
            s.update(y)
    whole = Sketch(256)
    for s in parts:
        whole.merge(Sketch.load(s.dump()))
    assert whole.n == len(v) and whole.held() < 256 * 12 and whole.err < 0.05 * len(v)
    s = np.sort(v)
    for q, got in zip(QS, whole.quantiles(QS)):
        lo, hi = np.searchsorted(s, got, "left") + 1, np.searchsorted(s, got, "right")
        rank = max(1, int(np.ceil(q * len(v))))
        assert lo - whole.err <= rank <= hi + whole.err


def test_percentiles_exact_when_small(spark):
    rows = [("a", float(i), i % 3) for i in range(1, 101)] + [(None, 5.0, 0), ("b", None, 0), ("b", float("nan"), 0), ("a", 50.0, None)]
    df = spark.createDataFrame(rows, "k string, v double, day int")
    got = {r.k: r for r in percentiles(df, ["k"], "v", [0.05, 0.5], part="day").collect()}
    assert set(got) == {"a", None} and (got["a"].n, got["a"].p05, got["a"].p50, got["a"].rank_error) == (101, 6.0, 50.0, 0) and got[None].p50 == 5.0
    assert percentiles(df.limit(0), ["k"], "v", [0.5]).count() == 0
    sk = merge_sketches(build_sketches(df, ["k"], "v", 16), ["k"])
    assert sk.count() == 2


def test_ranks_match_a_window(spark):
    df = spark.createDataFrame([("hot" if i % 3 else "cold", i, i % 7) for i in range(3000)], "g string, doc_id long, n long")
    got = sliced(df, "g", ["doc_id"], 3000 * 50_000 // 300, "n").toPandas()
    for _, x in got.groupby("g"):
        x = x.sort_values("rank")
        assert x["rank"].tolist() == list(range(len(x))) and x["before"].tolist() == [0, *x["n"].cumsum().tolist()[:-1]]


def exact_bins(sizes, cap):
    """Least number of containers by search, for a handful of items."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= cap and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    for seed in range(150):
        r = random.Random(seed)
        cap = r.choice([10, 30, 100])
        sizes = sorted((r.randint(1, cap) for _ in range(r.randint(1, 9))), reverse=True)
        left = _Sizes(Counter(sizes))
        fixed = reduce_dominated(left, cap)
        rest = [s for s, n in left.n.items() for _ in range(n)]
        assert sum(g.count for g in fixed) + (exact_bins(sorted(rest, reverse=True), cap) if rest else 0) == exact_bins(sizes, cap), (seed, cap, sizes)


def test_plan_places_every_item():
    for seed in range(40):
        r = random.Random(seed)
        h = Counter(min(CAPACITY, int(r.lognormvariate(5, 1.4)) + 1) for _ in range(r.choice([1, 40, 4000])))
        plan, seen = plan_packing(h), Counter()
        for g in plan.groups:
            assert g.count > 0 and sum(s * q for s, q in g.content.items()) <= CAPACITY
            seen.update({s: q * g.count for s, q in g.content.items()})
        assert seen == h
    assert plan_packing({}).containers == 0 and sum(g.count for g in best_fit(_Sizes({2048: 3, 1: 5}), 2048)) == 4


def test_pack(spark):
    r = random.Random(3)
    rows = [(i, "s", n) for i, n in enumerate([0, 0, 5000, 2048, 2049, 1] + [r.randint(1, 1500) for _ in range(400)])] + [(None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    placed, plan = pack(df.select("doc_id", "n_tokens"))
    p = placed.toPandas()
    assert p["size"].sum() == sum(n for _, _, n in rows) and p.groupby("container_id")["size"].sum().max() <= CAPACITY
    assert len(p[p.doc_id == 2]) == 3 and len(p[p.doc_id == 4]) == 2 and len(p[p.doc_id == 3]) == 1 and p[p["size"] > 0].container_id.nunique() == plan.containers
    assert pack(df.limit(0).select("doc_id", "n_tokens"))[0].count() == 0


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, "big" if i % 4 else "small", r.randint(1, 60)) for i in range(4000)] + [(9001, None, 5), (9002, "other", 5), (9003, "big", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = mix(docs, targets, {"big": -0.5, "small": 0.5})
    p = m.toPandas()
    assert p.position.is_monotonic_increasing and p.groupby(["source", "doc_id"]).size().max() <= 2 and p[p.source == "big"].groupby("doc_id").size().max() == 1
    assert not p.duplicated(["doc_id", "use"]).any() and set(p.source) == {"big", "small"}
    share = p.groupby("source").n_tokens.sum() / p.n_tokens.sum()
    assert abs(share["big"] - 2 / 3) < 0.002
    half = p.position < p.position.max() / 2
    assert (p[half & (p.source == "small")].n_tokens.sum() / p[half].n_tokens.sum()) < 0.3 < (p[~half & (p.source == "small")].n_tokens.sum() / p[~half].n_tokens.sum())
    s = {x.source: x for x in reached_shares(m, targets).collect()}
    assert s["absent"].tokens == 0 and s["small"].most_uses <= 2
    assert mix(docs.limit(0), targets).count() == 0 and mix_plan({"a": 0}, {"a": (1.0, 1)}, {}) == {}


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("ñandú " * 5000,)], "t string")
    got = [r[0] for r in df.select(token_count(F.col("t"))).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 5000
