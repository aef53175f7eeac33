"""Filling containers of fixed capacity: Martello-Toth dominance reduction over size classes, best fit for the rest.

The plan is made on the histogram of sizes, which has at most `capacity` classes whatever the number of items; items then
find their container by size and rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.ranks import sliced
from lonja.session import materialise

CAPACITY = 2048


@dataclass
class Group:
    """`count` containers with the same content."""

    count: int
    content: Counter = field(default_factory=Counter)
    start: int = 0


@dataclass
class Plan:
    capacity: int
    groups: list[Group]
    fixed: int

    @property
    def containers(self) -> int:
        return sum(g.count for g in self.groups)


class _Sizes:
    """Multiset of item sizes with sorted classes."""

    def __init__(self, hist: dict[int, int]):
        self.n = {s: c for s, c in hist.items() if s > 0 and c > 0}
        self.keys = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.keys.pop(bisect_left(self.keys, size))

    def largest_within(self, room: int, minus: int | None = None) -> int | None:
        """The largest size that fits in `room`, where one item of size `minus` is in use already."""
        i = bisect_left(self.keys, room + 1) - 1
        while i >= 0 and self.keys[i] == minus and self.n[self.keys[i]] < 2:
            i -= 1
        return self.keys[i] if i >= 0 else None

    def smallest_sum(self, k: int, minus: int) -> int | None:
        """Sum of the k smallest items other than one of size `minus`."""
        total, left = 0, k
        for s in self.keys:
            have = min(left, self.n[s] - (s == minus))
            total, left = total + have * s, left - have
            if not left:
                return total
        return None


def reduce_dominated(sizes: _Sizes, capacity: int) -> list[Group]:
    """Martello-Toth reduction: for each item, largest first, fix a set of at most three items that dominates every other
    set the item can be in. A set is fixed as often at once as its classes allow: using items up only makes the smallest
    sets larger, so a dominance once found stays."""
    out = []
    for j in sorted(sizes.keys, reverse=True):
        while j in sizes.n:
            room = capacity - j
            least = [sizes.smallest_sum(k, j) for k in (1, 2, 3)]
            if least[0] is None or least[0] > room:
                k, chosen = sizes.n[j], [j]
                out.append(Group(k, Counter(chosen)))
                sizes.take(j, k)
                continue
            partner = sizes.largest_within(room, j)
            two_fit, three_fit = least[1] is not None and least[1] <= room, least[2] is not None and least[2] <= room
            chosen = None
            if partner == room or not two_fit:
                chosen = [j, partner]
            elif not three_fit:
                pair = _best_pair(sizes, j, room)
                if pair is None or partner >= sum(pair):
                    chosen = [j, partner]
                elif sum(pair) == room and max(pair) == partner:
                    chosen = [j, *pair]
            if chosen is None:
                break
            use = Counter(chosen)
            times = min(sizes.n[s] // q for s, q in use.items())
            if not two_fit and partner != room:
                # the partner dominates as the largest that fits; it stays so until its class is used up
                times = max(1, times)
            out.append(Group(times, use))
            for s, q in use.items():
                sizes.take(s, q * times)
    return out


def _best_pair(sizes: _Sizes, j: int, room: int) -> tuple[int, int] | None:
    """The two items with the largest sum within `room`, other than one of size j."""
    left = {s: sizes.n[s] - (s == j) for s in sizes.keys if s < room}
    keys, best = [s for s in left if left[s] > 0], None
    hi = len(keys) - 1
    for lo, a in enumerate(keys):
        while hi >= 0 and a + keys[hi] > room:
            hi -= 1
        at = hi
        if at >= 0 and keys[at] == a and left[a] < 2:
            at -= 1
        if at < lo and not (at >= 0 and keys[at] == a):
            break
        total = a + keys[at]
        if best is None or total > sum(best):
            best = (a, keys[at])
    return best


def best_fit(sizes: _Sizes, capacity: int) -> list[Group]:
    """Best fit decreasing in bulk: each class goes to the fullest containers that hold it, else to new ones."""
    by_room: dict[int, list[Group]] = {}
    rooms: list[int] = []

    def put(g: Group, room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(g)

    for s in sorted(sizes.n, reverse=True):
        left = sizes.n[s]
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                g = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(i)
                k = min(left, g.count)
                if k < g.count:
                    put(Group(g.count - k, Counter(g.content)), room)
                put(Group(k, g.content + Counter({s: 1})), room - s)
                left -= k
            else:
                per = capacity // s
                k = max(1, left // per)
                q = min(per, left)
                put(Group(k, Counter({s: q})), capacity - s * q)
                left -= k * q
    return [g for gs in by_room.values() for g in gs]


def plan_packing(hist: dict[int, int], capacity: int = CAPACITY) -> Plan:
    sizes = _Sizes(hist)
    if sizes.keys and sizes.keys[-1] > capacity:
        raise ValueError("an item exceeds the capacity; split it first")
    fixed = reduce_dominated(sizes, capacity)
    groups = fixed + best_fit(sizes, capacity)
    at = 0
    for g in groups:
        g.start, at = at, at + g.count
    return Plan(capacity, groups, sum(g.count for g in fixed))


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, size: an item above the capacity is cut into full containers and a rest; others stay whole."""
    n = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1))
    cut = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("piece"))
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("size"))


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, Plan]:
    """(doc_id, piece, size, container_id) for every item of sizes(doc_id, n_tokens), and the plan.

    An item of no size goes to container 0 and takes no room; a null doc_id is an item like any other. Repeated rows are
    items of their own if their doc_id differs; an equal doc_id with an equal size is one item per row as well, in an
    unspecified but gapless order. Empty input gives an empty result and a plan without containers. A histogram of at
    most `capacity` + 1 rows is all that reaches the driver; the assignment table grows with the classes, not the items.
    """
    spark = sizes.sparkSession
    parts = materialise(pieces(sizes, capacity), "pieces")
    hist = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(hist, capacity)
    table: dict[int, list[tuple[int, int, int]]] = {s: [] for s in hist}
    upto: Counter = Counter()
    for g in plan.groups:
        for s, q in g.content.items():
            table[s].append((upto[s], g.start, q))
            upto[s] += q * g.count
    rows = [(s, sorted(v)) for s, v in table.items()]
    slots = spark.createDataFrame(rows, "slot_size int, slots array<struct<first:bigint,start:bigint,q:int>>")
    ranked = sliced(parts, "size", ["doc_id", "piece"], sum(hist.values()))
    slot = F.element_at(F.filter("slots", lambda x: x.first <= F.col("rank")), -1)
    placed = ranked.join(slots, F.col("size") == F.col("slot_size")).withColumn("slot", F.when(F.col("size") > 0, slot))
    cid = F.when(F.col("size") > 0, F.col("slot.start") + F.floor((F.col("rank") - F.col("slot.first")) / F.col("slot.q"))).otherwise(F.lit(0))
    return placed.select("doc_id", "piece", "size", cid.cast("long").alias("container_id")), plan
