"""Streaming forms: a keyed limiter with state, a value memory merged batch by batch, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lonja.operators.timelines import Limiter


def limit_stream(events: DataFrame, key: str, ts: str, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """key, ts, accepted for each event of a stream, judged in the order of event time whatever the order of arrival: an
    event waits in its key's state until the watermark, `late` behind the latest event, has passed it. Events later than the
    watermark are dropped. The state of a key is what waits and the times accepted within the window, at most `limit`; it
    ends when the watermark is a window past the last of them. Null keys are a key; null times are dropped."""
    schema = "times array<double>, waiting array<double>"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, waiting = (list(x) for x in state.get) if state.exists else ([], [])
        for pdf in batches:
            waiting += [t.value / 1e9 for t in pdf[ts]]
        passed = state.getCurrentWatermarkMs() / 1000
        due = sorted(t for t in waiting if t <= passed)
        waiting = [t for t in waiting if t > passed]
        lim = Limiter(limit, seconds)
        lim.kept.extend(kept)
        out = [lim.accept(t) for t in due]
        if due:
            yield pd.DataFrame({key: [k[0]] * len(due), ts: pd.to_datetime(pd.Series(due), unit="s"), "accepted": out})
        live = [t for t in lim.kept if t > passed - seconds]
        if not waiting and not live:
            state.remove()
            return
        state.update((live, waiting))
        state.setTimeoutTimestamp(int((min(waiting) if waiting else live[-1] + seconds) * 1000) + 1)

    kind = dict(events.dtypes)
    known = events.select(key, ts).where(F.col(ts).isNotNull()).withWatermark(ts, late)
    return known.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {ts} {kind[ts]}, accepted boolean", schema, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, ts: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by tumbling window and type; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"))


def memory_merge(batch: DataFrame, memory: DataFrame) -> DataFrame:
    """The memory (key, samples, total, least, greatest) after one batch of (key, value): sums merge in any order."""
    new = batch.groupBy("key").agg(F.count("*").alias("samples"), F.sum(F.col("value").cast("double")).alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    both = memory.select("key", "samples", "total", "least", "greatest").unionByName(new.select("key", "samples", "total", "least", "greatest"))
    return both.groupBy("key").agg(F.sum("samples").alias("samples"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
