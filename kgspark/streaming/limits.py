"""A token bucket per key over an event stream, as custom keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from kgspark.plans.lineage import ship_package

STATE = "tokens double, at double"
OUT = "key long, event_id long, allowed boolean"


def allow(times: list[float], tokens: float, at: float | None, most: float, window: float) -> tuple[list[bool], float, float]:
    """Which requests at these times (seconds, in order) find a token; tokens refill at most / window a second."""
    out = []
    for t in times:
        if at is not None:
            tokens = min(most, tokens + max(0.0, t - at) * most / window)
        at = t if at is None else max(at, t)
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, at


def rate_limited(events: DataFrame, most: int, window_seconds: float) -> DataFrame:
    """key, event_id, allowed of a stream (key, event_id, ts): state is two numbers a key."""

    def run(key, frames, state):
        tokens, at = state.get if state.exists else (float(most), None)
        frame = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        times = [t.timestamp() for t in frame["ts"]]
        allowed, tokens, at = allow(times, tokens, at, float(most), window_seconds)
        state.update((tokens, at))
        yield pd.DataFrame({"key": key[0], "event_id": frame["event_id"], "allowed": allowed})

    ship_package(events.sparkSession)
    return events.groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
