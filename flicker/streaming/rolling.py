"""Streaming extensions: event counts by time window with a watermark, and smoothing with a fixed lag.

The smoothing methods look both ways, so on a stream a frame's value is given once `lag` later frames have come; with a
lag of the kernel's half width it is the batch value, but for the reflected last frames of a run that never ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.methods import Method, kernel_weights, shape

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, events, total for windows of event time; rows later than `late` are dropped by the watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def fixed_lag(frames: DataFrame, m: Method) -> DataFrame:
    """run_id, frame, y for a stream of frames (run_id, frame, x) that come in order within a run; y comes half a kernel later."""
    weights = kernel_weights(*m.kernel)
    half = len(weights) // 2

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, held = state.get if state.exists else (0, [])
        held = list(held)
        rows = pd.concat(list(batches)).sort_values("frame")
        held += rows["x"].tolist()
        top = first + len(held)  # frames first .. top - 1 are held; those up to top - half - 1 can be given
        start = first + half if first else 0
        n = top - half - start
        if n > 0:
            at = np.arange(start - half, start + n + half)
            at = np.where(at < 0, (-at - 1) % max(top, 1), at) - first
            y = shape(m, np.convolve(np.asarray(held, float)[at], weights[::-1], "valid"))
            yield pd.DataFrame({"run_id": key[0], "frame": np.arange(start, start + n), "y": y})
            cut = max(0, start + n - half - first)
            first, held = first + cut, held[cut:]
        state.update((int(first), [float(v) for v in held]))

    return frames.groupBy("run_id").applyInPandasWithState(step, "run_id long, frame long, y double", "first long, held array<double>", "append", GroupStateTimeout.NoTimeout)
