"""Binary series: frames to bounded stretches with halos, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered

CHUNK_FRAMES = 32768


def event_frames(events: DataFrame, positive: Column | None = None) -> DataFrame:
    """run_id, feature_id, frame, x: one run for each user, frames by time; x marks clicks and purchases unless told otherwise."""
    positive = F.col("event_type").isin("click", "purchase") if positive is None else positive
    slim = events.select(F.col("user_id").alias("run_id"), F.lit(0).cast("long").alias("feature_id"), "ts", "event_id", positive.cast("tinyint").alias("x"))
    return numbered(slim, ["run_id"], "ts", "event_id", name="frame").select("run_id", "feature_id", "frame", "x")


def to_chunks(frames: DataFrame, halo: int = 0, chunk_frames: int = CHUNK_FRAMES, values: tuple[str, ...] = ("x",), keys: tuple[str, ...] = ("run_id", "feature_id"), lengths: DataFrame | None = None) -> DataFrame:
    """One row for each stretch of a series: keys, chunk, lo, pre, own, n and an array for each of values.

    A stretch has at most chunk_frames frames of its own and, before and after, up to halo frames of its neighbours, so
    window operators see what they need and a long series is spread over tasks. lo: its first own frame; pre: frames of
    the halo before it; n: frames of the whole series. lengths: some of the keys and n, where that is known; otherwise
    frames is evaluated once more to count it.
    """
    size = max(chunk_frames, halo + 1)
    home = F.floor(F.col("frame") / size)
    at = F.col("frame") % size
    places = F.array_compact(F.array(home, F.when((at < halo) & (home > 0), home - 1), F.when(at >= size - halo, home + 1)))
    rows = frames.select(*keys, "frame", *values, F.explode(places).alias("chunk"))
    # the halo after the last chunk of a series has no frames of its own: such rows go below
    parts = rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("frame", *values))).alias("f"), F.max("frame").alias("top"))
    parts = parts.withColumn("lo", F.col("chunk") * size).where(F.col("top") >= F.col("lo"))
    length = frames.groupBy(*keys).agg((F.max("frame") + 1).alias("n")) if lengths is None else lengths
    own = F.least(F.lit(size), F.col("n") - F.col("lo")).cast("int")
    first = F.col("f")[0]["frame"]
    out = parts.join(length, [k for k in keys if k in length.columns]).select(*keys, "chunk", "lo", (F.col("lo") - first).cast("int").alias("pre"), own.alias("own"), "n", *[F.col("f").getField(v).alias(f"{v}s") for v in values])
    return out


def to_frames(chunks: DataFrame, *arrays: str, keys: tuple[str, ...] = ("run_id", "feature_id")) -> DataFrame:
    """keys, frame and a column for each of arrays (which cover a chunk's own frames)."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    return chunks.select(*keys, "lo", F.posexplode(zipped).alias("at", "v")).select(*keys, (F.col("lo") + F.col("at")).alias("frame"), *[F.col("v")[a].alias(a) for a in arrays])
