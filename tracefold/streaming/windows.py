"""Windowed aggregations on a stream (``withWatermark`` + ``window`` /
``session_window`` state, append mode) and on a static DataFrame (the batch twin).

On a stream a window is given out once, when the watermark has passed its end.  Put
``streaming.gate`` in front, and rows that come too late are counted instead of lost.
Session state is one group per key, so ``keys`` should be as fine as the sources are
(file, container); the batch twin runs on the bucketed gap scan instead and takes a
source of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions.text import pattern_key_b
from tracefold.functions.time import interval_seconds as _seconds
from tracefold.operators.scan import gap_sessions


def _wm(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    return df.withWatermark(ts, watermark) if (watermark and df.isStreaming) else df


def windowed_patterns(entries: DataFrame, window: str = "60 seconds", slide: str | None = None,
                      watermark: str | None = "60 seconds", keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """A2 pattern counts per tumbling (or sliding) event-time window."""
    e = _wm(entries, "ts", watermark).withColumn("pattern_key", pattern_key_b(F.col("message")))
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = e.groupBy(w.alias("w"), *keys, "pattern_key").agg(
        F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min("entry_no").alias("first_entry_no"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                    "pattern_key", "count", "first_ts", "last_ts", "first_entry_no")


def session_clusters(entries: DataFrame, gap: str = "300 seconds", watermark: str | None = "300 seconds",
                     keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """T4: W2 on a stream: sessions of entries whose gaps are at most ``gap``
    (a gap equal to the limit stays in the session)."""
    measures = [F.count(F.lit(1)).alias("n_entries"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                F.count_if(F.col("level") == "ERROR").alias("n_errors")]
    if entries.isStreaming:
        g = _wm(entries, "ts", watermark).groupBy(F.session_window("ts", gap).alias("s"), *keys).agg(*measures)
    else:
        sessions = gap_sessions(entries.where("ts IS NOT NULL"), list(keys), "ts", ["entry_no"],
                                _seconds(gap) * 1_000_000, "s")
        g = sessions.groupBy(*keys, "s").agg(*measures)
    return g.select(*keys, "first_ts", "last_ts", "n_entries", "n_errors")


def windowed_error_rate(entries: DataFrame, window: str = "1 hour", slide: str | None = None,
                        watermark: str | None = "60 seconds", keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """T5: A4 per tumbling (or sliding) window: errors / entries * 10."""
    e = _wm(entries, "ts", watermark)
    g = e.groupBy((F.window("ts", window, slide) if slide else F.window("ts", window)).alias("w"), *keys).agg(
        F.count_if(F.col("level") == "ERROR").alias("error_count"), F.count(F.lit(1)).alias("entry_count"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "error_count", "entry_count",
                    (F.col("error_count") / F.col("entry_count") * 10.0).alias("error_rate_z"))
