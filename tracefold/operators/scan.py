"""Skew-safe ordered scans (prefix aggregates) per key.

Several operators need "the running X of this key up to this row" (multi-line
folding, flush segments, gap clustering).  A plain window partitioned by the key
puts a whole key into one task; a single source holding a third of all rows
would then be one task.  These helpers cut each key into buckets of the ordering
column, run the window inside ``(key, bucket)`` only, and add the carry of all
earlier buckets, which comes from a small per-bucket table (one row per bucket)
scanned with a cheap window of its own.  The big side is shuffled once, on
``(key, bucket)``; the join back to the bucket table reuses that partitioning
(or AQE broadcasts the bucket table when it is small at run time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "__bucket"


def _with_bucket(df: DataFrame, bucket: Column) -> DataFrame:
    return df.withColumn(_B, bucket)


def numeric_bucket(col: str, width: int) -> Column:
    return F.floor(F.col(col) / F.lit(width)).cast("long")


def time_bucket(col: str, width_seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(col)) / F.lit(width_seconds * 1_000_000)).cast("long")


def ordinal(df: DataFrame, keys: list[str], order: list, bucket: Column, out: str) -> DataFrame:
    """0-based position of each row within its key in ``order`` (a
    ``row_number() - 1`` that does not put a whole key into one task).

    ``bucket`` must be non-decreasing in ``order`` (e.g. a struct of the
    leading order columns plus a coarse bucket of the last one)."""
    d = running_sum(df, keys, order, F.lit(1), "__ord1", bucket)
    return d.withColumn(out, F.col("__ord1") - 1).drop("__ord1")


def carry_forward_max(df: DataFrame, keys: list[str], order: list[str], value: Column,
                      out: str, bucket: Column) -> DataFrame:
    """``out`` = max(value) over rows of the key ordered at or before this row.

    ``bucket`` must be non-decreasing in ``order``.  With ``value`` NULL except on
    marker rows and increasing with order, this is "the last marker so far"."""
    d = _with_bucket(df.withColumn("__v", value), bucket)
    w = (Window.partitionBy(*keys, _B).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("__local", F.max("__v").over(w))
    per_bucket = d.groupBy(*keys, _B).agg(F.max("__v").alias("__bmax"))
    wb = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, _B, F.max("__bmax").over(wb).alias("__carry"))
    d = d.join(carry, [*keys, _B], "left")
    return (d.withColumn(out, F.coalesce(F.col("__local"), F.col("__carry")))
            .drop("__v", "__local", "__carry", _B))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column,
                out: str, bucket: Column, as_long: bool = True) -> DataFrame:
    """``out`` = sum(value) over rows of the key at or before this row (inclusive)."""
    d = _with_bucket(df.withColumn("__v", value.cast("long") if as_long else value), bucket)
    w = (Window.partitionBy(*keys, _B).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("__local", F.sum("__v").over(w))
    per_bucket = d.groupBy(*keys, _B).agg(F.sum("__v").alias("__bsum"))
    wb = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, _B, F.coalesce(F.sum("__bsum").over(wb), F.lit(0)).alias("__carry"))
    d = d.join(carry, [*keys, _B], "left")
    total = F.col("__local") + F.col("__carry")
    return (d.withColumn(out, total.cast("long") if as_long else total)
            .drop("__v", "__local", "__carry", _B))


def gap_sessions(df: DataFrame, keys: list[str], ts: str, tiebreak: list[str],
                 gap_us: int, out: str, bucket_seconds: int = 3600) -> DataFrame:
    """Number rows into sessions: rows ordered by (ts, tiebreak); a new session
    starts when the gap to the previous row's ts exceeds ``gap_us`` (a gap equal
    to the limit stays in the session).  Sessions are numbered 0.. per key.

    Rows with NULL ``ts`` each form their own session, numbered first (in
    tiebreak order), and do not break the running session.  One pass: a window
    per (key, time bucket), one per-bucket aggregate, one join back."""
    null_bucket = F.lit(-(1 << 62)).cast("long")
    d = _with_bucket(df, F.when(F.col(ts).isNull(), null_bucket).otherwise(time_bucket(ts, bucket_seconds)))
    t = F.unix_micros(F.col(ts))
    w = Window.partitionBy(*keys, _B).orderBy(F.col(ts), *[F.col(c) for c in tiebreak])
    d = d.withColumn("__prev", F.lag(t).over(w))
    d = d.withColumn("__inner", F.when(F.col(ts).isNull(), 1)
                     .when(F.col("__prev").isNotNull() & ((t - F.col("__prev")) > gap_us), 1).otherwise(0))
    d = d.withColumn("__local", F.sum("__inner").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per_bucket = d.groupBy(*keys, _B).agg(F.min(t).alias("__bmin"), F.max(t).alias("__bmax"),
                                           F.sum("__inner").alias("__binner"))
    wb = Window.partitionBy(*keys).orderBy(_B)
    prev_max = F.lag("__bmax").over(wb)
    per_bucket = per_bucket.withColumn(
        "__first", F.when(F.col(_B) == null_bucket, 0)
        .when(prev_max.isNull() | ((F.col("__bmin") - prev_max) > gap_us), 1).otherwise(0))
    per_bucket = per_bucket.withColumn(
        "__offset",
        F.coalesce(F.sum(F.col("__binner") + F.col("__first"))
                   .over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    carry = per_bucket.select(*keys, _B, "__first", "__offset")
    d = d.join(carry, [*keys, _B], "left")
    return (d.withColumn(out, (F.col("__offset") + F.col("__first") + F.col("__local") - 1).cast("long"))
            .drop("__prev", "__inner", "__local", "__first", "__offset", _B))
