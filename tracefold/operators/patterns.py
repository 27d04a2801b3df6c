"""Pattern aggregation: A1-A7, W8, W10.

All of these are hash aggregations (partial + final, map-side combine), so a
hot bundle is pre-aggregated on every mapper before the shuffle; ``min_by`` /
``max_by`` keep one candidate per group in the buffer, never the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import text as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour: root-cause hint texts.
# ---------------------------------------------------------------------------
HINT_404 = "HTTP 404 errors detected - possible missing endpoint or route"
HINT_POOL = "Database connection pool issues detected"
HINT_TIMEOUT = "Timeout errors detected - possible performance or network issues"
HINT_MEMORY = "Memory issues detected - possible memory leak or insufficient resources"
HINT_PRIMARY_PREFIX = "Primary error: "
SERVICE_CLASS_RE = r"com\.(\w+)\.(\w+)"
# ---------------------------------------------------------------------------


def aggregate_patterns_a(parsed: DataFrame, keys: tuple[str, ...] = ("bundle_id",)) -> DataFrame:
    """A1: group parsed lines by normalised text.  The pattern is the first raw
    line (<=1000 chars) and its severity; first/last are min/max of the line
    timestamps (NULL when no line had one)."""
    first = F.min_by(F.struct(F.substring("line", 1, 1000).alias("pattern"), F.col("severity")), F.col("line_no"))
    g = parsed.groupBy(*keys, "norm").agg(
        first.alias("f"), F.count(F.lit(1)).alias("count"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min("line_no").alias("first_line_no"))
    return g.select(*keys, "norm", F.col("f.pattern").alias("pattern"), "count", "first_ts", "last_ts",
                    F.col("f.severity").alias("severity"), "first_line_no")


def dedup_patterns_b(entries: DataFrame, keys: tuple[str, ...] = ("bundle_id",),
                     escalate: bool = False, carry: tuple[str, ...] = ("container",)) -> DataFrame:
    """A2 (and A2b with ``escalate``): group entries by md5 of the normalised
    message.  Keeps the first message in arrival order, count, the first ts and
    the ts of the last-arrived member, the first member's level and source.

    ``sev_rank`` / ``first_entry_no`` give the reference's output order
    (ERROR, WARNING, INFO, then count desc, then first seen)."""
    e = entries.withColumn("pattern_key", T.pattern_key_b(F.col("message")))
    first = F.min_by(F.struct(F.col("message").alias("pattern"), F.col("level"), F.col("ts"),
                              *[F.col(c) for c in carry]), F.col("entry_no"))
    aggs = [first.alias("f"), F.count(F.lit(1)).alias("count"),
            F.min("entry_no").alias("first_entry_no"),
            F.max_by(F.col("ts"), F.col("entry_no")).alias("last_ts")]
    if escalate:
        aggs.append(F.max(F.when(F.col("level") == "ERROR", 1).otherwise(0)).alias("any_error"))
    g = e.groupBy(*keys, "pattern_key").agg(*aggs)
    level = F.col("f.level")
    if escalate:
        level = F.when(F.col("any_error") == 1, F.lit("ERROR")).otherwise(level)
    out = g.select(*keys, "pattern_key", F.col("f.pattern").alias("pattern"), "count",
                   F.col("f.ts").alias("first_ts"), "last_ts", level.alias("error_class"),
                   *[F.col(f"f.{c}").alias(c) for c in carry], "first_entry_no")
    return out.withColumn("sev_rank", T.level_rank_b(F.col("error_class")))


def order_patterns_b(patterns: DataFrame, keys: tuple[str, ...] = ("bundle_id",),
                     entry_bucket: int | None = 1 << 16) -> DataFrame:
    """Reference output order of A2 as a 0-based ``pattern_ord`` per bundle.

    A bucketed running count: the bucket (level rank, -count, first entry
    bucket) preserves the order, so a bundle with very many distinct patterns
    is spread over many tasks.  ``entry_bucket`` None: the bundles are known to be
    bounded, and each is numbered in one window."""
    from tracefold.operators.scan import ordinal
    if entry_bucket is None:
        w = Window.partitionBy(*keys).orderBy("sev_rank", F.col("count").desc(), "first_entry_no")
        return patterns.withColumn("pattern_ord", F.row_number().over(w).cast("long") - 1)
    bucket = F.struct(F.col("sev_rank"), (-F.col("count")).alias("c"),
                      F.floor(F.col("first_entry_no") / entry_bucket).alias("e"))
    return ordinal(patterns, list(keys), ["sev_rank", F.col("count").desc(), "first_entry_no"], bucket,
                   "pattern_ord")


def bundle_window(patterns: DataFrame, keys: tuple[str, ...] = ("bundle_id",),
                  first: str = "first_ts", last: str = "last_ts", ingest_ts=None) -> DataFrame:
    """A3: window = min(first), max(last); no timestamps -> the ingest column."""
    fallback = ingest_ts if ingest_ts is not None else F.lit(None).cast("timestamp")
    g = patterns.groupBy(*keys).agg(F.min(first).alias("window_start"), F.max(last).alias("window_end"))
    return g.select(*keys, F.coalesce("window_start", fallback).alias("window_start"),
                    F.coalesce("window_end", fallback).alias("window_end"))


def error_rate(parsed: DataFrame, keys: tuple[str, ...] = ("bundle_id",)) -> DataFrame:
    """A4: errors / lines * 10 per bundle (ERROR, FATAL, EXCEPTION count as
    errors; CRITICAL, PANIC, FAIL do not).  Unrounded; 0.0 for no lines."""
    is_err = F.col("severity").isin(*T.ERROR_SEVERITIES_A)
    g = parsed.groupBy(*keys).agg(F.count_if(is_err).alias("error_count"), F.count(F.lit(1)).alias("line_count"))
    return g.withColumn("error_rate_z", F.when(F.col("line_count") > 0,
                                                F.col("error_count") / F.col("line_count") * 10.0)
                        .otherwise(F.lit(0.0)))


def affected_services(patterns: DataFrame, keys: tuple[str, ...] = ("bundle_id",),
                      all_levels: bool = False, container: str = "container",
                      level: str = "error_class") -> DataFrame:
    """A5: sorted distinct service names (cleaned containers) of ERROR/WARNING
    patterns; ``all_levels`` is the spec variant."""
    p = patterns.where(F.col(container).isNotNull() & (F.col(container) != ""))
    if not all_levels:
        p = p.where(F.col(level).isin("ERROR", "WARNING"))
    return p.groupBy(*keys).agg(F.sort_array(F.collect_set(T.clean_service(F.col(container))))
                                .alias("affected_services"))


def error_classes(patterns: DataFrame, keys: tuple[str, ...] = ("bundle_id",), level: str = "error_class",
                  limit: int = 5) -> DataFrame:
    """Up to ``limit`` distinct non-null severities (sorted)."""
    return patterns.groupBy(*keys).agg(
        F.slice(F.sort_array(F.collect_set(F.col(level))), 1, limit).alias("error_classes"))


def ingest_stats(patterns: DataFrame, keys: tuple[str, ...] = ("bundle_id",), level: str = "severity") -> DataFrame:
    """Number of patterns and of error patterns per bundle."""
    return patterns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pattern_count"),
        F.count_if(F.col(level).isin(*T.ERROR_SEVERITIES_A)).alias("error_count"))


def derive_hint(patterns: DataFrame, keys: tuple[str, ...] = ("bundle_id",), level: str = "severity",
                ord_col: str = "first_line_no") -> DataFrame:
    """The most frequent error pattern (ties: first seen) mapped to a hint.
    Bundles without an error pattern get no row."""
    err = patterns.where(F.col(level).isin(*T.ERROR_SEVERITIES_A))
    top = err.groupBy(*keys).agg(
        F.max_by(F.col("pattern"), F.struct(F.col("count"), (-F.col(ord_col)).alias("o"))).alias("top_pattern"))
    p = F.lower(F.col("top_pattern"))
    hint = (F.when(p.contains("404") | p.contains("not found"), F.lit(HINT_404))
            .when(p.contains("connection") & (p.contains("pool") | p.contains("exhaust")), F.lit(HINT_POOL))
            .when(p.contains("timeout"), F.lit(HINT_TIMEOUT))
            .when(p.contains("memory") | p.contains("oom"), F.lit(HINT_MEMORY))
            .otherwise(F.concat(F.lit(HINT_PRIMARY_PREFIX), F.substring("top_pattern", 1, 100))))
    return top.select(*keys, hint.alias("hint"))


def infer_service(parsed: DataFrame, keys: tuple[str, ...] = ("bundle_id",), line: str = "line",
                  order: str = "line_no") -> DataFrame:
    """lower(Y) of the first line that mentions ``com.X.Y``."""
    m = F.col(line).rlike(SERVICE_CLASS_RE)
    hit = parsed.where(m)
    return hit.groupBy(*keys).agg(
        F.lower(F.min_by(F.regexp_extract(F.col(line), SERVICE_CLASS_RE, 2), F.col(order))).alias("service"))
