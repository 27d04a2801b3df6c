"""Correlation: W1 flush segments, J1 error lookback, W2 gap clusters, J2
dependency match, W3 root-cause ranking, W4 cluster ranking, J8 effects, W5
pattern priority.

Keys lead with the bundle (or source) id, so every window and aggregate
shuffles on it.  Long ordered scans go through ``scan`` (bucketed, skew-safe);
per-cluster top-k uses ``row_number() <= k``, which Spark plans as a
WindowGroupLimit (partial top-k before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import text as T
from tracefold.operators.scan import gap_sessions, numeric_bucket

DEFAULT_ENTRY_BUCKET = 1 << 16
#: Time buckets of J1: each level is 2 ** FAN_BITS times as wide as the one below.
FAN_BITS, LEVELS = 10, 4

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour: ranking reason texts.
# ---------------------------------------------------------------------------
REASON_CRITICAL = "CRITICAL/FATAL severity"
REASON_ERROR = "ERROR level"
REASON_WARNING = "WARNING level"
REASON_DEPTH = "deep in dependency chain (depth={})"
REASON_COUNT = "occurred {}x"
REASON_NONE = "pattern detected"
# ---------------------------------------------------------------------------


def flush_segments(entries: DataFrame, keys: tuple[str, ...] = ("source_id",), lookback_seconds: int = 60,
                   order: str = "entry_no", bucket_width: int = DEFAULT_ENTRY_BUCKET) -> DataFrame:
    """Every ERROR closes a segment holding the entries since the previous
    ERROR (arrival order) whose ts is within ``lookback_seconds`` before it;
    the tail without an ERROR yields nothing.  Adds ``segment`` (0-based per
    key) and ``error_ts``.

    The errors before a row and the next one after it come from one scan in
    (key, bucket of ``order``), once forwards and once backwards, and from a table
    of one row per bucket; no join on the segment, which is one key for a source
    without errors."""
    keys = list(keys)
    is_err = F.coalesce(F.col("level") == "ERROR", F.lit(False))
    seen = Window.partitionBy(*keys, "__b")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    marker = F.when(is_err, F.struct(F.col(order).alias("no"), F.col("ts").alias("at")))
    d = (entries.withColumn("__b", numeric_bucket(order, bucket_width)).withColumn("__err", marker)
         .withColumn("__n", F.count("__err").over(seen.orderBy(order).rowsBetween(*so_far)))
         .withColumn("__next", F.min("__err").over(seen.orderBy(F.col(order).desc()).rowsBetween(*so_far))))
    per_bucket = d.groupBy(*keys, "__b").agg(F.count("__err").alias("__bn"), F.min("__err").alias("__bfirst"))
    others = (Window.unboundedPreceding, -1)
    carry = per_bucket.select(
        *keys, "__b",
        F.sum("__bn").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(*others)).alias("__before"),
        F.min("__bfirst").over(Window.partitionBy(*keys).orderBy(F.col("__b").desc()).rowsBetween(*others)).alias("__later"))
    d = d.join(carry, [*keys, "__b"], "left").withColumn("__next", F.coalesce("__next", "__later"))
    keep = (F.col(order) == F.col("__next.no")) | (
        F.col("ts") >= F.col("__next.at") - F.make_dt_interval(secs=F.lit(lookback_seconds)))
    segment = F.col("__n") + F.coalesce(F.col("__before"), F.lit(0)) - is_err.cast("long")
    return (d.where(keep).withColumn("segment", segment).withColumn("error_ts", F.col("__next.at"))
            .drop("__b", "__err", "__n", "__next", "__before", "__later"))


def error_lookback(entries: DataFrame, key: str = "source_id", batch: str = "batch_id", lookback_seconds: int = 300,
                   max_entries: int | None = None, order: str = "entry_no") -> DataFrame:
    """For every batch with an ERROR, all entries of the *source* that had
    arrived by the end of the batch - earlier batches included - with
    ``ts >= first_error.ts - lookback``; no upper bound in time.  The result's
    batch column names the batch of the error; adds ``first_error_ts``.

    Windows first meet the *batches* whose newest entry is late enough, on a table
    of one row per batch, and then the entries of those batches.  A window starts
    at a time and ends at the newest time seen so far; it is cut into buckets whose
    width grows by 1024 a level, at most 2048 of them on all but the last, so
    one line dated far ahead adds no long run of buckets.  ``max_entries`` keeps
    only the newest entries per window, on request."""
    cond_err = F.col("level") == "ERROR"
    stats = entries.groupBy(key, batch).agg(
        F.min_by(F.col("ts"), F.when(cond_err, F.col(order))).alias("first_error_ts"),
        F.max("ts").alias("__max_ts"), F.min(order).alias("__first"), F.max(order).alias("__last"),
        F.max(cond_err).alias("__err"))
    so_far = Window.partitionBy(key).orderBy("__last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stats = stats.withColumn("__newest", F.max("__max_ts").over(so_far))
    since = F.col("first_error_ts") - F.make_dt_interval(secs=F.lit(lookback_seconds))

    def bucket(ts: Column, level: int) -> Column:
        finest = F.floor(F.unix_micros(ts) / F.lit(max(1, lookback_seconds) * 1_000_000)).cast("long")
        return F.shiftright(finest, FAN_BITS * level)

    def spans(level: int) -> Column:
        first, last = bucket(since, level), bucket(F.col("__newest"), level)
        if level:
            first = first + 1
        if level < LEVELS - 1:
            last = F.least(last, F.shiftleft(bucket(since, level + 1) + 1, FAN_BITS) - 1)
        named = F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(level).alias("level"), b.alias("b")))
        return F.when(first <= last, named).otherwise(F.array().cast("array<struct<level:int,b:bigint>>"))

    windows = stats.where("__err and first_error_ts is not null").select(
        key, batch, "first_error_ts", F.col("__last").alias("__until"), since.alias("__since"),
        F.explode(F.concat(*map(spans, range(LEVELS)))).alias("__b"))
    batches = stats.where("__max_ts is not null").select(
        key, F.col(batch).alias("__of"), "__max_ts", "__first",
        F.explode(F.array(*[F.struct(F.lit(i).alias("level"), bucket(F.col("__max_ts"), i).alias("b"))
                            for i in range(LEVELS)])).alias("__b"))
    pairs = (windows.join(batches, [key, "__b"])
             .where((F.col("__first") <= F.col("__until")) & (F.col("__max_ts") >= F.col("__since")))
             .select(F.col(key).alias("__key"), "__of", batch, "first_error_ts", "__until", "__since"))
    e = entries.withColumnRenamed(batch, "__batch")
    d = (e.join(pairs, (e[key] == pairs["__key"]) & e["__batch"].eqNullSafe(pairs["__of"]))
         .where((F.col(order) <= F.col("__until")) & (F.col("ts") >= F.col("__since")))
         .drop("__key", "__of", "__batch"))
    if max_entries is not None:
        newest = Window.partitionBy(key, batch).orderBy(F.col(order).desc())
        d = d.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= max_entries).drop("__rn")
    return d.drop("__until", "__since")


def cluster_by_gap(patterns: DataFrame, keys: tuple[str, ...] = ("bundle_id",), ts: str = "first_ts",
                   order: tuple[str, ...] = ("sev_rank", "count_desc", "first_entry_no"),
                   gap_seconds: float = 2.0, bucket_seconds: int = 3600) -> DataFrame:
    """Sort by ``ts`` (stable on ``order``); a new cluster starts when the gap
    to the previous pattern exceeds ``gap_seconds``.  Patterns without ts form
    one cluster each, numbered first, and do not break the running cluster.
    Adds ``cluster_no`` (0-based per key)."""
    keys = list(keys)
    p = patterns
    if "count_desc" in order and "count_desc" not in p.columns:
        p = p.withColumn("count_desc", -F.col("count"))
    out = gap_sessions(p, keys, ts, list(order), int(round(gap_seconds * 1_000_000)), "cluster_no",
                       bucket_seconds=bucket_seconds)
    if "count_desc" not in patterns.columns:
        out = out.drop("count_desc")
    return out


def dependency_priority(nodes: DataFrame, keys: tuple[str, ...] = ("bundle_id",), node: str = "node",
                        position: str = "position", n_nodes: str = "n_nodes") -> DataFrame:
    """Priority of each graph node: index in the reversed list (first node =
    n-1, last = 0), keyed by lower-cased name; a repeated name keeps its
    earliest position (the last write of the reversed walk), i.e. the max."""
    pri = (F.col(n_nodes) - 1 - F.col(position))
    return (nodes.groupBy(*keys, F.lower(F.col(node)).alias("node_lc"))
            .agg(F.max(pri).alias("priority")))


def _grams(text: Column, n: int) -> Column:
    """All substrings of length ``n`` of ``text`` (empty when shorter)."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1),
                                                   lambda i: F.substring(text, i, n))).otherwise(
        F.array().cast("array<string>"))


def match_dependencies(patterns: DataFrame, priorities: DataFrame, keys: tuple[str, ...] = ("bundle_id",),
                       pattern_id: tuple[str, ...] = ("pattern_key",), gram: int = 3) -> DataFrame:
    """Dependency score of each pattern = max priority of the graph nodes
    contained in lower(pattern); 0 when none.

    Patterns are not paired with every node: a node can only occur in a pattern
    that contains the node's first ``min(gram, len)`` characters, so distinct
    pattern n-grams (n = 1..gram) are joined to node prefixes on (bundle,
    n-gram) and only those candidates are verified with ``contains``.  The n-gram
    rows carry the pattern's id; its text comes back once, for the verification.
    Work grows with the text, not with patterns x nodes, and the result is exact."""
    keys, pid = list(keys), list(pattern_id)
    p = patterns.select(*keys, *pid, F.lower(F.col("pattern")).alias("__plc"))
    node_len = F.length("node_lc")
    nodes = priorities.where(node_len > 0).withColumn("__g", F.substring("node_lc", 1, gram))
    grams = F.array_distinct(F.concat(*[_grams(F.col("__plc"), n) for n in range(1, gram + 1)]))
    candidates = (p.select(*keys, *pid, F.explode(grams).alias("__g")).join(nodes, [*keys, "__g"])
                  .select(*keys, *pid, "node_lc", "priority"))
    hits = (candidates.join(p, [*keys, *pid]).where(F.col("__plc").contains(F.col("node_lc")))
            .groupBy(*keys, *pid).agg(F.max("priority").alias("__hit")))
    # an empty node name is contained in every pattern of its bundle
    empty = priorities.where(node_len == 0).groupBy(*keys).agg(F.max("priority").alias("__all"))
    out = patterns.join(hits, [*keys, *pid], "left").join(empty, keys, "left")
    best = F.greatest(F.coalesce(F.col("__hit"), F.lit(0)), F.coalesce(F.col("__all"), F.lit(0)))
    return out.withColumn("dependency_score", best.cast("long")).drop("__hit", "__all")


def ranking_reason(severity, dep, count) -> F.Column:
    parts = F.array(
        F.when(severity >= 100, F.lit(REASON_CRITICAL)).when(severity >= 80, F.lit(REASON_ERROR))
        .when(severity >= 50, F.lit(REASON_WARNING)),
        F.when(dep > 0, F.format_string(REASON_DEPTH.replace("{}", "%d"), dep)),
        F.when(count > 1, F.format_string(REASON_COUNT.replace("{}", "%d"), count)))
    joined = F.concat_ws("; ", parts)
    return F.when(joined == "", F.lit(REASON_NONE)).otherwise(joined)


def rank_root_causes(clustered: DataFrame, keys: tuple[str, ...] = ("bundle_id",), level: str = "error_class",
                     ts: str = "first_ts", order: tuple[str, ...] = ("sev_rank", "count_desc", "first_entry_no"),
                     max_root_causes: int = 5) -> DataFrame:
    """Per cluster keep patterns with severity >= 50 or a dependency match,
    order by severity desc, dependency desc, then cluster order (ts, input
    order); the top ``max_root_causes`` get ``rank`` 1.. and a reason."""
    keys = list(keys)
    c = clustered
    if "dependency_score" not in c.columns:
        c = c.withColumn("dependency_score", F.lit(0).cast("long"))
    if "count_desc" in order and "count_desc" not in c.columns:
        c = c.withColumn("count_desc", -F.col("count"))
    c = c.withColumn("severity_score", T.severity_score(F.col("pattern"), F.col(level), "correlator"))
    c = c.where((F.col("severity_score") >= 50) | (F.col("dependency_score") > 0))
    w = Window.partitionBy(*keys, "cluster_no").orderBy(
        F.col("severity_score").desc(), F.col("dependency_score").desc(), F.col(ts).asc_nulls_first(), *order)
    r = c.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= max_root_causes)
    r = r.withColumn("reason", ranking_reason(F.col("severity_score"), F.col("dependency_score"), F.col("count")))
    if "count_desc" not in clustered.columns:
        r = r.drop("count_desc")
    return r


def rank_clusters(clustered: DataFrame, causes: DataFrame, keys: tuple[str, ...] = ("bundle_id",)) -> DataFrame:
    """Clusters ordered by the severity of their top cause (0 if none),
    stable by cluster number; ``cluster_rank`` 1 is the primary cluster."""
    keys = list(keys)
    clusters = clustered.select(*keys, "cluster_no").distinct()
    top = causes.where(F.col("rank") == 1).select(*keys, "cluster_no", F.col("severity_score").alias("top_severity"))
    c = clusters.join(top, [*keys, "cluster_no"], "left").withColumn(
        "top_severity", F.coalesce(F.col("top_severity"), F.lit(0)).cast("long"))
    from tracefold.operators.scan import ordinal
    bucket = F.struct((-F.col("top_severity")).alias("s"), F.floor(F.col("cluster_no") / (1 << 16)).alias("c"))
    c = ordinal(c, keys, [F.col("top_severity").desc(), "cluster_no"], bucket, "__r")
    return c.withColumn("cluster_rank", F.col("__r") + 1).drop("__r")


def effects(clustered: DataFrame, causes: DataFrame, keys: tuple[str, ...] = ("bundle_id",)) -> DataFrame:
    """Cluster patterns whose text is not the text of a root cause of the
    same cluster (left anti join on the pattern text)."""
    keys = list(keys)
    rc = causes.select(*keys, "cluster_no", "pattern").distinct()
    return clustered.join(rc, [*keys, "cluster_no", "pattern"], "left_anti")


def prioritize_patterns(patterns: DataFrame, keys: tuple[str, ...] = ("bundle_id",), level: str = "error_class",
                        order: tuple[str, ...] = ("sev_rank", "count_desc", "first_entry_no"),
                        limit: int = 20, keyword_set: str = "prompt") -> DataFrame:
    """Order by (severity score, count) desc, stable on input order; keep
    the top ``limit`` with ``priority`` 1.."""
    keys = list(keys)
    p = patterns
    if "count_desc" in order and "count_desc" not in p.columns:
        p = p.withColumn("count_desc", -F.col("count"))
    p = p.withColumn("priority_score", T.severity_score(F.col("pattern"), F.col(level), keyword_set))
    w = Window.partitionBy(*keys).orderBy(F.col("priority_score").desc(), F.col("count").desc(), *order)
    out = p.withColumn("priority", F.row_number().over(w).cast("long")).where(F.col("priority") <= limit)
    if "count_desc" not in patterns.columns:
        out = out.drop("count_desc")
    return out
