"""Bundle assembly: G4 z-scores, J9 event attach, P8 anomaly flags, W6
sequence, P9/P10 summaries, P11 prompt payload, J3 code snippets, J10 recent
commit.

Per-bundle tables are joined on ``bundle_id`` (shuffle joins, AQE picks
broadcast when a side is small at run time).  Range joins always carry an equi
key plus a time bucket so they never degrade to a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import text as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------
# Metric columns with their display labels, in output order.
METRIC_LABELS = [("cpu_z", "CPU"), ("mem_z", "Memory"), ("latency_z", "Latency"), ("error_rate_z", "Error rate")]
ANOMALY_Z = 2.0
SUMMARY_MAX_CHARS = 5000
SUMMARY_PATTERN_CHARS = 500
SUMMARY_TOP_PATTERNS = 3
SUMMARY_LIST_CAP = 5
SUMMARY_SEP = " | "
CHAIN_ARROW = " → "
# ---------------------------------------------------------------------------


def zscore_metrics(samples: DataFrame, entity: str = "service", period: str = "day", kind: str = "event_type",
                   value: str = "value", kinds: dict[str, str] | None = None) -> DataFrame:
    """Z-score of each period's mean ``value`` against all periods of the
    same (entity, kind); NULL when the deviation is 0 or undefined.  ``kinds``
    maps a kind value to an output column (e.g. {'view': 'cpu_z'})."""
    kinds = kinds or {}
    daily = samples.groupBy(entity, period, kind).agg(F.avg(value).alias("x"))
    w = Window.partitionBy(entity, kind)
    sd = F.stddev_samp("x").over(w)
    daily = daily.withColumn("z", F.when(sd != 0, (F.col("x") - F.avg("x").over(w)) / sd))
    aggs = [F.max(F.when(F.col(kind) == k, F.col("z"))).alias(c) for k, c in kinds.items()]
    return daily.groupBy(entity, period).agg(*aggs)


def attach_events(bundles: DataFrame, events: DataFrame, bucket_seconds: int = 3600,
                  service: str = "source_id") -> DataFrame:
    """J9 (interval join): events of the bundle's service with
    ``window_start <= ts <= window_end``.  Each bundle window is expanded over
    the time buckets it covers and joined on (service, bucket), so only events
    of overlapping buckets are compared."""
    width = bucket_seconds * 1_000_000
    b = bundles.select("bundle_id", F.col(service).alias("__svc"), "window_start", "window_end")
    b = b.withColumn("__bk", F.explode(F.sequence(F.floor(F.unix_micros("window_start") / width),
                                                   F.floor(F.unix_micros("window_end") / width))))
    e = events.withColumn("__bk", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / width))
    j = e.join(b, (e["service"] == b["__svc"]) & (e["__bk"] == b["__bk"]), "inner")
    ts = F.col("ts").cast("timestamp")
    return (j.where((ts >= F.col("window_start")) & (ts <= F.col("window_end")))
            .drop("__svc", "__bk", "window_start", "window_end"))


def flag_anomalies(metrics: DataFrame, keys: tuple[str, ...] = ("bundle_id",), threshold: float = ANOMALY_Z) -> DataFrame:
    """One row per anomalous metric (non-null, non-zero, |z| > threshold)
    with its display label ``'<Label> Z-score: 1.23'``."""
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(col).alias("metric"), F.lit(lbl).alias("label"),
                     F.col(col).cast("double").alias("z")) for i, (col, lbl) in enumerate(METRIC_LABELS)]
    m = metrics.select(*keys, F.explode(F.array(*rows)).alias("m")).select(*keys, "m.*")
    m = m.where(F.col("z").isNotNull() & (F.col("z") != 0) & (F.abs("z") > threshold))
    return m.withColumn("text", F.format_string("%s Z-score: %.2f", F.col("label"), F.col("z")))


def sequence_index(patterns: DataFrame, events: DataFrame, keys: tuple[str, ...] = ("bundle_id",),
                   bucket_seconds: int = 3600) -> DataFrame:
    """Log patterns (at first occurrence) and events merged on time and
    numbered 0.. per bundle; ties: events before logs, then id.  The number is
    a bucketed running count (time buckets), so a hot bundle is not one task."""
    from tracefold.operators.scan import running_sum, time_bucket
    logs = patterns.select(*keys, F.col("first_ts").cast("timestamp").alias("ts"), F.lit("log").alias("type"),
                           F.concat(F.lit("["), T.clean_service(F.col("container")), F.lit("] "),
                                    F.col("pattern")).alias("message"), F.col("pattern_key").alias("item_id"))
    ev = events.select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.lit("event").alias("type"),
                       F.col("reason").alias("message"), F.col("id").alias("item_id"))
    u = logs.unionByName(ev)
    bucket = F.coalesce(time_bucket("ts", bucket_seconds), F.lit(-(1 << 62)))
    u = running_sum(u, list(keys), [F.col("ts").asc_nulls_first(), "type", "item_id"], F.lit(1), "__n", bucket)
    return u.withColumn("sequence_index", F.col("__n") - 1).drop("__n")


def _joined_list(values: Column, cap: int | None, sep: str) -> Column:
    v = values if cap is None else F.slice(values, 1, cap)
    return F.array_join(v, sep)


def summarize_bundles(bundles: DataFrame, top_patterns: DataFrame, anomalies: DataFrame,
                      events: DataFrame, keys: tuple[str, ...] = ("bundle_id",)) -> DataFrame:
    """One summary text per bundle for embedding.

    ``bundles``: keys, root_service, affected_services (array), error_classes
    (array), hint, dependency_chain (array, graph order).
    ``top_patterns``: keys, priority (1..), count, pattern  (W5, summary set).
    ``anomalies``: keys, ord, text (P8).  ``events``: keys, ts, id, type, reason."""
    keys = list(keys)
    tp = (top_patterns.where(F.col("priority") <= SUMMARY_TOP_PATTERNS)
          .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
              "priority", F.format_string("Log pattern (%dx): %s", F.col("count"),
                                          F.substring("pattern", 1, SUMMARY_PATTERN_CHARS)).alias("t"))))
              .alias("tp")))
    an = anomalies.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("an"))
    w = Window.partitionBy(*keys).orderBy(F.col("ts").asc_nulls_first(), "id")
    first5 = events.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= SUMMARY_LIST_CAP)
    ev = first5.groupBy(*keys).agg(F.array_sort(F.collect_set("type")).alias("ev_types"),
                                   F.array_sort(F.collect_set("reason")).alias("ev_reasons"))
    b = (bundles.join(tp, keys, "left").join(an, keys, "left").join(ev, keys, "left"))

    def part(cond: Column, text: Column) -> Column:
        return F.when(cond, text)

    nonempty = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    parts = F.array(
        part(F.col("root_service").isNotNull() & (F.col("root_service") != ""),
             F.concat(F.lit("Root service: "), F.col("root_service"))),
        part(nonempty("affected_services"),
             F.concat(F.lit("Affected services: "), _joined_list(F.col("affected_services"), SUMMARY_LIST_CAP, ", "))),
        part(nonempty("error_classes"),
             F.concat(F.lit("Error classes: "), _joined_list(F.col("error_classes"), SUMMARY_LIST_CAP, ", "))))
    parts = F.concat(parts, F.coalesce(F.transform("tp", lambda s: s["t"]), F.array().cast("array<string>")))
    parts = F.concat(parts, F.array(
        part(nonempty("an"), F.concat(F.lit("Anomalies: "), F.array_join(F.transform("an", lambda s: s["text"]), "; "))),
        part(nonempty("ev_types"), F.concat(F.lit("Event types: "), F.array_join("ev_types", ", "))),
        part(nonempty("ev_reasons"), F.concat(F.lit("Event reasons: "), F.array_join("ev_reasons", ", "))),
        part(F.col("hint").isNotNull() & (F.col("hint") != ""), F.concat(F.lit("Hint: "), F.col("hint"))),
        part(nonempty("dependency_chain"),
             F.concat(F.lit("Dependency chain: "), _joined_list(F.col("dependency_chain"), SUMMARY_LIST_CAP,
                                                                  CHAIN_ARROW)))))
    s = F.array_join(parts, SUMMARY_SEP)
    s = F.when(F.length(s) > SUMMARY_MAX_CHARS,
               F.concat(F.substring(s, 1, SUMMARY_MAX_CHARS), F.lit("..."))).otherwise(s)
    return b.select(*keys, s.alias("summary"))


def attach_snippets(frames: DataFrame, source_lines: DataFrame, keys: tuple[str, ...] = ("bundle_id",),
                    context: int = 10, max_snippets: int = 5, line_bucket: int = 64) -> DataFrame:
    """J3 (band join): for the first occurrence of each cited file name per
    bundle, the source lines ``l-10 .. l+10`` of the file resolved by base
    name (ambiguous name -> smallest path); the first ``max_snippets`` files
    that yield content are kept.  Reported start/end are ``max(1, l-5)`` and
    ``l+10`` as in the reference; content lines end with a newline.

    The band join is an equi-join on (file, line bucket): a frame is expanded
    over the (at most two) buckets its band touches, so it meets at most
    ``2 * line_bucket`` lines however long the file is.

    ``frames``: keys, ord, src_file, src_line.
    ``source_lines``: file_path, line_no, text."""
    keys = list(keys)
    first = frames.where(F.col("src_file").isNotNull()).groupBy(*keys, "src_file").agg(
        F.min_by("src_line", "ord").alias("src_line"), F.min("ord").alias("ord"))
    files = (source_lines.select("file_path").distinct()
             .withColumn("base", F.element_at(F.split("file_path", "/"), -1))
             .groupBy("base").agg(F.min("file_path").alias("file_path")))
    hit = first.join(files, first["src_file"] == files["base"], "inner").drop("base")
    lo, hi = F.col("src_line") - context, F.col("src_line") + context
    hit = hit.withColumn("__bk", F.explode(F.sequence(F.floor(lo / line_bucket), F.floor(hi / line_bucket))))
    lines = source_lines.select(F.col("file_path").alias("__fp"), "line_no", "text",
                                F.floor(F.col("line_no") / line_bucket).alias("__lbk"))
    j = hit.join(lines, (hit["file_path"] == lines["__fp"]) & (hit["__bk"] == lines["__lbk"])
                 & (lines["line_no"] >= lo) & (lines["line_no"] <= hi))
    snip = (j.groupBy(*keys, "file_path", "src_line", "ord")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))),
                                          lambda s: F.concat(s["text"], F.lit("\n"))), "").alias("content")))
    w = Window.partitionBy(*keys).orderBy("ord")
    snip = snip.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max_snippets).drop("__n")
    return (snip.withColumn("start_line", F.greatest(F.lit(1), F.col("src_line") - 5).cast("long"))
            .withColumn("end_line", (F.col("src_line") + 10).cast("long")))


def recent_commit(files: DataFrame, commits: DataFrame, keys: tuple[str, ...] = ("bundle_id",),
                  bucket_seconds: int = 86400) -> DataFrame:
    """J10 (as-of join): for each (bundle, file, incident ts) the latest commit
    at or before the incident that touched the file (NULL when none).

    Commits and incidents are merged per file and ordered by time (a commit at
    the same instant comes first); the last commit so far is carried forward
    with the bucketed prefix scan, so no (commit, incident) pairs are formed
    and a hot file is split by time bucket.

    ``files``: keys, file, incident_ts.  ``commits``: commit_hash, ts, author,
    message, changed_files (array)."""
    from tracefold.operators.scan import carry_forward_max, time_bucket
    keys = list(keys)
    nokeys = [F.lit(None).cast(files.schema[k].dataType).alias(k) for k in keys]
    touched = commits.select(*nokeys, F.explode("changed_files").alias("file"), F.col("ts").alias("__t"),
                             F.lit(0).alias("__kind"),
                             F.struct(F.col("ts").alias("commit_ts"), "commit_hash", "author", "message").alias("__c"))
    asks = files.select(*keys, "file", F.col("incident_ts").alias("__t"), F.lit(1).alias("__kind"),
                        F.lit(None).cast(touched.schema["__c"].dataType).alias("__c"))
    u = touched.unionByName(asks)
    u = carry_forward_max(u, ["file"], ["__t", "__kind"], F.col("__c"), "__last", time_bucket("__t", bucket_seconds))
    return u.where(F.col("__kind") == 1).select(
        *keys, "file", F.col("__t").alias("incident_ts"), F.col("__last.commit_hash").alias("commit_hash"),
        F.col("__last.commit_ts").alias("commit_ts"), F.col("__last.author").alias("author"),
        F.col("__last.message").alias("message"))
