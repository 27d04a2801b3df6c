"""The prompt payload, one JSON document per bundle for an offline inference job.

Lists are ranked and cut before they are collected, so a group that is collected
never holds more rows than the document shows; only the dependency graph, whose
nodes the reference gives in full, follows the bundle.  NULL fields are left out
at every depth (``to_json`` does so in nested structs and arrays too)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import text as T
from tracefold.functions.time import iso_seconds

PATTERN_CHARS, EFFECTS, SECONDARY, EVENTS, SEQUENCE, MESSAGE_CHARS, COMMITS = 3000, 5, 3, 10, 50, 200, 5
KEY = "bundle_id"


def first_rows(df: DataFrame, keys: list[str], order: list, n: int, out: str = "pos") -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)


def _listed(df: DataFrame, keys: list[str], pos: str, item: Column, out: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), item.alias("item"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda s: s["item"]).alias(out))


def _service() -> Column:
    return F.when(F.col("container").isNotNull(), T.clean_service(F.col("container")))


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def correlation(clustered: DataFrame, causes: DataFrame, ranks: DataFrame, effects: DataFrame) -> DataFrame:
    """``(bundle_id, primaryCluster, secondaryClusters)`` from W2, W3, W4 and J8."""
    ck = [KEY, "cluster_no"]
    shown = ranks.where(F.col("cluster_rank") <= 1 + SECONDARY).select(*ck, "cluster_rank")
    start = clustered.groupBy(*ck).agg(iso_seconds(F.min("first_ts")).alias("timestamp"))

    def pattern(df: DataFrame) -> Column:
        return F.struct(
            F.substring("pattern", 1, PATTERN_CHARS).alias("pattern"), "count", F.col("error_class").alias("severity"),
            _optional(df, "root_service").alias("rootService"), _service().alias("affectedService"),
            iso_seconds(F.col("first_ts")).alias("firstOccurrence"),
            F.struct(F.lit("application").alias("type"), _optional(df, "log_file").alias("file")).alias("logSource"))

    ranked = F.struct("rank", F.substring("pattern", 1, PATTERN_CHARS).alias("pattern"),
                      F.col("error_class").alias("severity"), _optional(causes, "root_service").alias("rootService"),
                      _service().alias("affectedService"), "reason", F.lit("application").alias("logSource"))
    rc = causes.join(shown, ck).groupBy(*ck).agg(
        F.array_sort(F.collect_list(ranked)).alias("rootCauses"), F.min_by(pattern(causes), F.col("rank")).alias("primaryRootCause"))
    ef = first_rows(effects.join(shown, ck), ck, [F.col("first_ts").asc_nulls_first(), "first_entry_no"], EFFECTS)
    ef = _listed(ef, ck, "pos", pattern(effects), "effects")
    c = (shown.join(start, ck).join(rc, ck, "left").join(ef, ck, "left")
         .select(KEY, "cluster_rank", F.struct("timestamp", F.coalesce("rootCauses", F.array()).alias("rootCauses"),
                                               "primaryRootCause", F.coalesce("effects", F.array()).alias("effects")).alias("c")))
    others = F.array_sort(F.collect_list(F.when(F.col("cluster_rank") > 1, F.struct("cluster_rank", "c"))))
    return c.groupBy(KEY).agg(F.min_by("c", "cluster_rank").alias("primaryCluster"),
                              F.transform(others, lambda s: s["c"]).alias("secondaryClusters"))


def prompt_payload(windows: DataFrame, correlated: DataFrame, events: DataFrame, sequence: DataFrame, metrics: DataFrame,
                   nodes: DataFrame, hint: DataFrame, root: DataFrame, affected: DataFrame, *, trigger: DataFrame | None = None,
                   commits: DataFrame | None = None, snippets: DataFrame | None = None,
                   similar: DataFrame | None = None) -> DataFrame:
    """``(bundle_id, payload)``.  Every table has a ``bundle_id``; further columns:

    * ``events`` ts, id, type, reason, service, pod; ``sequence`` sequence_index, ts, type, message (W6)
    * ``metrics`` the z-scores (G4); ``nodes`` position, node (W7)
    * ``trigger`` trigger_reason; ``commits`` commit_ts, commit_hash, message, author, repo, branch (J10)
    * ``snippets`` ord, file_path, start_line, end_line, content (J3)
    * ``similar`` rank, id, summary, root_cause, similarity (J7)"""
    ev = _listed(first_rows(events, [KEY], [F.col("ts").asc_nulls_first(), "id"], EVENTS), [KEY], "pos",
                 F.struct("type", "reason", "service", "pod"), "events")
    sq = _listed(sequence.where(F.col("sequence_index") < SEQUENCE), [KEY], "sequence_index", F.struct(
        iso_seconds(F.col("ts")).alias("timestamp"), "type", F.substring("message", 1, MESSAGE_CHARS).alias("message"),
        F.col("sequence_index").alias("idx")), "sequence")
    z = F.struct(F.col("cpu_z").alias("cpuZ"), F.col("mem_z").alias("memZ"), F.col("latency_z").alias("latencyZ"),
                 F.col("error_rate_z").alias("errorRateZ"))
    b = windows
    for part in (correlated, ev, sq, metrics.select(KEY, z.alias("metrics")),
                 _listed(nodes, [KEY], "position", F.col("node"), "dependencyGraph"), hint, root, affected):
        b = b.join(part, KEY, "left")
    none = F.struct(*[F.lit(None).cast("double").alias(c) for c in ("cpuZ", "memZ", "latencyZ", "errorRateZ")])
    texts = F.array().cast("array<string>")
    fields = [
        F.col(KEY).alias("id"),
        F.struct(iso_seconds(F.col("window_start")).alias("start"), iso_seconds(F.col("window_end")).alias("end")).alias("window"),
        F.col("root_service").alias("rootService"), F.coalesce("affected_services", texts).alias("affectedServices"),
        F.struct("primaryCluster", F.coalesce("secondaryClusters", F.array()).alias("secondaryClusters"),
                 texts.alias("unrelatedPatterns")).alias("errorCorrelation"),
        F.coalesce("events", F.array()).alias("events"), F.coalesce("metrics", none).alias("metrics"),
        F.coalesce("dependencyGraph", texts).alias("dependencyGraph"), F.coalesce("sequence", F.array()).alias("sequence"),
        F.col("hint").alias("derivedRootCauseHint")]
    if trigger is not None:
        b = b.join(trigger.select(KEY, "trigger_reason"), KEY, "left")
        fields.append(F.col("trigger_reason").alias("triggerReason"))
    if commits is not None:
        one = commits.groupBy(KEY, "commit_hash").agg(F.max("commit_ts").alias("commit_ts"),
                                                      *[F.max(c).alias(c) for c in ("message", "author", "repo", "branch")])
        newest = first_rows(one, [KEY], [F.col("commit_ts").desc(), "commit_hash"], COMMITS)
        said = F.concat(F.substring("commit_hash", 1, 8), F.lit(" "), F.col("message"))
        git = newest.groupBy(KEY).agg(
            F.struct(F.min("repo").alias("repo"), F.min("branch").alias("branch"),
                     F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("c")))), lambda s: s["c"])
                     .alias("recentCommits"),
                     F.struct(F.min_by("author", "pos").alias("name")).alias("userConfig")).alias("gitContext"))
        b = b.join(git, KEY, "left")
        fields.append(F.col("gitContext"))
    if snippets is not None:
        lines = F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
        sn = _listed(snippets, [KEY], "ord", F.struct(F.col("file_path").alias("file"), lines.alias("lines"), "content"), "codeSnippets")
        b = b.join(sn, KEY, "left")
        fields.append(F.coalesce("codeSnippets", F.array()).alias("codeSnippets"))
    if similar is not None:
        near = _listed(similar, [KEY], "rank", F.struct(
            "id", "summary", F.col("root_cause").alias("rootCause"), F.round("similarity", 2).alias("similarityScore")),
            "similarIncidents")
        b = b.join(near, KEY, "left")
        fields.append(F.coalesce("similarIncidents", F.array()).alias("similarIncidents"))
    return b.select(KEY, F.to_json(F.struct(*fields)).alias("payload"))
