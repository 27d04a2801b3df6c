"""Bundle documents: A10 assemble, S3 write, S4 read, P17 explode.

A bundle is one nested row per incident.  Writing is ``to_json`` (null fields
dropped) of the ``{bundle, use_rag, top_k}`` envelope; reading is ``from_json``
with an explicit schema, key aliases and empty-object -> NULL, and malformed
documents go to a side table instead of disappearing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "file", "container", "namespace", "node")])

LOG_PATTERN = T.StructType([
    T.StructField("pattern", T.StringType()), T.StructField("count", T.LongType()),
    T.StructField("firstOccurrence", T.StringType()), T.StructField("lastOccurrence", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("errorClass", T.StringType()),
    T.StructField("rootService", T.StringType()),
    # the reference accepts a string or a list here; read as text, normalised below
    T.StructField("affectedService", T.StringType()),
    T.StructField("logSource", LOG_SOURCE)])

EVENT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "type", "reason", "pod", "service", "timestamp")])

METRICS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("cpuZ", "memZ", "latencyZ", "errorRateZ")]
                       + [T.StructField("anomalyVector", T.ArrayType(T.DoubleType()))])

SEQUENCE_ITEM = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("type", T.StringType()),
                              T.StructField("message", T.StringType()), T.StructField("sequenceIndex", T.LongType())])

FLUSH_METADATA = T.StructType([T.StructField("reason", T.StringType()), T.StructField("log_count", T.LongType()),
                               T.StructField("flushed_at", T.StringType())])

GIT_CONFIG = T.StructType([T.StructField(n, T.StringType())
                           for n in ("user_name", "user_email", "local_config_content", "global_config_content")])

GIT_CONTEXT = T.StructType([
    T.StructField("repo_url", T.StringType()), T.StructField("branch", T.StringType()),
    T.StructField("commit_hash", T.StringType()), T.StructField("recent_commits", T.ArrayType(T.StringType())),
    T.StructField("changed_files", T.ArrayType(T.StringType())), T.StructField("diff", T.StringType())])

CODE_SNIPPET = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("content", T.StringType()),
                             T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType())])

BUNDLE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("windowStart", T.StringType()),
    T.StructField("windowEnd", T.StringType()), T.StructField("rootService", T.StringType()),
    T.StructField("affectedServices", T.ArrayType(T.StringType())),
    T.StructField("logPatterns", T.ArrayType(LOG_PATTERN)), T.StructField("events", T.ArrayType(EVENT)),
    T.StructField("metrics", METRICS), T.StructField("dependencyGraph", T.ArrayType(T.StringType())),
    T.StructField("sequence", T.ArrayType(SEQUENCE_ITEM)),
    T.StructField("derivedRootCauseHint", T.StringType()), T.StructField("flush_metadata", FLUSH_METADATA),
    T.StructField("git_context", GIT_CONTEXT), T.StructField("code_snippets", T.ArrayType(CODE_SNIPPET)),
    T.StructField("git_config", GIT_CONFIG), T.StructField("gitConfig", GIT_CONFIG)])

#: A document is a bundle, or an envelope with one.
DOCUMENT = T.StructType([*BUNDLE.fields, T.StructField("bundle", BUNDLE)])


def stable_bundle_id(key: Column) -> Column:
    """Deterministic incident id from the bundle key (replaces a random uuid)."""
    return F.concat(F.lit("incident_"), F.substring(F.sha2(key, 256), 1, 16))


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def assemble_bundles(patterns: DataFrame, windows: DataFrame, *, root: DataFrame | None = None,
                     affected: DataFrame | None = None, events: DataFrame | None = None,
                     metrics: DataFrame | None = None, nodes: DataFrame | None = None,
                     sequence: DataFrame | None = None, hint: DataFrame | None = None, flush: DataFrame | None = None,
                     key: str = "bundle_id", ts_format=None) -> DataFrame:
    """A10: one nested bundle row per ``key`` from child tables.  Child lists
    are ``collect_list(struct(ord, ...))`` sorted by ``ord``; every list holds
    deduplicated items of one bundle (patterns, events, graph nodes)."""
    from tracefold.functions.text import clean_service
    from tracefold.functions.time import iso_seconds
    fmt = ts_format or iso_seconds
    lp = patterns.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        F.col("pattern_ord").alias("o"),
        F.struct(F.col("pattern"), F.col("count"), fmt(F.col("first_ts")).alias("firstOccurrence"),
                 fmt(F.col("last_ts")).alias("lastOccurrence"), F.col("error_class").alias("severity"),
                 F.lit(None).cast("string").alias("errorClass"), F.lit(None).cast("string").alias("rootService"),
                 F.when(F.col("container").isNotNull(), clean_service(F.col("container"))).alias("affectedService"),
                 F.struct(F.lit("application").alias("type"), F.lit(None).cast("string").alias("file"),
                          _blank_to_null(F.col("container")).alias("container"),
                          F.lit(None).cast("string").alias("namespace"),
                          F.lit(None).cast("string").alias("node")).alias("logSource")).alias("p")))),
        lambda s: s["p"]).alias("logPatterns"))
    b = windows.select(key, fmt(F.col("window_start")).alias("windowStart"),
                       fmt(F.col("window_end")).alias("windowEnd")).join(lp, key, "left")
    if root is not None:
        b = b.join(root.select(key, F.col("root_service").alias("rootService")), key, "left")
    if affected is not None:
        b = b.join(affected.select(key, F.col("affected_services").alias("affectedServices")), key, "left")
    if events is not None:
        ev = events.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(
            F.col("ts").alias("o1"), F.col("id").alias("o2"),
            F.struct("id", "type", "reason", "pod", "service", fmt(F.col("ts").cast("timestamp")).alias("timestamp"))
            .alias("e")))), lambda s: s["e"]).alias("events"))
        b = b.join(ev, key, "left")
    if metrics is not None:
        b = b.join(metrics.select(key, F.struct(
            F.col("cpu_z").alias("cpuZ"), F.col("mem_z").alias("memZ"), F.col("latency_z").alias("latencyZ"),
            F.col("error_rate_z").alias("errorRateZ")).alias("metrics")), key, "left")
    if nodes is not None:
        g = nodes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "node"))),
                                               lambda s: s["node"]).alias("dependencyGraph"))
        b = b.join(g, key, "left")
    if sequence is not None:
        sq = sequence.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(
            F.col("sequence_index").alias("o"),
            F.struct(fmt(F.col("ts")).alias("timestamp"), F.col("type"), F.col("message"),
                     F.col("sequence_index").alias("sequenceIndex")).alias("s")))), lambda s: s["s"]).alias("sequence"))
        b = b.join(sq, key, "left")
    if hint is not None:
        b = b.join(hint.select(key, F.col("hint").alias("derivedRootCauseHint")), key, "left")
    if flush is not None:
        b = b.join(flush.select(key, F.struct("reason", "log_count", fmt(F.col("flushed_at")).alias("flushed_at"))
                                .alias("flush_metadata")), key, "left")
    return b.withColumn("id", stable_bundle_id(F.col(key)))


def bundles_to_json(bundles: DataFrame, key: str = "bundle_id", use_rag: bool = True, top_k: int = 5) -> DataFrame:
    """S3: ``(key, json)`` with the request envelope; NULL fields are omitted."""
    fields = [c for c in BUNDLE.fieldNames() if c in bundles.columns]
    env = F.struct(F.struct(*[F.col(c) for c in fields]).alias("bundle"), F.lit(use_rag).alias("use_rag"),
                   F.lit(top_k).alias("top_k"))
    return bundles.select(key, F.to_json(env).alias("json"))


def write_bundles(bundles: DataFrame, path: str, key: str = "bundle_id") -> None:
    """S3 sink: one JSON document per line."""
    bundles_to_json(bundles, key).select("json").write.mode("overwrite").text(path)


def write_bundles_batch(batch: DataFrame, batch_id: int, path: str, query_id: str = "q") -> None:
    """A micro-batch's bundles go to their own ``query_id/batch_id`` folder with
    overwrite, so a replayed batch rewrites the same output (idempotent)."""
    bundles_to_json(batch).select("json").write.mode("overwrite").text(f"{path}/{query_id}/batch_id={batch_id}")


def _empty_struct_to_null(c: Column, fields) -> Column:
    return F.when(reduce_or([c[f].isNotNull() for f in fields]), c)


def reduce_or(cols):
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


#: Characters from which a text may pass the limit of the variant type (128 MiB).
LONG_JSON = 16 << 20


def _is_json(raw: Column) -> Column:
    """Whether a text is JSON; a long object or array is JSON too where it is too large for a variant."""
    large = F.json_object_keys(raw).isNotNull() | F.json_array_length(raw).isNotNull()
    return F.try_parse_json(raw).isNotNull() | ((F.length(raw) > LONG_JSON) & large)


def read_bundles(docs: DataFrame, json_col: str = "json", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Parse bundle documents (bare bundle or ``{bundle: ...}`` envelope).

    Returns ``(bundles, corrupt)``: typed rows, and the documents that hold no
    bundle, whole, as ``_corrupt_record`` with a ``reason``: ``malformed`` (no JSON,
    or NULL), ``not an object``, ``no bundle`` (an object without any field of one).
    Both carry the ``keep`` columns of ``docs``, whose names must differ from theirs.

    ``errorClass`` is read as an alias of ``severity``, ``affectedService`` is always
    a list, ``gitConfig`` is an alias of ``git_config`` and an empty object there is
    NULL; a missing list or a JSON null for one becomes an empty list, a missing
    or null ``metrics`` an object without values.  Missing times stay NULL."""
    raw, keep = F.col(json_col), list(keep)
    # a generated row: filters on its fields stay above it, so a text is parsed once and not in each filter again
    once = F.explode_outer(F.array(F.struct(_is_json(raw).alias("json"), F.from_json(raw, DOCUMENT).alias("d"))))
    parsed = docs.select(*keep, raw.alias("__raw"), once.alias("__p")).select(
        *keep, "__raw", F.col("__p.json").alias("__json"), F.col("__p.d").alias("__d"))
    bare = F.struct(*[F.col(f"__d.{f}").alias(f) for f in BUNDLE.fieldNames()])
    parsed = parsed.withColumn("__b", F.coalesce(F.col("__d.bundle"), bare))
    some = reduce_or([F.col(f"__b.{f}").isNotNull() for f in BUNDLE.fieldNames()])
    parsed = parsed.withColumn("__why", F.when(~F.col("__json"), "malformed")
                               .when(~F.col("__raw").rlike(r"^\s*\{"), "not an object").when(~some, "no bundle"))
    corrupt = parsed.where(F.col("__why").isNotNull()).select(
        *keep, F.col("__raw").alias("_corrupt_record"), F.col("__why").alias("reason"))
    good = parsed.where(F.col("__why").isNull())
    no_metrics = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in METRICS])
    aff = lambda p: F.when(F.trim(p["affectedService"]).startswith("["),
                           F.from_json(p["affectedService"], T.ArrayType(T.StringType()))).when(
        p["affectedService"].isNotNull(), F.array(p["affectedService"]))
    pats = F.transform(F.col("__b.logPatterns"), lambda p: F.struct(
        p["pattern"].alias("pattern"), p["count"].alias("count"), p["firstOccurrence"].alias("firstOccurrence"),
        p["lastOccurrence"].alias("lastOccurrence"), F.coalesce(p["severity"], p["errorClass"]).alias("severity"),
        p["rootService"].alias("rootService"), aff(p).alias("affectedService"), p["logSource"].alias("logSource")))
    gc = F.coalesce(_empty_struct_to_null(F.col("__b.git_config"), GIT_CONFIG.fieldNames()),
                    _empty_struct_to_null(F.col("__b.gitConfig"), GIT_CONFIG.fieldNames()))
    cols = [*keep, *[F.col(f"__b.{c}").alias(c) for c in ("id", "windowStart", "windowEnd", "rootService")]]
    cols += [F.coalesce(F.col("__b.affectedServices"), F.array().cast("array<string>")).alias("affectedServices"),
             F.coalesce(pats, F.array()).alias("logPatterns"),
             F.coalesce(F.col("__b.events"), F.array()).alias("events"),
             F.coalesce(F.col("__b.metrics"), no_metrics).alias("metrics"),
             F.coalesce(F.col("__b.dependencyGraph"), F.array().cast("array<string>")).alias("dependencyGraph"),
             F.coalesce(F.col("__b.sequence"), F.array()).alias("sequence"),
             F.col("__b.derivedRootCauseHint").alias("derivedRootCauseHint"),
             F.col("__b.flush_metadata").alias("flush_metadata"), F.col("__b.git_context").alias("git_context"),
             F.coalesce(F.col("__b.code_snippets"), F.array()).alias("code_snippets"), gc.alias("git_config")]
    return good.select(*cols), corrupt


def explode_bundles(bundles: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Child tables with ordinals: patterns, events, sequence."""
    out = {}
    for name, col in (("patterns", "logPatterns"), ("events", "events"), ("sequence", "sequence")):
        out[name] = (bundles.select(key, F.posexplode_outer(col).alias("ord", "item"))
                     .where(F.col("item").isNotNull()).select(key, F.col("ord").cast("long").alias("ord"), "item.*"))
    return out
