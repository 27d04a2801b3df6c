"""Dependency graph inference: P3-P7 extractors, U1 service union, W7 depth
order, U2 graph build.

Every extractor is an in-row expression over one pattern / event / metric row
(``regexp_extract_all`` + higher-order array functions), so it runs in the scan
stage with no shuffle.  Only U1 (distinct services per bundle) and W7 (order
per bundle) shuffle, on ``bundle_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.text import clean_service

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------

# Stack frame patterns, tried in this language order.
JAVA_FRAME_RE = r"at\s+([\w.$]+)\.([\w$<>]+)\(([^)]+)\)"
PYTHON_FRAME_RE = r'File\s+"([^"]+)",\s+line\s+\d+,\s+in\s+([\w_]+)'
NODE_FRAME_RE = r"at\s+([\w.]+)?\s*\(?([^:]+\.(?:js|ts)):(\d+):(\d+)\)?"
GO_FRAME_RE = r"([\w/]+\.go):(\d+)"
RUBY_FRAME_RE = r"from\s+([^:]+\.rb):(\d+):in\s+`([^']+)'"
DOTNET_FRAME_RE = r"at\s+([\w.]+)\.([\w<>]+)\(.*?\)(?:\s+in\s+([^:]+))?"

CAUSED_BY_RE = r"(?i)Caused\s+by:\s*([\w.]+Exception|[\w.]+Error)"

# Class-name fragments marking framework frames (substring test).
FRAMEWORK_CLASS_MARKERS = [
    "java.", "javax.", "sun.", "jdk.",
    "org.springframework.", "org.apache.", "org.hibernate.", "com.zaxxer.",
    "reactor.", "io.netty.",
    "System.", "Microsoft.", "mscorlib.",
    "node_modules", "internal/",
]

# Path fragments marking framework files (substring test).
FRAMEWORK_PATH_MARKERS = [
    "site-packages", "dist-packages", "/usr/lib/python", "importlib",
    "django/core", "flask/", "fastapi/", "starlette/", "uvicorn/",
    "node_modules/", "internal/", "<anonymous>",
    "/gems/", "bundler/", "rubygems/",
    "/pkg/mod/", "runtime/",
]

# Service-mention patterns.
CAMEL_RE = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"
SNAKE_RE = r"\b([a-z][a-z0-9]*_[a-z][a-z0-9_]*)\b"
BRACKET_RE = r"\[([\w-]+)\]"
COMPONENT_SUFFIXES = ["Service", "Controller", "Handler", "Pool", "Client", "Repository",
                      "Model", "View", "Router", "Worker", "Job", "Task"]
CONTAINER_RE = r"""(?i)container[_-]?(?:name)?[=:]\s*["']?([\w-]+)"""

# Event reason call pattern.
EVENT_CALL_RE = r"(?i)(?:calling|connecting to|request to)\s+([a-zA-Z][\w-]+)"

# Metric label keys that name a service.
METRIC_SERVICE_LABELS = ["service", "service_name", "container", "deployment", "pod"]

# Infrastructure keywords, deepest first.
INFRA_DEPTH_ORDER = [
    "mysql", "postgres", "pg", "mongodb", "mongo", "redis", "memcached",
    "kafka", "rabbitmq", "amqp", "elasticsearch", "sqlite", "dynamodb", "s3",
    "hikari", "pool", "connection", "datasource", "client", "driver",
    "sqlalchemy", "sequelize", "prisma", "typeorm", "gorm", "activerecord",
    "hibernate", "jpa", "repository", "model", "entity", "dao", "mapper",
    "service", "usecase", "interactor", "domain",
    "controller", "handler", "resolver", "view", "endpoint", "route", "router",
    "tomcat", "jetty", "netty", "express", "fastify", "koa", "gin", "fiber",
    "flask", "django", "fastapi", "uvicorn", "gunicorn", "puma", "unicorn",
    "spring", "rails", "laravel", "nest", "application", "app", "main",
]

CAUSED_BY_CONFIDENCE = 0.8
EVENT_CALL_CONFIDENCE = 0.9
EVIDENCE_CHARS = 100
# ---------------------------------------------------------------------------


def _any_contains(x: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(m) for m in markers])


def _basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _last_dotted(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def stack_chain(text: Column) -> Column:
    """P3 helper: ordered, de-duplicated component names of all stack frames in
    the text, languages in the order Java, Python, Node, Go, Ruby, .NET.
    Returns ``ARRAY<STRUCT<lang, name>>``."""
    def frames(lang: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(lang).alias("lang"), n.alias("name")))

    java_cls = F.regexp_extract_all(text, F.lit(JAVA_FRAME_RE), 1)
    java = F.transform(F.filter(java_cls, lambda c: ~_any_contains(c, FRAMEWORK_CLASS_MARKERS)), _last_dotted)

    py_path = F.regexp_extract_all(text, F.lit(PYTHON_FRAME_RE), 1)
    py = F.transform(F.filter(py_path, lambda p: ~_any_contains(p, FRAMEWORK_PATH_MARKERS)),
                     lambda p: F.replace(_basename(p), F.lit(".py"), F.lit("")))

    node_fn = F.regexp_extract_all(text, F.lit(NODE_FRAME_RE), 1)
    node_path = F.regexp_extract_all(text, F.lit(NODE_FRAME_RE), 2)
    node_z = F.arrays_zip(node_fn.alias("f"), node_path.alias("p"))
    node = F.transform(
        F.filter(node_z, lambda z: ~_any_contains(z["p"], FRAMEWORK_PATH_MARKERS)),
        lambda z: F.when(z["f"] != "", z["f"]).otherwise(
            F.replace(F.replace(_basename(z["p"]), F.lit(".js"), F.lit("")), F.lit(".ts"), F.lit(""))))

    go_path = F.regexp_extract_all(text, F.lit(GO_FRAME_RE), 1)
    go = F.transform(F.filter(go_path, lambda p: ~_any_contains(p, FRAMEWORK_PATH_MARKERS)),
                     lambda p: F.replace(_basename(p), F.lit(".go"), F.lit("")))

    rb_path = F.regexp_extract_all(text, F.lit(RUBY_FRAME_RE), 1)
    rb = F.transform(F.filter(rb_path, lambda p: ~_any_contains(p, FRAMEWORK_PATH_MARKERS)),
                     lambda p: F.replace(_basename(p), F.lit(".rb"), F.lit("")))

    net_cls = F.regexp_extract_all(text, F.lit(DOTNET_FRAME_RE), 1)
    net = F.transform(F.filter(net_cls, lambda c: ~_any_contains(c, FRAMEWORK_CLASS_MARKERS)), _last_dotted)

    allf = F.concat(frames("java", java), frames("python", py), frames("node", node), frames("go", go),
                    frames("ruby", rb), frames("dotnet", net))
    names = F.transform(allf, lambda s: s["name"])
    # keep the first frame of each name (across languages), in order
    return F.filter(allf, lambda s, i: F.array_position(names, s["name"]) == i + 1)


def explode_frames(patterns: DataFrame, keys: tuple[str, ...] = ("bundle_id", "pattern_key"),
                   text: str = "pattern") -> DataFrame:
    """``(*keys, pos, lang, component)`` for every kept stack frame."""
    chain = stack_chain(F.col(text))
    return (patterns.select(*keys, F.posexplode(chain).alias("pos", "f"))
            .select(*keys, F.col("pos").cast("long").alias("pos"), F.col("f.lang").alias("lang"),
                    F.col("f.name").alias("component")))


def caused_by_chain(text: Column) -> Column:
    """P4 helper: exception names of consecutive 'Caused by:' clauses, with
    'Exception'/'Error' removed and the last dotted part kept; len > 2."""
    exc = F.regexp_extract_all(text, F.lit(CAUSED_BY_RE), 1)
    names = F.transform(exc, lambda e: _last_dotted(
        F.replace(F.replace(e, F.lit("Exception"), F.lit("")), F.lit("Error"), F.lit(""))))
    return F.filter(names, lambda n: F.length(n) > 2)


def extract_caused_by_edges(patterns: DataFrame, keys: tuple[str, ...] = ("bundle_id", "pattern_key"),
                            text: str = "pattern") -> DataFrame:
    """``(*keys, pos, caller, callee, evidence, confidence)`` for each
    consecutive pair of the caused-by chain."""
    chain = caused_by_chain(F.col(text))
    pairs = F.transform(F.sequence(F.lit(1), F.size(chain) - 1),
                        lambda i: F.struct(F.element_at(chain, i).alias("caller"),
                                           F.element_at(chain, i + 1).alias("callee")))
    pairs = F.when(F.size(chain) > 1, pairs).otherwise(F.array().cast(
        "array<struct<caller:string,callee:string>>"))
    return (patterns.select(*keys, F.substring(F.col(text), 1, EVIDENCE_CHARS).alias("evidence"),
                            F.posexplode(pairs).alias("pos", "e"))
            .select(*keys, F.col("pos").cast("long").alias("pos"), F.col("e.caller").alias("caller"),
                    F.col("e.callee").alias("callee"), "evidence",
                    F.lit(CAUSED_BY_CONFIDENCE).alias("confidence")))


def service_mentions(text: Column) -> Column:
    """P5 helper: distinct names mentioned in a text (sorted)."""
    parts = [F.regexp_extract_all(text, F.lit(CAMEL_RE), 1),
             F.filter(F.regexp_extract_all(text, F.lit(SNAKE_RE), 1), lambda s: F.length(s) > 4),
             F.regexp_extract_all(text, F.lit(BRACKET_RE), 1)]
    parts += [F.regexp_extract_all(text, F.lit(rf"([\w]+{s})"), 1) for s in COMPONENT_SUFFIXES]
    parts.append(F.regexp_extract_all(text, F.lit(CONTAINER_RE), 1))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def extract_service_mentions(patterns: DataFrame, keys: tuple[str, ...] = ("bundle_id", "pattern_key"),
                             text: str = "pattern") -> DataFrame:
    """P5: ``(*keys, service)`` per mentioned name."""
    return patterns.select(*keys, F.explode(service_mentions(F.col(text))).alias("service"))


def extract_event_services(events: DataFrame, keys: tuple[str, ...] = ("bundle_id",)) -> tuple[DataFrame, DataFrame]:
    """Services named by events (service field, the call target in the
    reason, names mentioned in the reason, cleaned pod name of len > 2) and
    call edges ``service -> target`` with confidence 0.9."""
    reason = F.coalesce(F.col("reason"), F.lit(""))
    target = F.regexp_extract(reason, EVENT_CALL_RE, 1)
    pod = clean_service(F.coalesce(F.col("pod"), F.lit("")))
    names = F.concat(
        F.array(F.when(F.col("service") != "", F.col("service")),
                F.when(target != "", target),
                F.when(F.length(pod) > 2, pod)),
        service_mentions(reason))
    services = (events.select(*keys, F.explode(names).alias("service"))
                .where(F.col("service").isNotNull()).dropDuplicates([*keys, "service"]))
    edges = (events.where((target != "") & F.col("service").isNotNull() & (F.col("service") != ""))
             .select(*keys, F.col("service").alias("caller"), target.alias("callee"),
                     F.substring(reason, 1, EVIDENCE_CHARS).alias("evidence"),
                     F.lit(EVENT_CALL_CONFIDENCE).alias("confidence")))
    return services, edges


def extract_metric_services(metrics: DataFrame, keys: tuple[str, ...] = ("bundle_id",)) -> DataFrame:
    """Non-null string labels that name a service."""
    present = [c for c in METRIC_SERVICE_LABELS if c in metrics.columns]
    stacked = F.explode(F.array(*[F.col(c).cast("string") for c in present]))
    return (metrics.select(*keys, stacked.alias("service")).where(F.col("service").isNotNull())
            .dropDuplicates([*keys, "service"]))


def all_services(patterns: DataFrame, keys: tuple[str, ...] = ("bundle_id",), pattern_id: str = "pattern_key",
                 text: str = "pattern", extra: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct services per bundle from frames, mentions and caused-by
    names (plus optional event/metric service tables).  Also returns the chain
    depth per (bundle, name): max(pos + 1) over all stack chains."""
    keys = list(keys)
    frames = explode_frames(patterns, (*keys, pattern_id), text)
    caused = patterns.select(*keys, F.explode(caused_by_chain(F.col(text))).alias("service"))
    mentions = extract_service_mentions(patterns, (*keys, pattern_id), text).drop(pattern_id)
    no_pos = F.lit(None).cast("long").alias("pos")
    parts = [frames.select(*keys, F.col("component").alias("service"), "pos"),
             mentions.select(*keys, "service", no_pos), caused.select(*keys, "service", no_pos)]
    for e in extra or []:
        parts.append(e.select(*keys, "service", no_pos))
    # one aggregation gives both the distinct services and their chain depth
    agg = reduce(DataFrame.unionByName, parts).groupBy(*keys, "service").agg(
        F.max(F.col("pos") + 1).alias("chain_depth"))
    services = agg.select(*keys, "service")
    chain_depth = agg.where(F.col("chain_depth").isNotNull())
    return services, chain_depth


def infra_depth(name: Column) -> Column:
    """Score of the first infrastructure keyword contained in lower(name)
    (deepest keyword = highest score); 0 when none."""
    low = F.lower(name)
    n = len(INFRA_DEPTH_ORDER)
    expr = None
    for i, kw in enumerate(INFRA_DEPTH_ORDER):
        expr = (F.when(low.contains(kw), F.lit(n - i)) if expr is None
                else expr.when(low.contains(kw), F.lit(n - i)))
    return expr.otherwise(F.lit(0))


def order_by_depth(services: DataFrame, chain_depth: DataFrame, keys: tuple[str, ...] = ("bundle_id",)) -> DataFrame:
    """``(*keys, node, depth_score, position, n_nodes)``; deepest first,
    ties by name."""
    keys = list(keys)
    s = services.join(chain_depth, [*keys, "service"], "left")
    s = s.withColumn("depth_score", F.greatest(infra_depth(F.col("service")),
                                               F.coalesce(F.col("chain_depth"), F.lit(0))).cast("long"))
    from tracefold.operators.scan import ordinal
    bucket = F.struct((-F.col("depth_score")).alias("d"), F.substring("service", 1, 2).alias("p"))
    s = ordinal(s, keys, [F.col("depth_score").desc(), "service"], bucket, "position")
    n = s.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n_nodes"))
    return s.join(n, keys).select(*keys, F.col("service").alias("node"), "depth_score", "position", "n_nodes")


def root_service(nodes: DataFrame, keys: tuple[str, ...] = ("bundle_id",)) -> DataFrame:
    """Root = first node containing 'application' or equal to 'app'/'main',
    else the last (shallowest) node."""
    low = F.lower(F.col("node"))
    is_app = low.contains("application") | (low == "app") | (low == "main")
    return nodes.groupBy(*keys).agg(
        F.coalesce(F.min_by(F.col("node"), F.when(is_app, F.col("position"))),
                   F.max_by(F.col("node"), F.col("position"))).alias("root_service"))


def merge_edges(edges: list[DataFrame], keys: tuple[str, ...] = ("bundle_id",)) -> DataFrame:
    """One edge per (bundle, caller, callee): the highest confidence, the evidence
    that has it (the smallest text of several) and how often the edge was found."""
    found = reduce(DataFrame.unionByName, [e.select(*keys, "caller", "callee", "evidence", "confidence") for e in edges])
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.col("evidence").alias("e"))).alias("best")
    return found.groupBy(*keys, "caller", "callee").agg(best, F.count(F.lit(1)).alias("n_found")).select(
        *keys, "caller", "callee", (-F.col("best.c")).alias("confidence"), F.col("best.e").alias("evidence"), "n_found")


def without_graph(df: DataFrame, user_nodes: DataFrame | None, keys: list[str]) -> DataFrame:
    """The rows of bundles whose user graph is empty."""
    if user_nodes is None:
        return df
    return df.join(user_nodes.select(*keys).distinct(), keys, "left_anti")


def build_graph(patterns: DataFrame, user_nodes: DataFrame | None = None, keys: tuple[str, ...] = ("bundle_id",),
                pattern_id: str = "pattern_key", text: str = "pattern", extra: list[DataFrame] | None = None) -> DataFrame:
    """The graph nodes used for ranking.  Bundles with a user-supplied
    graph (``user_nodes``: keys, node, position, n_nodes) keep it; the rest are
    auto-extracted (U1 + W7) from their patterns and, where ``extra`` service
    tables (P6, P7) are given, from these."""
    keys = list(keys)
    services, depth = all_services(without_graph(patterns, user_nodes, keys), keys, pattern_id, text,
                                   [without_graph(e, user_nodes, keys) for e in extra or []])
    auto = order_by_depth(services, depth, keys)
    if user_nodes is None:
        return auto
    return auto.unionByName(user_nodes.select(*keys, "node", F.lit(None).cast("long").alias("depth_score"),
                                              "position", "n_nodes"))


def graph_edges(patterns: DataFrame, events: DataFrame | None = None, user_nodes: DataFrame | None = None,
                keys: tuple[str, ...] = ("bundle_id",), pattern_id: str = "pattern_key", text: str = "pattern") -> DataFrame:
    """The edges of auto-extracted bundles, from causes (P4) and event reasons
    (P6); a user graph is a list of nodes and has none."""
    keys = list(keys)
    edges = [extract_caused_by_edges(without_graph(patterns, user_nodes, keys), (*keys, pattern_id), text)]
    if events is not None:
        edges.append(extract_event_services(without_graph(events, user_nodes, keys), tuple(keys))[1])
    return merge_edges(edges, tuple(keys))
