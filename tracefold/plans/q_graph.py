"""Registered queries: dependency-graph inference and graph-aware ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracefold.operators import correlate as C
from tracefold.operators import depgraph as G
from tracefold.plans import flows as FL
from tracefold.plans import oracle as O
from tracefold.plans.registry import register
from tracefold.session import table

GAP = FL.FIXTURE_GAP_SECONDS
_G = "WITH " + O.patterns_b_ctes() + O.graph_ctes()


@register("P3_explode_frames", _G + """
SELECT bundle_id, pattern_key, pos, lang, component FROM frames""")
def q_explode_frames(spark, sf_dir):
    return G.explode_frames(FL.patterns_b(spark, sf_dir))


@register("P4_caused_by_edges", _G + """,
cb AS (SELECT bundle_id, pattern_key, substr(pattern, 1, 100) AS evidence, caused FROM frame_lists
  WHERE len(caused) > 1)
SELECT bundle_id, pattern_key, CAST(i - 1 AS BIGINT) AS pos, caused[i] AS caller, caused[i + 1] AS callee, evidence,
  CAST(0.8 AS DOUBLE) AS confidence
FROM (SELECT *, unnest(generate_series(1, len(caused) - 1)) AS i FROM cb)""")
def q_caused_by_edges(spark, sf_dir):
    return G.extract_caused_by_edges(FL.patterns_b(spark, sf_dir))


@register("P5_service_mentions", _G + """
SELECT bundle_id, pattern_key, service FROM mentions""")
def q_service_mentions(spark, sf_dir):
    return G.extract_service_mentions(FL.patterns_b(spark, sf_dir))


@register("U1_all_services", _G + """
SELECT bundle_id, service FROM services""")
def q_all_services(spark, sf_dir):
    _, services, _, _ = FL.graph_b(spark, sf_dir)
    return services


@register("W7_order_by_depth", _G + """
SELECT bundle_id, node, depth_score, position, n_nodes FROM nodes""")
def q_order_by_depth(spark, sf_dir):
    _, _, _, nodes = FL.graph_b(spark, sf_dir)
    return nodes


@register("W7b_root_service", _G + """
SELECT bundle_id, coalesce(
  arg_min(node, position) FILTER (WHERE contains(lower(node), 'application') OR lower(node) IN ('app', 'main')),
  arg_max(node, position)) AS root_service
FROM nodes GROUP BY bundle_id""")
def q_root_service(spark, sf_dir):
    _, _, _, nodes = FL.graph_b(spark, sf_dir)
    return G.root_service(nodes)


@register("J2_match_dependencies", _G + """
SELECT p.bundle_id, p.pattern_key, coalesce(d.dependency_score, 0) AS dependency_score
FROM patterns_b p LEFT JOIN dep d ON p.bundle_id = d.bundle_id AND p.pattern_key = d.pattern_key""")
def q_match_dependencies(spark, sf_dir):
    pats, _, _, nodes = FL.graph_b(spark, sf_dir)
    return C.match_dependencies(pats, C.dependency_priority(nodes)).select(
        "bundle_id", "pattern_key", "dependency_score")


@register("U2_rank_with_graph", "WITH " + O.causes_ctes(GAP, dep_cte=O.graph_ctes()) + """
SELECT bundle_id, cluster_no, CAST(rank AS BIGINT) AS rank, pattern_key,
  CAST(severity_score AS BIGINT) AS severity_score, dependency_score, reason FROM causes""")
def q_rank_with_graph(spark, sf_dir):
    r = FL.causes_with_graph_b(spark, sf_dir)
    return r.select("bundle_id", "cluster_no", "rank", "pattern_key",
                    F.col("severity_score").cast("long").alias("severity_score"), "dependency_score", "reason")


# --- U2: nodes and edges, half the bundles with a graph of their own -------------

def user_graph(spark, sf_dir):
    """Stand-in user graphs: the bundles of even days list a handler per type of
    their service's events, the most frequent first."""
    ev = table(spark, sf_dir, "events").where(F.dayofmonth("ts") % 2 == 0).select(
        F.concat(FL.service_of(), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("bundle_id"),
        F.concat("event_type", F.lit("_handler")).alias("node"))
    w = Window.partitionBy("bundle_id")
    n = ev.groupBy("bundle_id", "node").agg(F.count(F.lit(1)).alias("n"))
    return n.select("bundle_id", "node", (F.row_number().over(w.orderBy(F.col("n").desc(), "node")) - 1).cast("long").alias("position"),
                    F.count(F.lit(1)).over(w).alias("n_nodes"))


_EVENTS = O.graph_ctes() + O.bundle_ctes()


@register("U2_build_graph", "WITH " + O.patterns_b_ctes() + _EVENTS + f""",
un AS (SELECT {O.service_case_sql()} || '/' || strftime(ts, '%Y-%m-%d') AS bundle_id, event_type || '_handler' AS node,
  count(*) AS n FROM events WHERE day(ts) % 2 = 0 GROUP BY ALL),
users AS (SELECT bundle_id, node, row_number() OVER (PARTITION BY bundle_id ORDER BY n DESC, node) - 1 AS position FROM un),
evx AS (SELECT *, regexp_extract(reason, '{G.EVENT_CALL_RE}', 1) AS target FROM ev_b
  WHERE bundle_id NOT IN (SELECT bundle_id FROM users)),
autos AS (
  SELECT bundle_id, service FROM services UNION SELECT bundle_id, service FROM evx UNION
  SELECT bundle_id, target FROM evx WHERE target <> '' UNION
  SELECT bundle_id, unnest({O.mentions_sql('reason')}) FROM evx UNION
  SELECT bundle_id, {O.clean_service_sql('pod')} FROM evx WHERE length({O.clean_service_sql('pod')}) > 2),
auton AS (SELECT a.bundle_id, a.service AS node, CAST(greatest({O.infra_depth_sql('a.service')}, coalesce(d.chain_depth, 0)) AS BIGINT)
    AS depth_score FROM autos a LEFT JOIN chain_depth d USING (bundle_id, service)
  WHERE a.bundle_id NOT IN (SELECT bundle_id FROM users)),
edges0 AS (
  SELECT bundle_id, caused[i] AS caller, caused[i + 1] AS callee, substr(pattern, 1, 100) AS evidence, 0.8::DOUBLE AS confidence
  FROM (SELECT *, unnest(generate_series(1, len(caused) - 1)) AS i FROM frame_lists WHERE len(caused) > 1)
  WHERE bundle_id NOT IN (SELECT bundle_id FROM users)
  UNION ALL SELECT bundle_id, service, target, substr(reason, 1, 100), 0.9::DOUBLE FROM evx WHERE target <> ''),
edges AS (SELECT bundle_id, caller, callee, max(confidence) AS confidence, count(*) AS n_found FROM edges0 GROUP BY ALL)
SELECT bundle_id, 'node' AS kind, 'user' AS origin, node, position, NULL::BIGINT AS depth_score, NULL AS caller, NULL AS callee,
  NULL::DOUBLE AS confidence, NULL AS evidence, NULL::BIGINT AS n_found FROM users
UNION ALL SELECT bundle_id, 'node', 'auto', node, row_number() OVER (PARTITION BY bundle_id ORDER BY depth_score DESC, node) - 1,
  depth_score, NULL, NULL, NULL, NULL, NULL FROM auton
UNION ALL SELECT e.bundle_id, 'edge', 'auto', NULL, NULL, NULL, caller, callee, e.confidence,
  (SELECT min(evidence) FROM edges0 x WHERE x.bundle_id = e.bundle_id AND x.caller = e.caller AND x.callee = e.callee
   AND x.confidence = e.confidence), n_found FROM edges e""")
def q_build_graph(spark, sf_dir):
    """Nodes and edges of every bundle."""
    pats, ev, own = FL.patterns_b(spark, sf_dir), FL.events_b(spark, sf_dir), user_graph(spark, sf_dir)
    named, _ = G.extract_event_services(ev)
    nodes = G.build_graph(pats, own, extra=[named]).select(
        "bundle_id", F.lit("node").alias("kind"), F.when(F.col("depth_score").isNull(), "user").otherwise("auto").alias("origin"),
        "node", "position", "depth_score")
    edges = G.graph_edges(pats, ev, own).withColumn("kind", F.lit("edge")).withColumn("origin", F.lit("auto"))
    return nodes.unionByName(edges, allowMissingColumns=True)
