"""Merged edges, user graphs, and data that reaches the extractors' branches."""

from collections import Counter

from conftest import SF_ORACLE
from pyspark.sql import functions as F

from tracefold.operators import depgraph as G
from tracefold.plans import registry


def test_edges_keep_the_highest_confidence_and_its_evidence(spark):
    pats = spark.createDataFrame([
        ("b1", "p1", "Caused by: a.OrderError: x\nCaused by: a.StockException: y\nCaused by: a.PoolException: z"),
        ("b1", "p2", "again Caused by: a.OrderError: x\nCaused by: a.StockException: y"),
        ("b2", "p3", "Caused by: a.OrderError: x\nCaused by: a.StockException: y")],
        "bundle_id string, pattern_key string, pattern string")
    ev = spark.createDataFrame([("b1", "Order", "calling Stock failed", None), ("b1", "Order", "another request to Stock", None),
                                ("b1", "web", "nothing", "web-5d4f8b-xkz2p"), ("b2", "a-svc", "connecting to b-svc", None)],
                               "bundle_id string, service string, reason string, pod string")
    got = {(r["bundle_id"], r["caller"], r["callee"]): (r["confidence"], r["evidence"], r["n_found"])
           for r in G.graph_edges(pats, ev).collect()}
    assert got["b1", "Order", "Stock"] == (0.9, "another request to Stock", 4)
    assert got["b1", "Stock", "Pool"][0] == 0.8 and got["b1", "Stock", "Pool"][2] == 1
    assert set(got) == {("b1", "Order", "Stock"), ("b1", "Stock", "Pool"), ("b2", "Order", "Stock"), ("b2", "a-svc", "b-svc")}
    own = spark.createDataFrame([("b2", "n1", 0, 2), ("b2", "n0", 1, 2)], "bundle_id string, node string, position long, n_nodes long")
    assert {r["bundle_id"] for r in G.graph_edges(pats, ev, own).collect()} == {"b1"}
    nodes = G.build_graph(pats, own, extra=[G.extract_event_services(ev)[0]])
    assert [r["node"] for r in nodes.where("bundle_id = 'b2'").orderBy("position").collect()] == ["n1", "n0"]
    assert {r["node"] for r in nodes.where("bundle_id = 'b1'").collect()} >= {"Order", "Stock", "Pool", "web"}


def test_queries_reach_every_language_and_both_graphs(spark):
    q = registry.queries()
    langs = Counter(r["lang"] for r in q["P3_explode_frames"](spark, SF_ORACLE).collect())
    assert set(langs) == {"java", "python", "node", "go", "ruby", "dotnet"}
    assert {r["pos"] for r in q["P3_explode_frames"](spark, SF_ORACLE).select("pos").distinct().collect()} >= {0, 1}
    edges = q["P4_caused_by_edges"](spark, SF_ORACLE)
    assert edges.count() > 50 and edges.select("caller", "callee").distinct().count() > 1
    rows = Counter((r["kind"], r["origin"]) for r in q["U2_build_graph"](spark, SF_ORACLE).select("kind", "origin").collect())
    assert min(rows["node", "user"], rows["node", "auto"], rows["edge", "auto"]) > 100
    bundles = q["U2_build_graph"](spark, SF_ORACLE).where("kind = 'node'").groupBy("bundle_id").agg(F.count_distinct("origin").alias("n"))
    assert bundles.where("n > 1").count() == 0
