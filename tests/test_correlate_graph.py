"""W1, W2, W3, W4, J8, W5, J2 and the dependency graph on literal frames."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracefold.operators import correlate as C
from tracefold.operators import depgraph as G
from tracefold.operators import scan as S

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def pats(spark, rows):
    return spark.createDataFrame(
        [("b", f"k{i}", p, c, None if s is None else T0 + dt.timedelta(seconds=s), lvl, i, r)
         for i, (p, c, s, lvl, r) in enumerate(rows)],
        "bundle_id string, pattern_key string, pattern string, count long, first_ts timestamp, "
        "error_class string, first_entry_no long, sev_rank int")


def test_cluster_by_gap_boundary_and_nulls(spark):
    rows = [("a", 1, 0.0, "INFO", 2), ("b", 1, 2.0, "INFO", 2), ("c", 1, 4.5, "INFO", 2),
            ("d", 1, None, "INFO", 2), ("e", 1, 4.5, "INFO", 2), ("f", 1, None, "INFO", 2)]
    for bucket in (1, 3600):
        c = {r.pattern: r.cluster_no for r in C.cluster_by_gap(pats(spark, rows), gap_seconds=2.0,
                                                               bucket_seconds=bucket).collect()}
        assert c == {"d": 0, "f": 1, "a": 2, "b": 2, "c": 3, "e": 3}   # gap == 2.0 stays; nulls first


def test_gap_sessions_random_against_plain_window(spark):
    rnd = random.Random(7)
    rows = [(f"s{rnd.randint(0, 2)}", i, T0 + dt.timedelta(seconds=rnd.randint(0, 20000))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, n long, ts timestamp")
    got = S.gap_sessions(df, ["k"], "ts", ["n"], 300_000_000, "c", bucket_seconds=600)
    w = Window.partitionBy("k").orderBy("ts", "n")
    prev = F.lag(F.unix_micros("ts")).over(w)
    ref = df.withColumn("f", F.when(prev.isNull() | (F.unix_micros("ts") - prev > 300_000_000), 1).otherwise(0))
    ref = ref.withColumn("c", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    assert sorted(map(tuple, got.select("n", "c").collect())) == sorted(map(tuple, ref.select("n", "c").collect()))


def test_running_scans_against_plain_window(spark):
    rnd = random.Random(3)
    rows = [(f"s{rnd.randint(0, 3)}", i * 3 + rnd.randint(0, 2), rnd.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, n long, flag boolean")
    got = S.running_sum(df, ["k"], ["n"], F.col("flag").cast("long"), "rs", S.numeric_bucket("n", 17))
    got = S.carry_forward_max(got, ["k"], ["n"], F.when(F.col("flag"), F.col("n")), "last", S.numeric_bucket("n", 17))
    w = Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("rs", F.sum(F.col("flag").cast("long")).over(w)).withColumn(
        "last", F.max(F.when(F.col("flag"), F.col("n"))).over(w))
    cols = ["k", "n", "rs", "last"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, ref.select(cols).collect()))


def test_smart_sorting(spark):
    """49 noisy INFO patterns (count 100) and one FATAL (count 1): FATAL ranks first."""
    rows = [(f"Health check ok {i}", 100, float(i), "INFO", 2) for i in range(49)]
    rows.append(("FATAL: database corrupted", 1, 60.0, "FATAL", 3))
    top = C.prioritize_patterns(pats(spark, rows), limit=20, keyword_set="prompt")
    got = top.orderBy("priority").collect()
    assert len(got) == 20 and got[0].pattern.startswith("FATAL")


def test_rank_root_causes_and_effects(spark):
    rows = [("WARN pool 48/50", 2, 0.0, "WARNING", 1), ("INFO request", 9, 0.5, "INFO", 2),
            ("ERROR SQLException", 1, 1.0, "ERROR", 0), ("FATAL out of memory", 1, 1.5, "ERROR", 0)]
    cl = C.cluster_by_gap(pats(spark, rows), gap_seconds=2.0)
    causes = C.rank_root_causes(cl).orderBy("rank").collect()
    assert [r.pattern for r in causes] == ["FATAL out of memory", "ERROR SQLException", "WARN pool 48/50"]
    assert causes[0].reason == "CRITICAL/FATAL severity"
    assert causes[2].reason == "WARNING level; occurred 2x"
    eff = C.effects(cl, C.rank_root_causes(cl)).collect()
    assert [r.pattern for r in eff] == ["INFO request"]
    ranked = C.rank_clusters(cl, C.rank_root_causes(cl)).first()
    assert ranked.top_severity == 100 and ranked.cluster_rank == 1


def test_dependency_priority_and_match(spark):
    nodes = spark.createDataFrame([("b", "Redis", 0, 3), ("b", "UserService", 1, 3), ("b", "api", 2, 3)],
                                  "bundle_id string, node string, position long, n_nodes long")
    p = pats(spark, [("timeout calling redis from userservice", 1, 0.0, "INFO", 2), ("nothing here", 1, 0.0, "INFO", 2)])
    m = {r.pattern_key: r.dependency_score
         for r in C.match_dependencies(p, C.dependency_priority(nodes)).collect()}
    assert m == {"k0": 2, "k1": 0}


def test_stack_chain_languages(spark):
    text = "\n".join([
        "java.lang.IllegalStateException: boom",
        "    at org.springframework.web.Dispatcher.doService(Dispatcher.java:10)",
        "    at com.acme.order.OrderController.create(OrderController.java:42)",
        "    at com.acme.order.OrderService.place(OrderService.java:77)",
        '  File "/usr/lib/python3/site-packages/flask/app.py", line 10, in wsgi_app',
        '  File "/srv/app/payments.py", line 12, in charge',
        "    at processTicksAndRejections (node:internal/process/task_queues:95:5)",
        "    at handler (/srv/api/routes.js:14:3)",
        "main.go:33 +0x1d",
        "from /srv/app/models/user.rb:9:in `save'",
        "Caused by: java.sql.SQLTimeoutException: pool",
        "Caused by: org.postgresql.PSQLException: refused",
    ])
    df = spark.createDataFrame([("b", "k", text)], "bundle_id string, pattern_key string, pattern string")
    chain = [(r.lang, r.component) for r in G.explode_frames(df).orderBy("pos").collect()]
    assert chain[:3] == [("java", "OrderController"), ("java", "OrderService"), ("python", "payments")]
    assert ("node", "handler") in chain and ("go", "main") in chain and ("ruby", "user") in chain
    edges = G.extract_caused_by_edges(df).collect()
    assert [(e.caller, e.callee, e.confidence) for e in edges] == [("SQLTimeout", "PSQL", 0.8)]


def test_depth_order_and_root(spark):
    df = spark.createDataFrame([("b", "k", "at com.a.DemoApplication.main(DemoApplication.java:1)\n"
                                           "at com.a.UserService.get(UserService.java:2)\n"
                                           "at com.a.UserRepository.find(UserRepository.java:3)")],
                               "bundle_id string, pattern_key string, pattern string")
    services, depth = G.all_services(df)
    nodes = G.order_by_depth(services, depth).orderBy("position").collect()
    names = [n.node for n in nodes]
    assert names.index("UserRepository") < names.index("UserService") < names.index("DemoApplication")
    assert G.root_service(G.order_by_depth(services, depth)).first().root_service == "DemoApplication"


def test_ordinal_against_row_number(spark):
    rnd = random.Random(11)
    rows = [(f"b{rnd.randint(0, 2)}", rnd.randint(0, 2), rnd.randint(1, 4), i * 7919 % 1000) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, sev long, cnt long, fen long")
    bucket = F.struct(F.col("sev"), (-F.col("cnt")).alias("c"), F.floor(F.col("fen") / 16).alias("e"))
    got = S.ordinal(df, ["k"], ["sev", F.col("cnt").desc(), "fen"], bucket, "o")
    w = Window.partitionBy("k").orderBy("sev", F.col("cnt").desc(), "fen")
    ref = df.withColumn("o", F.row_number().over(w) - 1)
    cols = ["k", "sev", "cnt", "fen", "o"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, ref.select(cols).collect()))


def test_match_dependencies_is_contains(spark):
    nodes = spark.createDataFrame([("b", n, i, 6) for i, n in enumerate(
        ["Redis", "UserService", "api", "s", "pool", "x-y"])], "bundle_id string, node string, position long, n_nodes long")
    texts = ["timeout calling redis from userservice", "nothing here", "HikariPool exhausted", "x-y and s3",
             "API gateway", ""]
    p = pats(spark, [(t, 1, 0.0, "INFO", 2) for t in texts])
    prio = C.dependency_priority(nodes)
    got = {r.pattern_key: r.dependency_score for r in C.match_dependencies(p, prio).collect()}
    assert got == {"k0": 5, "k1": 0, "k2": 2, "k3": 2, "k4": 3, "k5": 0}


def test_error_lookback_reaches_into_earlier_batches(spark):
    rows = [("s", "b0", 1, 0, "INFO"), ("s", "b0", 2, 500, "INFO"), ("s", "b0", 3, 590, "INFO"), ("s", "b1", 4, 610, "ERROR"),
            ("s", "b1", 5, 620, "ERROR"), ("s", "b1", 6, 100, "INFO"), ("s", "b2", 7, 630, "INFO"), ("s", "b3", 8, 5000, "INFO"),
            ("s", "b4", 9, 700, "ERROR"), ("t", "b1", 1, 605, "INFO")]
    df = spark.createDataFrame(rows, "source_id string, batch_id string, entry_no long, sec long, level string").withColumn(
        "ts", F.timestamp_seconds("sec"))
    got = C.error_lookback(df, lookback_seconds=300).collect()
    by = {}
    for r in got:
        by.setdefault(r.batch_id, []).append(r.entry_no)
    # no entry that arrived later, none of another source; a later time that arrived earlier stays
    assert {k: sorted(v) for k, v in by.items()} == {"b1": [2, 3, 4, 5], "b4": [2, 3, 4, 5, 7, 8, 9]}
    newest = C.error_lookback(df, lookback_seconds=300, max_entries=2).collect()
    assert sorted(r.entry_no for r in newest if r.batch_id == "b4") == [8, 9]
