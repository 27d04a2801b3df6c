"""Scalar expressions of §2.9, including the reference's quirks."""

from pyspark.sql import functions as F

from tracefold.functions import text as T
from tracefold.functions import time as TM


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_severity_a_quirks(spark):
    assert one(spark, T.severity_a, "[WARN] disk almost full") == "WARN"
    assert one(spark, T.severity_a, "switching to failover node") == "FAIL"        # substring scan
    assert one(spark, T.severity_a, "WARNING low memory") == "WARN"                 # WARN shadows WARNING
    assert one(spark, T.severity_a, "[main] ERROR boom") == "ERROR"                 # first bracket not a level
    assert one(spark, T.severity_a, "[main] [ERROR] boom") == "ERROR"               # only first [WORD] tested
    assert one(spark, T.severity_a, "all good") is None


def test_norm_a(spark):
    n = lambda s: one(spark, T.norm_a, s)
    assert n("2026-01-19 13:13:10.195  GET /x status 404 took 12 ms") == "GET /x status 404 took <NUM> ms"
    assert n("code 4045 and 500") == "code 4045 and 500"                          # kept prefixes
    assert n("connect 10.0.0.1:8080") == "connect <IP>:<PORT>"
    assert n("commit deadbeef1 done") == "commit <HEX> done"
    assert n("value 1234567") == "value <HEX>"                                     # 7+ digits match HEX first
    assert n("at Foo.bar(Foo.java:89)") == "at Foo.bar(Foo.java:<PORT>)"           # :PORT before NUM


def test_norm_b(spark):
    n = lambda s: one(spark, T.norm_b, s)
    assert n("paid: foo") == "paid=<ID>"                                           # id rule without \b
    assert n("user_id=12345 from 10.1.2.3") == "id=<ID> from <IP>"
    assert n("account 1000123 created") == "account <NUM> created"
    assert n("(Main.java:1234567)") == "(Main.java:1234567)"                       # guarded by ':' / ')'
    assert n("2024-01-01 10:00:00.123 x") == "<TS>.123 x"                          # fraction survives
    assert n("id 550e8400-e29b-41d4-a716-446655440000") == "id <UUID>"


def test_level_b(spark):
    assert one(spark, T.level_b, "java.sql.SQLException: boom") == "INFO"          # no word match
    assert one(spark, T.level_b, "2024-01-01 00:00:00 ERROR x") == "ERROR"
    assert one(spark, T.level_b, "2024-01-01 00:00:00 warn x") == "WARNING"


def test_timestamps(spark):
    ts = lambda s: one(spark, lambda c: F.date_format(TM.ts_a(c), "yyyy-MM-dd HH:mm:ss.SSSSSS"), s)
    assert ts("at 2026-01-19T07:43:10.201Z boom") == "2026-01-19 07:43:10.201000"
    assert ts("2026-01-19 13:13:10.1234567 x") == "2026-01-19 13:13:10.123456"     # >6 digits truncated
    assert ts('1.2.3.4 - - [19/Jan/2026:13:55:36 +0000] "GET /"') == "2026-01-19 13:55:36.000000"
    assert ts("2026-01-19 13:13:10 no fraction") is None                           # fraction mandatory
    tb = lambda s: one(spark, lambda c: F.date_format(TM.ts_b(c), "yyyy-MM-dd HH:mm:ss"), s)
    assert tb("2024-05-01T10:00:01.999 INFO x") == "2024-05-01 10:00:01"           # fraction dropped
    assert tb("[2024-05-01 10:00:01] INFO x") == "2024-05-01 10:00:01"
    assert tb("  2024-05-01 10:00:01 INFO x") is None                              # indented head: no ts
    assert one(spark, TM.is_head_b, "  2024-05-01 10:00:01 INFO x") is True


def test_severity_score_sets(spark):
    df = spark.createDataFrame([("Unhandled rejection", None), ("crash loop", "INFO"), ("fine", "WARNING")],
                               "p string, s string")
    got = df.select(T.severity_score(F.col("p"), F.col("s"), "correlator").alias("c"),
                    T.severity_score(F.col("p"), F.col("s"), "prompt").alias("p"),
                    T.severity_score(F.col("p"), F.col("s"), "summary").alias("s")).collect()
    assert [tuple(r) for r in got] == [(10, 80, 10), (80, 80, 10), (50, 50, 50)]


def test_clean_service(spark):
    assert one(spark, T.clean_service, "payment-service-7f4d9b-xkz2p") == "payment-service"
    assert one(spark, T.clean_service, "kafka-2") == "kafka"
