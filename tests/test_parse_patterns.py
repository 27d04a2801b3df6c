"""P1, P2, A1, A2, A2b, A4, W8, W10 on literal frames."""

from pyspark.sql import functions as F

from tracefold.operators import parse as P
from tracefold.operators import patterns as A

LINES_B = [
    "stray line before any head",
    "2024-05-01 10:00:00.100 INFO Request received POST /api/checkout",
    "2024-05-01 10:01:30.000 WARN HikariPool-1 - Connection pool approaching limit: 48/50 active",
    "2024-05-01 10:02:00.000 WARN HikariPool-1 - Connection pool approaching limit: 49/50 active",
    "2024-05-01 10:02:30.000 ERROR java.sql.SQLException: Cannot acquire connection from pool",
    "    at com.zaxxer.hikari.pool.HikariPool.getConnection(HikariPool.java:89)",
    "    at com.example.user.UserRepository.findById(UserRepository.java:45)",
    "Caused by: java.sql.SQLException: Pool exhausted (50/50 active)",
    "",
    "2024-05-01 10:02:31.000 ERROR Payment failed for user_id=12345",
]


def lines_df(spark, lines, source="s1"):
    rows = [(source, i + 1, t, "payment-service-7d4f8b-xkz2p") for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "source_id string, line_no long, line string, container string")


def test_fold_entries(spark):
    for width in (2, 3, 1 << 20):   # small widths exercise the cross-bucket carry
        e = P.fold_entries(lines_df(spark, LINES_B), bucket_width=width).orderBy("entry_no").collect()
        assert [r.entry_no for r in e] == [2, 3, 4, 5, 10]
        assert e[3].message.count("\n") == 3 and e[3].level == "ERROR"
        assert e[1].level == "WARNING" and str(e[1].ts) == "2024-05-01 10:01:30"


def test_dedup_patterns_b(spark):
    lines = LINES_B + ["2024-05-01 10:03:00.000 ERROR Payment failed for user_id=999",
                       "2024-05-01 10:02:59.000 ERROR Payment failed for user_id=7"]
    e = P.fold_entries(lines_df(spark, lines)).withColumn("bundle_id", F.lit("b"))
    p = A.order_patterns_b(A.dedup_patterns_b(e)).orderBy("pattern_ord").collect()
    assert [r.error_class for r in p] == ["ERROR", "ERROR", "WARNING", "WARNING", "INFO"]
    pay = p[0]
    assert pay["count"] == 3 and pay.pattern.endswith("user_id=12345")              # first message kept
    assert str(pay.last_ts) == "2024-05-01 10:02:59"                             # last ARRIVED, not max
    assert p[2]["count"] == 1 and p[3]["count"] == 1                                   # 48/50 and 49/50 differ


def test_parse_lines_and_aggregates(spark):
    raw = ["[INFO] 2026-01-19T07:43:10.201Z 2026-01-19 13:13:10.195 INFO 1 --- [main] c.b.App : Started",
           "[ERROR] 2026-01-19T07:43:11.201Z 2026-01-19 13:13:11.195 ERROR 1 --- [exec-1] c.b.C : GET /x 404",
           "[ERROR] 2026-01-19T07:43:12.201Z 2026-01-19 13:13:12.195 ERROR 1 --- [exec-2] c.b.C : GET /x 404",
           "    at com.beko.DemoBank.Controller.get(Controller.java:42)"]
    df = lines_df(spark, raw).withColumn("bundle_id", F.lit("b"))
    parsed = P.parse_lines(df)
    rows = parsed.orderBy("line_no").collect()
    assert [r.severity for r in rows] == ["INFO", "ERROR", "ERROR", None]
    assert rows[3].src_file == "Controller.java" and rows[3].src_line == 42
    pats = A.aggregate_patterns_a(parsed)
    assert pats.count() == 3                                                     # the two 404 lines collapse
    rate = A.error_rate(parsed).first()
    assert rate.error_count == 2 and abs(rate.error_rate_z - 5.0) < 1e-12
    assert A.derive_hint(pats).first().hint.startswith("HTTP 404")
    assert A.infer_service(parsed).first().service == "demobank"


def test_escalate(spark):
    e = spark.createDataFrame([("b", 1, None, "INFO", "disk x"), ("b", 2, None, "ERROR", "disk x")],
                              "bundle_id string, entry_no long, ts timestamp, level string, message string")
    e = e.withColumn("container", F.lit(None).cast("string"))
    assert A.dedup_patterns_b(e).first().error_class == "INFO"
    assert A.dedup_patterns_b(e, escalate=True).first().error_class == "ERROR"


def test_read_log_lines(spark, tmp_path):
    (tmp_path / "svc-a.log").write_text("2024-01-01 00:00:00 INFO a\n\n   \n    at x.Y.z(Y.java:1)\n2024-01-01 00:00:01 ERROR b\n")
    (tmp_path / "svc-b.log").write_text("2024-01-01 00:00:02 WARN c\r\nsecond\r\n")
    rows = P.read_log_lines(spark, str(tmp_path)).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r.source_id.rsplit("/", 1)[-1], []).append((r.line_no, r.line))
    assert sorted(by_file["svc-a.log"]) == [(1, "2024-01-01 00:00:00 INFO a"), (4, "    at x.Y.z(Y.java:1)"),
                                            (5, "2024-01-01 00:00:01 ERROR b")]
    assert sorted(by_file["svc-b.log"]) == [(1, "2024-01-01 00:00:02 WARN c"), (2, "second")]
