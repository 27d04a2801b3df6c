"""Ported reference examples and order-free determinism."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tracefold.operators import correlate as C
from tracefold.operators import parse as P
from tracefold.operators import patterns as A
from tracefold.plans.fixture import log_lines

CASCADE = [  # 5-service cascade: (ts, service, message, severity)
    ("2024-12-04 10:30:15.123", "auth-service",
     "NullPointerException: Cannot invoke 'User.getProfile()' because 'user' is null", "NullPointerException"),
    ("2024-12-04 10:30:17.456", "api-gateway", "Authentication service timeout after 5000ms", "TimeoutError"),
    ("2024-12-04 10:30:20.789", "frontend", "User authentication failed: Gateway timeout", "AuthenticationError"),
    ("2024-12-04 10:31:05.234", "payment-service", "Database connection pool exhausted",
     "ConnectionPoolExhaustedException"),
    ("2024-12-04 10:32:15.567", "order-service", "Out of memory error", "OutOfMemoryError"),
]
GRAPH = ["frontend", "api-gateway", "auth-service", "payment-service", "order-service"]


def test_cascade_primary_cluster_is_auth_service(spark):
    rows = [("b", f"k{i}", m, 1, dt.datetime.fromisoformat(t), s, i, 0) for i, (t, _, m, s) in enumerate(CASCADE)]
    pats = spark.createDataFrame(rows, "bundle_id string, pattern_key string, pattern string, count long, "
                                       "first_ts timestamp, error_class string, first_entry_no long, sev_rank int")
    nodes = spark.createDataFrame([("b", n, i, len(GRAPH)) for i, n in enumerate(GRAPH)],
                                  "bundle_id string, node string, position long, n_nodes long")
    scored = C.match_dependencies(pats, C.dependency_priority(nodes))
    cl = C.cluster_by_gap(scored, gap_seconds=2.0)
    assert cl.select("cluster_no").distinct().count() == 5          # every gap exceeds 2 s
    causes = C.rank_root_causes(cl)
    assert all(r.severity_score == 80 and r["rank"] == 1 for r in causes.collect())
    primary = C.rank_clusters(cl, causes).where(F.col("cluster_rank") == 1).first()
    first = cl.where(F.col("cluster_no") == primary.cluster_no).first()
    assert first.pattern.startswith("NullPointerException")         # stable order: the first cluster wins ties


def test_results_do_not_depend_on_partitioning(spark):
    lines = log_lines(spark, SF_SMALL)

    def flagship(df):
        e = P.fold_entries(df, bucket_width=64).withColumn(
            "bundle_id", F.concat("source_id", F.lit("/"), F.date_format("ts", "yyyy-MM-dd")))
        p = A.order_patterns_b(A.dedup_patterns_b(e))
        r = C.rank_root_causes(C.cluster_by_gap(p, gap_seconds=300))
        return sorted(map(tuple, r.select("bundle_id", "cluster_no", "rank", "pattern_key", "reason").collect()))

    base = flagship(lines.coalesce(1))
    assert base
    assert flagship(lines.repartition(7, F.rand(3))) == base
    assert flagship(lines.orderBy(F.desc("line_no")).repartition(3)) == base
