"""The derived log fixture: service log lines generated from the ``events`` table.

One SQL text is run unchanged by Spark (over the events DataFrame) and by the
DuckDB oracle (over the ``events`` view), so both engines see identical lines.
Output ``(source_id, line_no, line, container)``; line_no order is time order
within a source.  Error events have three continuation lines each (the 3-row ``k``
literal): stack frames of one of six languages or chains of causes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.session import table

LOG_LINES_SQL = """
WITH base AS (
  SELECT event_id, ts, user_id, event_type, value,
    CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'auth-service' WHEN 1 THEN 'payment-service'
      WHEN 2 THEN 'order-service' WHEN 3 THEN 'api-gateway' ELSE 'frontend-web' END AS service,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS lvl,
    substr(CAST(ts AS STRING), 1, 19) AS ts_txt
  FROM {events}),
lines AS (
  SELECT event_id * 4 AS line_no, service, event_id, concat(ts_txt, ' ', lvl, ' ',
    CASE event_type
      WHEN 'error' THEN CASE CAST(event_id % 7 AS INT)
        WHEN 2 THEN concat('TimeoutError: payment_service gave no answer to request_id=', CAST(event_id AS STRING))
        WHEN 3 THEN concat('UnhandledRejection: worker ', CAST(user_id % 8 AS STRING), ' out of memory')
        WHEN 4 THEN concat('panic: runtime error: index out of range, session_id=', CAST(user_id AS STRING))
        WHEN 5 THEN concat('NoMethodError: route to order_id=', CAST(event_id AS STRING), ' not found')
        WHEN 6 THEN concat('System.NullReferenceException: no order, id=', CAST(user_id AS STRING))
        ELSE concat('java.sql.SQLException: Cannot acquire connection for user_id=', CAST(user_id AS STRING),
          ' from 10.0.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 256 AS STRING)) END
      WHEN 'purchase' THEN concat('HikariPool-1 - Connection pool approaching limit: ', CAST(40 + event_id % 3 AS STRING), '/50 active')
      WHEN 'signup' THEN concat('[UserController] created account ', CAST(1000000 + event_id AS STRING))
      ELSE concat('Request received GET /api/', event_type, ' status ', CASE WHEN event_id % 7 = 0 THEN '404' ELSE '200' END) END) AS line
  FROM base
  UNION ALL
  SELECT event_id * 4 + k, service, event_id, CASE CAST((event_id % 7) * 4 + k AS INT)
    WHEN 5 THEN concat('    at com.example.app.', CASE WHEN user_id % 2 = 0 THEN 'UserRepository' ELSE 'PaymentService' END,
      '.load(Main.java:', CAST(60 + event_id % 2 AS STRING), ')')
    WHEN 6 THEN 'Caused by: com.example.pool.PoolExhaustedException: no connection left'
    WHEN 7 THEN CASE WHEN user_id % 2 = 0 THEN 'Caused by: java.net.SocketTimeoutException: read timed out'
      ELSE 'Caused by: java.io.BrokenPipeError: reset' END
    WHEN 9 THEN '  File "/app/services/order_handler.py", line 42, in process'
    WHEN 10 THEN '  File "/usr/lib/python3/site-packages/requests/api.py", line 59, in get'
    WHEN 11 THEN concat('  File "/app/clients/', CASE WHEN user_id % 2 = 0 THEN 'payment_client' ELSE 'stock_client' END, '.py", line 7, in call')
    WHEN 13 THEN '    at OrderController.create (/app/src/controllers/orderController.js:12:5)'
    WHEN 14 THEN '    at /app/node_modules/express/lib/router.js:47:12'
    WHEN 15 THEN '    at /app/src/workers/queueWorker.ts:88:3'
    WHEN 17 THEN 'goroutine 1 [running]:'
    WHEN 18 THEN '    /app/stock/inventory.go:88 +0x1d'
    WHEN 19 THEN '    /usr/local/go/src/runtime/panic.go:884 +0x212'
    WHEN 21 THEN concat('    from app/models/order.rb:15:in `total', chr(39))
    WHEN 22 THEN concat('    from /gems/rack/lib/rack.rb:3:in `call', chr(39))
    WHEN 23 THEN concat('    from lib/jobs/checkout_job.rb:8:in `run', chr(39))
    WHEN 25 THEN '   at Shop.Orders.OrderService.Load(Int32 id)'
    WHEN 26 THEN '   at System.Linq.Enumerable.First()'
    WHEN 27 THEN '   at Shop.Web.CheckoutController.Post()'
    ELSE CASE k WHEN 1 THEN '    at com.zaxxer.hikari.pool.HikariPool.getConnection(HikariPool.java:89)'
      WHEN 2 THEN concat('    at com.example.app.', CASE WHEN user_id % 2 = 0 THEN 'UserRepository' ELSE 'PaymentService' END,
        '.process(Main.java:', CAST(40 + event_id % 2 AS STRING), ')')
      ELSE 'Caused by: java.sql.SQLTimeoutException: Pool exhausted' END END
  FROM (SELECT *, @each_of_123 AS k FROM base WHERE event_type = 'error') s)
SELECT service AS source_id, line_no, line, concat(service, '-7d4f8b-xkz2p') AS container FROM lines
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source_id, line_no, line, container)`` derived from ``events``."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return spark.sql(LOG_LINES_SQL.replace("@each_of_123", "explode(array(1, 2, 3))"), events=events)


def log_lines_cte() -> str:
    """The same SQL as a DuckDB CTE named ``log_lines``."""
    body = LOG_LINES_SQL.replace("@each_of_123", "unnest([1, 2, 3])").strip()
    assert body.startswith("WITH ")
    head, _, select = body.rpartition("\nSELECT service AS source_id")
    ctes = head[len("WITH "):].replace("{events}", "events")
    return (ctes + ",\nlog_lines AS (\nSELECT service AS source_id" + select + ")")


# Incident events (K8s-style): every row of ``events`` becomes a Warning (errors) or
# Normal event of the same service; the reason's wording follows the event type.
INCIDENT_EVENTS_SQL = """
WITH ebase AS (
  SELECT event_id, ts, user_id, event_type,
    CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'auth-service' WHEN 1 THEN 'payment-service'
      WHEN 2 THEN 'order-service' WHEN 3 THEN 'api-gateway' ELSE 'frontend-web' END AS service,
    CASE CAST((user_id + 1) % 5 AS INT) WHEN 0 THEN 'auth-service' WHEN 1 THEN 'payment-service'
      WHEN 2 THEN 'order-service' WHEN 3 THEN 'api-gateway' ELSE 'frontend-web' END AS peer
  FROM {events})
SELECT concat('evt_', CAST(event_id AS STRING)) AS id,
  CASE event_type WHEN 'error' THEN 'Warning' ELSE 'Normal' END AS type,
  CASE event_type WHEN 'error' THEN concat('BackOff: calling ', peer, ' failed with ConnectionTimeout')
    WHEN 'purchase' THEN concat('Unhealthy: readiness probe of [', peer, '] slow')
    WHEN 'signup' THEN concat('Scaled: connecting to session_store for ', peer)
    WHEN 'view' THEN 'Pulled' ELSE concat('Started: request to ', peer, CASE WHEN event_id % 2 = 0 THEN ' by GatewayRouter' ELSE '' END)
    END AS reason,
  concat(service, '-5c9d7f-q', CAST(user_id % 10 AS STRING)) AS pod,
  service, ts
FROM ebase
"""


def incident_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, type, reason, pod, service, ts)`` derived from ``events``."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return spark.sql(INCIDENT_EVENTS_SQL, events=events)


def incident_events_cte() -> str:
    body = INCIDENT_EVENTS_SQL.strip()
    head, _, select = body.rpartition("\nSELECT concat('evt_'")
    ctes = head[len("WITH "):].replace("{events}", "events")
    return ctes + ",\nincident_events AS (\nSELECT concat('evt_'" + select + ")"
