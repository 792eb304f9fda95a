"""Monitoring tables seen in the supplied tables: each view once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import at
from ..operators.ordered import OrderedRows
from ..session import table

NOW = "2024-01-31T00:00:00"
NOW_US = 1_706_659_200_000_000
START = "2024-01-01T00:00:00"
START_US = 1_704_067_200_000_000
HOUR_US = 3_600_000_000


def now() -> Column:
    return at(NOW)


def start() -> Column:
    return at(START)


def us(column: str = "ts") -> Column:
    return F.unix_micros(column)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _mod(n: int) -> Column:
    return F.col("user_id") % n


def _key(prefix: str, n: int) -> Column:
    return F.concat(F.lit(prefix), _mod(n).cast("string"))


E_SQL = """e AS (
  SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value,
         regexp_extract(props, '"k": (-?[0-9]+)', 1) AS k
  FROM events)"""


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.from_json("props", "map<string,string>")
    return events(spark, sf).select(
        F.date_trunc("hour", "ts").alias("ts"),
        F.lit("svc").alias("service"),
        _key("h", 7).alias("host"),
        _key("agent-", 12).alias("agent"),
        F.array("event_type", _key("u", 20)).alias("track"),
        tags.alias("tags"),
        F.floor("value").cast("bigint").cast("string").alias("value"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"),
        F.col("event_id").alias("arrival"),
    )


STATUS_SQL = E_SQL + f""", v_status AS (
  SELECT t - t % {HOUR_US} AS ts_us, 'svc' AS service, 'h' || (user_id % 7) AS host,
         'agent-' || (user_id % 12) AS agent, event_type || '/u' || (user_id % 20) AS path,
         event_type AS track_0, 'u' || (user_id % 20) AS track_1, k,
         CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value, 'm' || event_id AS message,
         event_id AS arrival
  FROM e)"""


def heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "ts",
        F.lit("svc").alias("service"),
        _key("h", 7).alias("host"),
        _key("agent-", 12).alias("agent"),
        F.col("event_id").alias("arrival"),
    )


def expected_agents(spark: SparkSession) -> DataFrame:
    return spark.range(10).select(F.concat(F.lit("agent-"), F.col("id").cast("string")).alias("agent"))


HB_SQL = E_SQL + """, v_hb AS (
  SELECT t, 'svc' AS service, 'h' || (user_id % 7) AS host, 'agent-' || (user_id % 12) AS agent,
         event_id AS arrival FROM e),
  v_expected AS (SELECT 'agent-' || i AS agent FROM range(10) r(i))"""


def checks(spark: SparkSession, sf: str) -> DataFrame:
    failed_fetch = (F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)
    return events(spark, sf).select(
        _key("g", 4).alias("group"),
        F.col("user_id").cast("string").alias("name"),
        "ts",
        "event_id",
        (F.col("event_type") != "error").alias("ok"),
        F.when(~failed_fetch, F.when(F.col("event_type") == "error", 500).otherwise(200)).alias(
            "status_code"
        ),
        F.when(~failed_fetch, F.concat(F.lit("b"), F.col("event_id").cast("string"))).alias("body"),
        F.when(failed_fetch, "GlobalRequestTimeoutException").alias("error"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
        (1 + _mod(3)).cast("int").alias("fail_count"),
        (1 + _mod(2)).cast("int").alias("resolve_count"),
    )


CHECK_SQL = E_SQL + """, v_check AS (
  SELECT 'g' || (user_id % 4) AS grp, CAST(user_id AS VARCHAR) AS name, t, event_id,
         event_type <> 'error' AS ok,
         CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL
              WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
         CASE WHEN NOT (event_type = 'error' AND event_id % 2 = 0)
              THEN 'b' || event_id END AS body,
         CASE WHEN event_type = 'error' AND event_id % 2 = 0
              THEN 'GlobalRequestTimeoutException' END AS error,
         CAST(floor(value * 10) AS BIGINT) AS latency_ms,
         1 + user_id % 3 AS fail_count, 1 + user_id % 2 AS resolve_count
  FROM e)"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    """A message log: offsets 3, 4, ... per topic and partition in time order. In every
    thousandth message both header fields are missing."""
    rows = events(spark, sf).select(
        F.col("event_type").alias("topic"),
        _mod(8).cast("int").alias("partition"),
        "ts",
        "event_id",
    )
    field = F.when(F.col("event_id") % 2 == 0, "received").otherwise("t")
    millis = F.unix_millis("ts").cast("string")
    header = F.concat(F.lit('{"'), field, F.lit('": '), millis, F.lit("}"))
    numbered = OrderedRows(rows, ["topic", "partition"], ["ts", "event_id"]).running(
        _n=F.lit(1).cast("long")
    )
    return numbered.df.select(
        "topic", "partition", "ts", (F.col("_n") + 2).alias("offset"), header.alias("header")
    )


LOG_SQL = E_SQL + """, v_log AS (
  SELECT event_type AS topic, CAST(user_id % 8 AS INTEGER) AS part, t,
         2 + row_number() OVER (PARTITION BY event_type, user_id % 8 ORDER BY t, event_id) AS off
  FROM e),
  v_broker AS (
  SELECT topic, part, min(off) AS earliest, max(off) + 1 AS latest FROM v_log GROUP BY 1, 2),
  v_consumer AS (
  SELECT 'env' || (part % 2) AS env, 'cg' AS grp, topic, part, earliest, latest,
         CASE part WHEN 0 THEN 1 WHEN 1 THEN latest + 10
              ELSE CAST(floor(latest * 0.8) AS BIGINT) END AS off
  FROM v_broker WHERE part <> 7)"""


def consumer(brokers: DataFrame) -> DataFrame:
    offset = (
        F.when(F.col("partition") == 0, F.lit(1).cast("long"))
        .when(F.col("partition") == 1, F.col("latest") + 10)
        .otherwise(F.floor(F.col("latest") * 0.8))
    )
    env = F.concat(F.lit("env"), (F.col("partition") % 2).cast("string"))
    return brokers.filter(F.col("partition") != 7).select(
        env.alias("env"), F.lit("cg").alias("consumer_group"), "topic", "partition", offset.alias("offset")
    )


SEVERITY = (
    ("click", "anomaly"),
    ("error", "service-failure"),
    ("purchase", "component-failure"),
    ("signup", "warn"),
    ("view", "default"),
)


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    severity = F.lit(None).cast("string")
    for kind, name in SEVERITY:
        severity = F.when(F.col("event_type") == kind, name.upper().replace("-", "_")).otherwise(severity)
    return events(spark, sf).select(
        "ts",
        _key("svc", 5).alias("service"),
        _key("h", 7).alias("host"),
        severity.alias("severity"),
        F.concat(F.col("event_type"), F.lit(" "), _mod(10).cast("string")).alias("description"),
        F.from_json("props", "map<string,string>").alias("data"),
        F.col("event_id").alias("arrival"),
    )


ALERT_SQL = E_SQL + """, v_alert AS (
  SELECT t, 'svc' || (user_id % 5) AS service, 'h' || (user_id % 7) AS host,
         CASE event_type WHEN 'click' THEN 'ANOMALY' WHEN 'error' THEN 'SERVICE_FAILURE'
              WHEN 'purchase' THEN 'COMPONENT_FAILURE' WHEN 'signup' THEN 'WARN'
              WHEN 'view' THEN 'DEFAULT' END AS severity,
         event_type || ' ' || (user_id % 10) AS description, k, event_id AS arrival
  FROM e)"""


def changes(spark: SparkSession, sf: str) -> DataFrame:
    signup = F.col("event_type") == "signup"
    removed = (F.col("event_type") == "purchase") & (F.col("value") > 200)
    none = F.array().cast("array<int>")
    ids = (
        F.when(signup, F.array(F.lit(0), F.lit(1), F.lit(2)))
        .when(removed | (F.col("value") < 20), none)
        .when(F.col("value") < 60, F.array(F.lit(0), F.lit(1)))
        .otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    )
    kind = F.when(signup, "assigned").when(removed, "removed").otherwise("isr")
    return events(spark, sf).select(
        _key("topic", 6).alias("topic"),
        (F.floor(F.col("user_id") / 6) % 8).cast("int").alias("partition"),
        F.col("event_id").alias("seq"),
        "ts",
        kind.alias("kind"),
        ids.alias("ids"),
    )


CHANGE_SQL = E_SQL + """, v_changes AS (
  SELECT 'topic' || (user_id % 6) AS topic, CAST((user_id // 6) % 8 AS INTEGER) AS part,
         event_id AS seq, t,
         CASE WHEN event_type = 'signup' THEN 'assigned'
              WHEN event_type = 'purchase' AND value > 200 THEN 'removed' ELSE 'isr' END AS kind,
         CASE WHEN event_type = 'signup' THEN 3
              WHEN (event_type = 'purchase' AND value > 200) OR value < 20 THEN 0
              WHEN value < 60 THEN 2 ELSE 3 END AS n
  FROM e),
  c1 AS (
  SELECT *, kind <> 'removed' AS present,
    coalesce(last_value(CASE WHEN kind = 'assigned' THEN n WHEN kind = 'removed' THEN 0 END
      IGNORE NULLS) OVER w, 0) AS assigned,
    coalesce(last_value(CASE WHEN kind = 'isr' THEN n WHEN kind = 'removed' THEN 0 END
      IGNORE NULLS) OVER w, 0) AS isr
  FROM v_changes
  WINDOW w AS (PARTITION BY topic, part ORDER BY t, seq
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  c2 AS (SELECT *, present AND isr = 0 AS off, present AND assigned > isr AS ur FROM c1),
  c3 AS (
  SELECT *, CASE WHEN lag(off) OVER w IS DISTINCT FROM off THEN t END AS off_start,
            CASE WHEN lag(ur) OVER w IS DISTINCT FROM ur THEN t END AS ur_start
  FROM c2 WINDOW w AS (PARTITION BY topic, part ORDER BY t, seq)),
  c4 AS (
  SELECT *, CASE WHEN off THEN last_value(off_start IGNORE NULLS) OVER w END AS off_since,
            CASE WHEN ur THEN last_value(ur_start IGNORE NULLS) OVER w END AS ur_since
  FROM c3
  WINDOW w AS (PARTITION BY topic, part ORDER BY t, seq
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  v_state AS (
  SELECT * FROM c4 QUALIFY row_number() OVER (PARTITION BY topic, part ORDER BY t DESC, seq DESC) = 1),
  v_present AS (SELECT * FROM v_state WHERE present)"""


def work_items(spark: SparkSession, sf: str) -> DataFrame:
    """One interval per order line, grouped to one work item per order."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    interval = F.struct(
        F.col("o_orderdate").cast("timestamp").alias("start"),
        F.col("l_shipdate").cast("timestamp").alias("end"),
    )
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "inner").select(
        F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("pipe_id"),
        F.col("o_orderkey").cast("string").alias("item_id"),
        F.array(interval).alias("intervals"),
    )


WORK_SQL = """v_work AS (
  SELECT 'p' || (o_custkey % 50) AS pipe_id, epoch_us(o_orderdate) AS start_us
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON snapshot per order line; whole numbers are written as integers."""
    number = "%s"
    doc = F.format_string(
        f'{{"quantity": {number}, "price": {number}, "discount": {number}, "line": {number}}}',
        F.col("l_quantity").cast("string"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        F.col("l_discount").cast("string"),
        F.col("l_linenumber").cast("string"),
    )
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("n"), (F.col("l_orderkey") % 100).cast("string")).alias("host"), doc.alias("doc")
    )


SNAPSHOT_SQL = """v_snapshot AS (
  SELECT 'n' || (l_orderkey % 100) AS host, 'quantity' AS metric, l_quantity AS value, true AS dbl
  FROM lineitem UNION ALL
  SELECT 'n' || (l_orderkey % 100), 'price', l_extendedprice, true FROM lineitem UNION ALL
  SELECT 'n' || (l_orderkey % 100), 'discount', l_discount, true FROM lineitem UNION ALL
  SELECT 'n' || (l_orderkey % 100), 'line', l_linenumber, false FROM lineitem)"""
