"""Queries over pipelines, snapshots, documents, mail feeds, digests and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.times import at, period_millis_column, shift
from ..operators import configs, digest, incidents, mail_feed, pipes, snapshots
from ..operators import events as ev
from ..session import table
from ..sources import documents
from . import views
from .ordered_queries import greedy_sql
from .registry import query
from .views import ALERT_SQL, E_SQL, HOUR_US, NOW_US, SNAPSHOT_SQL, WORK_SQL, us

# ---- pipelines -------------------------------------------------------------------------------

_CHANNEL_SQL = (
    "ch AS (SELECT DISTINCT 'p' || (o_custkey % 53) AS pipe_id, CASE WHEN o_custkey % 53 % 2 = 1 THEN 'fast' END AS channel, "
    "CASE WHEN o_custkey % 53 % 5 = 0 THEN (o_custkey % 53 % 3) * 86400000 END AS period_ms FROM orders)"
)
_CLOCK = "1999-06-01T00:00:00"
_CLOCK_US = 928_195_200_000_000


def _channels(spark, sf) -> DataFrame:
    number = F.col("o_custkey") % 53
    return table(spark, sf, "orders").select(
        F.concat(F.lit("p"), number.cast("string")).alias("pipe_id"),
        F.when(number % 2 == 1, "fast").alias("channel"),
        F.when(number % 5 == 0, (number % 3) * 86_400_000).alias("specific_ms"),
    ).distinct()


def _backlog(spark, sf) -> DataFrame:
    channels = _channels(spark, sf)
    work = pipes.min_work_time(views.work_items(spark, sf), ["pipe_id"])
    periods = channels.select("pipe_id", F.col("specific_ms").alias("period_ms"))
    out = pipes.pipe_backlog(channels.drop("specific_ms"), work, periods, at(_CLOCK), ["pipe_id"])
    return out.withColumns({"env": F.lit("main"), "control": F.lit("ctl")})


_BACKLOG_SQL = f"""{WORK_SQL}, {_CHANNEL_SQL}, mw AS (SELECT pipe_id, min(start_us) AS m FROM v_work GROUP BY 1),
  b AS (SELECT ch.pipe_id, channel, m, coalesce(period_ms, CASE WHEN channel IS NULL THEN 345600000 ELSE 0 END) AS period_ms,
    greatest(0, {_CLOCK_US} // 1000 - coalesce(m, {_CLOCK_US}) // 1000) // 1000 AS lag_seconds
  FROM ch LEFT JOIN mw USING (pipe_id))"""


@query("pipe_min_time", f"WITH {WORK_SQL} SELECT pipe_id, min(start_us) AS min_time_us FROM v_work GROUP BY 1")
def pipe_min_time(spark, sf):
    out = pipes.min_work_time(views.work_items(spark, sf), ["pipe_id"])
    return out.select("pipe_id", us("min_time").alias("min_time_us"))


@query("pipe_backlog", f"WITH {_BACKLOG_SQL} SELECT pipe_id, channel, period_ms, lag_seconds FROM b")
def pipe_backlog(spark, sf):
    return _backlog(spark, sf).select("pipe_id", "channel", "period_ms", "lag_seconds")


@query(
    "backlog_metrics",
    f"WITH {_BACKLOG_SQL} SELECT 'pipe/backlog' AS metric, 'ctl' AS control, pipe_id, coalesce(channel, 'null') AS channel, "
    "CAST(lag_seconds AS DOUBLE) AS value FROM b",
)
def backlog_metrics(spark, sf):
    out = pipes.backlog_metrics(_backlog(spark, sf))
    return out.select(
        "metric",
        F.col("dims.pipesBacklogControl")[0].alias("control"),
        F.col("dims.pipesBacklogPipeId")[0].alias("pipe_id"),
        F.col("dims.pipesBacklogChannel")[0].alias("channel"),
        "value",
    )


_LATE_SQL = E_SQL + """, q AS (
  SELECT user_id, t, event_id, (user_id % 3) * 1800000 AS p,
    t - CAST(floor(value) AS BIGINT) * 60000000 AS m FROM e),
  st AS (SELECT *, CASE WHEN p <> 0 AND m < t - p * 1000 THEN true WHEN m >= t - p * 1000 THEN false END AS late FROM q),
  st1 AS (SELECT * FROM st WHERE late IS NOT NULL),
  st2 AS (SELECT *, lag(late) OVER w AS was, sum(CASE WHEN late THEN 0 ELSE 1 END) OVER w AS spell
          FROM st1 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
  r AS (SELECT user_id || '/' || CAST(spell AS BIGINT) AS k, t FROM st2 WHERE late)"""


@query(
    "backlog_pager",
    f"WITH RECURSIVE {_LATE_SQL}, {greedy_sql('r', str(2 * HOUR_US))} "
    "SELECT CAST(split_part(k, '/', 1) AS BIGINT) AS user_id, t AS ts_us, 'trigger' AS action FROM fired UNION ALL "
    "SELECT user_id, t, 'resolve' FROM st2 WHERE NOT late AND was",
)
def backlog_pager(spark, sf):
    rows = views.events(spark, sf).select(
        "user_id",
        "ts",
        "event_id",
        ((F.col("user_id") % 3) * 1_800_000).alias("period_ms"),
        shift("ts", -F.floor("value") * 60_000).alias("min_time"),
        F.lit("pk").alias("pager_key"),
    )
    out = incidents.backlog_pager(rows, ["user_id"], ["ts", "event_id"], 2 * HOUR_US)
    return out.select("user_id", us().alias("ts_us"), "action")


_FAILED_SQL = E_SQL + f""", pr AS (SELECT DISTINCT event_type AS env, t - t % {HOUR_US} AS t FROM e),
  pn AS (SELECT env, t, row_number() OVER (PARTITION BY env ORDER BY t) AS seq FROM pr),
  f0 AS (SELECT DISTINCT event_type AS env, 'job' || (user_id % 4) AS job, t - t % {HOUR_US} AS t, (user_id % 4) * {HOUR_US} AS gap
         FROM e WHERE value > 20),
  f1 AS (SELECT f0.*, seq, lag(seq) OVER (PARTITION BY env, job ORDER BY seq) AS pseq FROM f0 JOIN pn USING (env, t)),
  f2 AS (SELECT *, max(CASE WHEN pseq IS NULL OR pseq <> seq - 1 THEN seq END)
           OVER (PARTITION BY env, job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spell FROM f1),
  f3 AS (SELECT env || '/' || job || '/' || spell AS k, t, gap FROM f2 WHERE seq > spell AND gap > 0),
  fn AS MATERIALIZED (SELECT a.k, a.t, (SELECT min(b.t) FROM f3 b WHERE b.k = a.k AND b.t > a.t + a.gap) AS nt FROM f3 a),
  fired AS (SELECT k, min(t) AS t FROM f3 GROUP BY k UNION ALL
            SELECT n.k, n.nt FROM fired f JOIN fn n ON n.k = f.k AND n.t = f.t WHERE n.nt IS NOT NULL),
  ends AS (SELECT env, job, spell, max(seq) + 1 AS seq FROM f2 WHERE gap > 0 GROUP BY 1, 2, 3 HAVING count(*) > 1)"""


@query(
    "failed_job_pager",
    f"WITH RECURSIVE {_FAILED_SQL} SELECT 'pipes/failed/' || split_part(k, '/', 1) || '/' || split_part(k, '/', 2) AS incident_key, "
    "t AS ts_us, 'trigger' AS action FROM fired UNION ALL "
    "SELECT 'pipes/failed/' || env || '/' || job, t, 'resolve' FROM ends JOIN pn USING (env, seq)",
)
def failed_job_pager(spark, sf):
    """Hourly probes per environment; a job fails in an hour with a value above 20."""
    rows = views.events(spark, sf).select(
        F.col("event_type").alias("env"),
        F.date_trunc("hour", "ts").alias("ts"),
        F.concat(F.lit("job"), (F.col("user_id") % 4).cast("string")).alias("job"),
        ((F.col("user_id") % 4) * 3_600_000).alias("throttle_ms"),
        "value",
    )
    failed = rows.filter(F.col("value") > 20).select(
        "env", "job", "ts", "throttle_ms", F.lit("pk").alias("pager_key")
    )
    out = incidents.failed_job_pager(rows.select("env", "ts"), failed.distinct())
    return out.select("incident_key", us().alias("ts_us"), "action")


def _work_documents(spark, sf) -> DataFrame:
    """One work list per order with three pairs; two have the same id and the later one counts.
    The job of every third order has failed, half of them with a log."""
    key = F.col("o_orderkey")
    name = F.concat(
        F.lit("job"), (key % 10).cast("string"), F.when(key % 3 == 0, ".failed").otherwise("")
    )
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    log = F.when(key % 2 == 0, F.format_string(', "more": {"log": "l%d"}', key)).otherwise("")
    doc = F.format_string(
        '[["%s", {"pipeId": "old"}], ["x%d", {}], ["%s", {"pipeId": "p%d", "intervals": ["%s/%s"]%s}]]',
        name, key % 5, name, key % 7, day, day, log,
    )
    return table(spark, sf, "orders").select(key.alias("env"), doc.alias("doc"))


_ITEM_SQL = """it AS (
  SELECT o_orderkey AS env, 'job' || (o_orderkey % 10) || CASE WHEN o_orderkey % 3 = 0 THEN '.failed' ELSE '' END AS item_id,
    'p' || (o_orderkey % 7) AS pipe_id, epoch_us(o_orderdate) AS start_us,
    CASE WHEN o_orderkey % 2 = 0 THEN 'l' || o_orderkey END AS log
  FROM orders UNION ALL SELECT o_orderkey, 'x' || (o_orderkey % 5), NULL, NULL, NULL FROM orders)"""


@query("work_items", f"WITH {_ITEM_SQL} SELECT env, item_id, pipe_id, start_us, log FROM it")
def work_items(spark, sf):
    items = documents.work_items(_work_documents(spark, sf))
    start = F.unix_micros(F.col("intervals")[0]["start"])
    return items.select("env", "item_id", "pipe_id", start.alias("start_us"), "log")


@query(
    "failed_jobs",
    f"WITH {_ITEM_SQL} SELECT env, replace(item_id, '.failed', '') AS job, coalesce(log, 'No log found for the job') AS log, "
    "CAST(CASE WHEN item_id <> 'job3.failed' THEN 21600000 WHEN env % 4 = 1 THEN 0 ELSE 3600000 END AS BIGINT) AS throttle_ms "
    "FROM it WHERE item_id LIKE '%.failed%'",
)
def failed_jobs(spark, sf):
    failed = pipes.failed_jobs(documents.work_items(_work_documents(spark, sf)))
    specific = table(spark, sf, "orders").filter(F.col("o_orderkey") % 10 == 3).select(
        F.col("o_orderkey").alias("env"),
        F.lit("job3").alias("job"),
        F.when(F.col("o_orderkey") % 4 == 1, 0).otherwise(3_600_000).cast("long").alias("throttle_ms"),
    )
    return pipes.with_throttles(failed, specific).select("env", "job", "log", "throttle_ms")


@query(
    "resolved_jobs",
    f"WITH {_ITEM_SQL}, f AS (SELECT DISTINCT env, replace(item_id, '.failed', '') AS job FROM it WHERE item_id LIKE '%.failed'), "
    "tr AS (SELECT o_orderkey AS env, 'job' || (o_orderkey % 10) AS job FROM orders WHERE o_totalprice > 100000) "
    "SELECT env, job FROM tr EXCEPT SELECT env, job FROM f",
)
def resolved_jobs(spark, sf):
    failed = pipes.failed_jobs(documents.work_items(_work_documents(spark, sf))).select("env", "job")
    before = table(spark, sf, "orders").filter(F.col("o_totalprice") > 100_000).select(
        F.col("o_orderkey").alias("env"),
        F.concat(F.lit("job"), (F.col("o_orderkey") % 10).cast("string")).alias("job"),
    )
    return pipes.resolved_jobs(before, failed)


@query(
    "pipe_channels",
    "SELECT s_nationkey AS env, 'p' || s_suppkey AS pipe_id, CASE WHEN s_suppkey % 2 = 0 THEN 'c' || (s_suppkey % 5) END AS channel FROM supplier",
)
def pipe_channels(spark, sf):
    pipe = F.when(
        F.col("s_suppkey") % 2 == 0,
        F.format_string('{"id": "p%d", "channel": "c%d"}', F.col("s_suppkey"), F.col("s_suppkey") % 5),
    ).otherwise(F.format_string('{"id": "p%d"}', F.col("s_suppkey")))
    doc = F.concat(F.lit('{"x": {"pipes": ['), pipe, F.lit("]}}"))
    docs = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("env"), doc.alias("doc"))
    return pipes.pipe_channels(documents.pipelines(docs))


@query(
    "complete_environments",
    "WITH w AS (SELECT o_orderkey AS env FROM orders), p AS (SELECT CAST(s_nationkey AS BIGINT) AS env, s_suppkey FROM supplier) "
    "SELECT env, 'p' || s_suppkey AS pipe_id FROM p SEMI JOIN w USING (env)",
)
def complete_environments(spark, sf):
    """Pipes of the environments with a work list."""
    listed = table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("long").alias("env"),
        F.format_string('{"x": {"pipes": [{"id": "p%d"}]}}', F.col("s_suppkey")).alias("doc"),
    )
    both = pipes.complete_environments(_work_documents(spark, sf), listed)
    rows = both.select("env", F.col("pipelines_doc").alias("doc"))
    return pipes.pipe_channels(documents.pipelines(rows)).select("env", "pipe_id")


# ---- snapshots -------------------------------------------------------------------------------


def _metric_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("host", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "snapshot_metrics",
    f"WITH {SNAPSHOT_SQL} SELECT host, metric, count(*) AS n, round(sum(value), 4) AS total FROM v_snapshot GROUP BY 1, 2",
)
def snapshot_metrics(spark, sf):
    return _metric_totals(snapshots.unpivot_snapshot(views.snapshots(spark, sf)))


@query(
    "snapshot_non_zero",
    f"WITH {SNAPSHOT_SQL} SELECT host, metric, count(*) AS n, round(sum(value), 4) AS total FROM v_snapshot "
    "WHERE dbl AND abs(value) > 1e-6 GROUP BY 1, 2",
)
def snapshot_non_zero(spark, sf):
    return _metric_totals(snapshots.unpivot_snapshot(views.snapshots(spark, sf), only_non_zero=True))


def _statistics(label: str):
    def run(spark, sf):
        line = table(spark, sf, "lineitem")
        pid = F.when(F.col("l_linenumber") != 3, F.lit('"executor_pid": 77')).otherwise("")
        doc = F.format_string(
            '[{"executor_id": "e%d", "container_id": "c%d", "framework_id": "f", "source": "s%d", '
            '"statistics": {"cpus": %s, "mem": %s, "timestamp": 1.5}, "status": {%s}}]',
            F.col("l_partkey") % 20,
            F.col("l_partkey") % 20,
            F.col("l_suppkey") % 5,
            F.col("l_quantity").cast("string"),
            F.col("l_tax").cast("string"),
            pid,
        )
        docs = line.select((F.col("l_orderkey") % 10).alias("node"), doc.alias("doc"))
        out = snapshots.unpivot_statistics(docs, label)
        last = "executor_pid" if label == "container" else "executor_source"
        return out.groupBy(
            "node",
            "metric",
            F.col("dims.executor_id")[0].alias("executor_id"),
            F.col("dims")[last][0].alias("last_dim"),
        ).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))

    return run


def _statistics_sql(label: str, last: str) -> str:
    one = (
        "SELECT l_orderkey % 10 AS node, 'mesos/{0}/{1}' AS metric, 'e' || (l_partkey % 20) AS executor_id, "
        + last
        + " AS last_dim, {2} AS v FROM lineitem"
    )
    return (
        "SELECT node, metric, executor_id, last_dim, count(*) AS n, round(sum(v), 4) AS total FROM ("
        + one.format(label, "cpus", "l_quantity")
        + " UNION ALL "
        + one.format(label, "mem", "l_tax")
        + ") u GROUP BY 1, 2, 3, 4"
    )


query("executor_metrics", _statistics_sql("executor", "'s' || (l_suppkey % 5)"))(_statistics("executor"))
query("container_metrics", _statistics_sql("container", "CASE WHEN l_linenumber = 3 THEN '-1' ELSE '77' END"))(
    _statistics("container")
)


@query(
    "slaves_distinct",
    "SELECT DISTINCT 'env' || (l_suppkey % 4) AS env, 'id' || l_suppkey AS id, '10.0.0.' || (l_suppkey % 250) AS host, "
    "CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE 5051 END AS port, l_suppkey % 9 = 0 AS odd FROM lineitem",
)
def slaves_distinct(spark, sf):
    """Agents reported once per order line; every ninth has a pid without address."""
    key = F.col("l_suppkey")
    pid = F.when(key % 9 == 0, "slave(1)").otherwise(F.format_string("slave(1)@10.0.0.%d:5051", key % 250))
    doc = F.format_string('{"slaves": [{"id": "id%d", "pid": "%s", "version": "0.28.1", "active": true}]}', key, pid)
    docs = table(spark, sf, "lineitem").select(
        F.concat(F.lit("env"), (key % 4).cast("string")).alias("env"), key, doc.alias("doc")
    )
    found = snapshots.distinct_slaves(snapshots.slaves(docs))
    address = F.coalesce("host", F.concat(F.lit("10.0.0."), (F.substring("id", 3, 10).cast("int") % 250).cast("string")))
    return found.select("env", "id", address.alias("host"), "port", F.col("error").isNotNull().alias("odd"))


_RESPONSE_SQL = E_SQL + """, rs AS (
  SELECT event_id, 'h' || (user_id % 7) || ':5050' AS host, CASE event_type WHEN 'click' THEN 307 WHEN 'error' THEN 500 ELSE 200 END AS status,
    event_id % 10 = 1 AS timed_out, event_id % 10 = 2 AS fetch_failed, event_id % 10 <> 3 AS parsed FROM e)"""


def _responses(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    return views.events(spark, sf).select(
        "event_id",
        F.format_string("h%d:5050", F.col("user_id") % 7).alias("host"),
        F.lit("slaves").alias("path"),
        F.when(kind == "click", 307).when(kind == "error", 500).otherwise(200).alias("status"),
        (F.col("event_id") % 10 == 1).alias("timed_out"),
        F.when(F.col("event_id") % 10 == 2, "refused").alias("fetch_error"),
        (F.col("event_id") % 10 != 3).alias("parsed"),
    )


@query(
    "response_classes",
    f"WITH {_RESPONSE_SQL} SELECT event_id, CASE status WHEN 200 THEN 'keep' WHEN 307 THEN 'ignore' ELSE 'alert' END AS outcome, "
    "CASE WHEN status = 500 THEN 'Failed to fetch response from mesos node ' || host END AS alert FROM rs",
)
def response_classes(spark, sf):
    return snapshots.classify_response(_responses(spark, sf)).select("event_id", "outcome", "alert")


@query(
    "probe_failures",
    f"WITH {_RESPONSE_SQL}, a AS (SELECT event_id, CASE WHEN timed_out THEN 'Timed out waiting 10000 ms for result from mesos node at ' || host || '/slaves' "
    "WHEN fetch_failed THEN 'Error fetching mesos data from ' || host || '/slaves' "
    "WHEN status = 500 THEN 'Failed to fetch response from mesos node ' || host "
    "WHEN status = 200 AND NOT parsed THEN 'Failed to deserialize metrics for mesos ' || host || '/slaves' END AS alert FROM rs) "
    "SELECT event_id, alert, CASE WHEN alert LIKE 'Failed to des%' THEN 'ANOMALY' ELSE 'COMPONENT_FAILURE' END AS severity FROM a WHERE alert IS NOT NULL",
)
def probe_failures(spark, sf):
    out = snapshots.probe_failures(_responses(spark, sf))
    return out.filter(F.col("alert").isNotNull()).select("event_id", "alert", "severity")


# ---- documents -------------------------------------------------------------------------------


@query(
    "load_status",
    "SELECT CAST(user_id AS VARCHAR) AS datasource, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1",
)
def load_status(spark, sf):
    doc = F.format_string('{"%d": %d}', F.col("user_id"), F.floor("value"))
    docs = views.events(spark, sf).select("event_id", doc.alias("doc"))
    return documents.load_status(docs).groupBy("datasource").agg(F.sum("load").alias("total"))


@query(
    "max_time",
    f"WITH {E_SQL} SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN t - t % 1000 END AS max_time_us, event_id % 9 = 0 AS bad FROM e",
)
def max_time(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    doc = F.when(F.col("event_id") % 9 == 0, "oops").otherwise(
        F.concat(F.lit('[{"timestamp": "x", "result": "'), stamp, F.lit('"}]'))
    )
    out = documents.max_time(views.events(spark, sf).select("event_id", doc.alias("doc")))
    return out.select("event_id", us("max_time").alias("max_time_us"), F.col("error").isNotNull().alias("bad"))


@query("data_sources", "SELECT p_partkey AS doc_id, unnest([p_brand, p_type]) AS datasource FROM part")
def data_sources(spark, sf):
    docs = table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), F.to_json(F.array("p_brand", "p_type")).alias("doc")
    )
    return documents.data_sources(docs)


def _brokers(spark, sf) -> DataFrame:
    doc = F.format_string('{"jmx_port": -1, "host": "h%d", "port": 9092}', F.col("s_suppkey"))
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("node"), doc.alias("doc"))
    return documents.broker_map(nodes)


@query("broker_map", "SELECT CAST(s_suppkey AS INTEGER) AS id, 'h' || s_suppkey AS host, 9092 AS port FROM supplier")
def broker_map(spark, sf):
    return _brokers(spark, sf)


@query(
    "broker_endpoints",
    "WITH b AS (SELECT CAST(s_suppkey AS BIGINT) AS id, 'h' || s_suppkey || ':9092' AS ep FROM supplier), "
    "p AS (SELECT 't' || (p_partkey % 100) AS topic, CAST(p_partkey AS INTEGER) AS partition, p_partkey % 150 AS a, p_size AS b FROM part), "
    "i AS (SELECT topic, partition, string_agg(ep, ',' ORDER BY ep) AS isr FROM (SELECT topic, partition, a AS id FROM p UNION ALL "
    "SELECT topic, partition, b FROM p WHERE a <> b) x JOIN b USING (id) GROUP BY 1, 2) "
    "SELECT p.topic, p.partition, b.ep AS leader, coalesce(i.isr, '') AS isr FROM p LEFT JOIN b ON b.id = p.a LEFT JOIN i USING (topic, partition)",
)
def broker_endpoints(spark, sf):
    """Leader and in-sync endpoints; ids without a broker disappear."""
    a, b = F.col("p_partkey") % 150, F.col("p_size")
    isr = F.when(a == b, F.format_string("[%d]", a)).otherwise(F.format_string("[%d, %d]", a, b))
    doc = F.format_string('{"leader": %d, "isr": %s}', a, isr)
    nodes = table(spark, sf, "part").select(
        F.format_string("t%d", F.col("p_partkey") % 100).alias("topic"),
        F.col("p_partkey").cast("string").alias("partition"),
        doc.alias("doc"),
    )
    out = documents.partition_state(nodes, _brokers(spark, sf))
    return out.withColumn("isr", F.array_join("isr", ","))


@query(
    "consumer_offset_docs",
    "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey * 7 END AS \"offset\" FROM customer",
)
def consumer_offset_docs(spark, sf):
    doc = F.when(F.col("c_custkey") % 10 == 0, "junk").otherwise((F.col("c_custkey") * 7).cast("string"))
    return documents.consumer_offsets(table(spark, sf, "customer").select("c_custkey", doc.alias("doc")))


@query(
    "masters",
    "SELECT 'm' || c_custkey AS host, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 5050 END AS port, c_custkey % 8 = 0 AS bad "
    "FROM customer WHERE c_custkey % 2 = 0",
)
def masters(spark, sf):
    """Half of the nodes are masters, some of them unreadable."""
    key = F.col("c_custkey")
    node = F.when(key % 2 == 0, F.format_string("json.info_%d", key)).otherwise(F.format_string("log_%d", key))
    port = F.when(key % 8 == 0, "").otherwise(', "port": 5050')
    doc = F.concat(F.format_string('{"hostname": "m%d", "id": "i%d", "version": "1"', key, key), port, F.lit("}"))
    nodes = table(spark, sf, "customer").select(node.alias("node"), doc.alias("doc"))
    return documents.masters(nodes).select("host", "port", F.col("error").isNotNull().alias("bad"))


def _job_documents(spark, sf) -> tuple[DataFrame, DataFrame]:
    key = F.col("s_suppkey")
    name = F.format_string("pipe%d", key)
    jobs = F.when(key % 4 == 0, "").otherwise('"j"')
    listing = table(spark, sf, "supplier").select(
        F.lit("main").alias("env"),
        F.concat(F.lit('{"results": [{"pipeline": "'), name, F.lit('", "jobs": ['), jobs, F.lit("]}]}")).alias("doc"),
    )
    servers = F.when(key % 3 == 0, "systems.kafka-a.producer.metadata.broker.list").otherwise(
        "systems.kafka-a.producer.bootstrap.servers"
    )
    inputs = F.when(key % 7 == 0, "kafka-a").otherwise(F.lit("kafka-a.in, hdfs.x"))
    config = F.format_string(
        '{"job.name": "job%d", "task.inputs": "%s", "task.checkpoint.system": "kafka-a", "%s": "h%d:9092,h:9093"}',
        key, inputs, servers, key,
    )
    explained = table(spark, sf, "supplier").select(
        name.alias("pipeline"),
        F.concat(F.lit('{"results": {"explanation": ['), config, F.lit("]}}")).alias("doc"),
    )
    return listing, explained


@query(
    "job_inputs",
    "SELECT 'job' || s_suppkey AS job, 'kafka-a' AS system, 'in' AS stream, 'h' || s_suppkey || ':9092,h:9093' AS servers "
    "FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 7 <> 0",
)
def job_inputs(spark, sf):
    """Kafka inputs of the running jobs with their servers."""
    rows = documents.job_config(documents.running_jobs(*_job_documents(spark, sf)))
    ok = documents.kafka_inputs(rows.filter(F.col("error").isNull()))
    shown = F.array_join(
        F.transform("servers", lambda s: F.concat_ws(":", s["host"], s["port"].cast("string"))), ","
    )
    return ok.select("job", "system", "stream", shown.alias("servers"))


@query(
    "job_errors",
    "SELECT 'job' || s_suppkey AS job, 'Unable to split ''kafka-a''' AS error FROM supplier "
    "WHERE s_suppkey % 4 <> 0 AND s_suppkey % 7 = 0 UNION ALL "
    "SELECT 'job' || s_suppkey, 'No servers found in config for hdfs' FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 7 <> 0",
)
def job_errors(spark, sf):
    rows = documents.job_config(documents.running_jobs(*_job_documents(spark, sf)))
    return rows.filter(F.col("error").isNotNull()).select("job", "error")


@query(
    "checkpoint_rows",
    f"WITH {E_SQL} SELECT event_id AS log_offset, CASE WHEN event_id % 10 <> 0 THEN 'kafka-' || (user_id % 2) END AS system, "
    "CASE WHEN event_id % 10 <> 0 THEN event_type END AS stream, CASE WHEN event_id % 10 <> 0 THEN CAST(user_id % 8 AS INTEGER) END AS partition, "
    "CASE WHEN event_id % 10 <> 0 THEN CAST(floor(value) AS BIGINT) END AS \"offset\", event_id % 10 = 0 AS bad "
    "FROM e WHERE event_id % 10 = 0 OR (event_id % 10 <> 1 AND event_id % 10 <> 2)",
)
def checkpoint_rows(spark, sf):
    n = F.col("event_id") % 10
    entry = F.format_string("kafka-%d.%s.%d", F.col("user_id") % 2, F.col("event_type"), F.col("user_id") % 8)
    offsets = F.create_map(entry, F.floor("value").cast("string"))
    rows = views.events(spark, sf).select(
        F.col("event_id").alias("log_offset"),
        F.when(n != 0, "key").alias("key"),
        (n != 1).alias("is_checkpoint"),
        F.when((n != 2) & (n != 0), offsets).alias("offsets"),
    )
    out = documents.checkpoint_rows(rows)
    return out.select("log_offset", "system", "stream", "partition", "offset", F.col("error").isNotNull().alias("bad"))


def _mails(spark, sf) -> DataFrame:
    return views.events(spark, sf).select(
        F.concat(F.col("event_type"), F.lit(" "), (F.col("user_id") % 10).cast("string")).alias("title"),
        F.format_string("u%d@example.com", F.col("user_id") % 5).alias("email"),
        F.col("ts").alias("issued"),
        (F.col("user_id") % 4).alias("inbox"),
    )


@query(
    "mail_match",
    f"WITH {E_SQL}, m AS (SELECT user_id % 4 AS inbox, t, user_id % 5 = 2 AND regexp_full_match(event_type || ' ' || (user_id % 10), "
    "'(error|view) [0-7]') AS hit FROM e) SELECT inbox, count(*) AS total_mails, count(*) FILTER (hit) AS matching_mails, "
    f"count(*) FILTER (hit AND t > {NOW_US - 48 * HOUR_US}) AS recent_mails, max(CASE WHEN hit THEN t // 1000 END) AS newest_matching_ms, "
    f"count(*) FILTER (hit AND t > {NOW_US - 48 * HOUR_US}) > 0 AS ok FROM m GROUP BY 1",
)
def mail_match(spark, sf):
    return mail_feed.mail_counts(
        _mails(spark, sf),
        views.now(),
        " u2@example.com ",
        "(error|view) [0-7]",
        threshold_ms=48 * HOUR_US // 1000,
        by=["inbox"],
    )


@query(
    "atom_entries",
    "SELECT c_custkey AS inbox, 'Alert & co ' || c_custkey AS title, 'c' || c_custkey || '@example.com' AS email, "
    "1704067200000000 + c_custkey * 1000000 AS issued_us FROM customer UNION ALL "
    "SELECT c_custkey, c_name, 'x@example.com', 1704067200000000 FROM customer",
)
def atom_entries(spark, sf):
    """A mail feed with two entries per customer."""
    key = F.col("c_custkey")

    def entry(title, email, issued):
        return F.format_string(
            "<entry><title>%s</title><summary>s</summary><modified>2024-01-01T00:00:00Z</modified><issued>%s</issued>"
            "<author><name>n</name><email>%s</email></author></entry>",
            title, issued, email,
        )

    when = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + key), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    doc = F.concat(
        F.lit('<feed version="0.3" xmlns="http://purl.org/atom/ns#"><title>Inbox</title>'),
        entry(F.format_string("Alert &amp; co %d", key), F.format_string("c%d@example.com", key), when),
        entry(F.col("c_name"), F.lit("x@example.com"), F.lit("2024-01-01T00:00:00Z")),
        F.lit("</feed>"),
    )
    docs = table(spark, sf, "customer").select(key.alias("inbox"), doc.alias("doc"))
    return documents.atom_entries(docs).select("inbox", "title", "email", us("issued").alias("issued_us"))


# ---- digests ---------------------------------------------------------------------------------

_PARTS_SQL = ALERT_SQL + """, b AS (
  SELECT service, severity, t, arrival, 'm' || arrival AS body, count(*) OVER (PARTITION BY service, severity) AS n,
    row_number() OVER (PARTITION BY service, severity ORDER BY t, arrival) AS rn FROM v_alert),
  kept AS (SELECT service, severity, n, rn, body FROM b WHERE rn <= 3 OR rn > n - 2 UNION ALL
           SELECT DISTINCT service, severity, n, 3.5, '... (' || (n - 5) || ' omitted)' FROM b WHERE n > 5)"""
_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@query(
    "mail_digest_parts",
    f"WITH {_PARTS_SQL} SELECT service, severity, n AS mails, string_agg(body, {_SEP} ORDER BY rn) AS text FROM kept GROUP BY 1, 2, 3",
)
def mail_digest_parts(spark, sf):
    mails = views.alerts(spark, sf).select(
        "service", "severity", "ts", "arrival", F.concat(F.lit("m"), F.col("arrival").cast("string")).alias("body")
    )
    return digest.digest_parts(mails, ["service", "severity"], ["ts", "arrival"], 5)


_STOP = str(NOW_US)
_OUTAGE = (views.START_US + 5 * 24 * HOUR_US, views.START_US + 6 * 24 * HOUR_US)
_WAIT = f"CASE least({{0}}, 2) WHEN 0 THEN {HOUR_US} WHEN 1 THEN {6 * HOUR_US} ELSE {24 * HOUR_US} END"
_DIGEST_SQL = ALERT_SQL + f""", mails AS MATERIALIZED (
  SELECT '[' || severity || '] ' || service || ': ' || description AS subject, t AS at_us, arrival,
    'timestamp: ' || strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' || chr(10) || 'host: ' || host || chr(10) || 'k: ' || k AS body
  FROM v_alert WHERE t <= {_STOP}),
  timer(subject, n, opened, due, step, holding, sent_from, sent_to) AS (
  SELECT subject, 0, min(at_us), min(at_us) + {HOUR_US}, 0, true, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM mails GROUP BY subject
  UNION ALL
  SELECT subject, n + 1,
    CASE WHEN empty THEN nxt WHEN failed THEN opened ELSE due END,
    CASE WHEN empty THEN nxt + {HOUR_US} WHEN failed THEN due + {_WAIT.format('step')} ELSE due + {_WAIT.format('step + 1')} END,
    CASE WHEN empty THEN 0 WHEN failed THEN step ELSE least(step + 1, 2) END,
    empty OR failed,
    CASE WHEN NOT empty AND NOT failed THEN opened END,
    CASE WHEN NOT empty AND NOT failed THEN due END
  FROM (
    SELECT f.subject, f.n, f.opened, f.due, f.step, min(m.at_us) AS nxt,
      NOT f.holding AND coalesce(min(m.at_us) >= f.due, true) AS empty,
      f.due >= {_OUTAGE[0]} AND f.due < {_OUTAGE[1]} AS failed
    FROM timer f LEFT JOIN mails m ON m.subject = f.subject AND m.at_us >= f.opened
    WHERE f.due <= {_STOP} GROUP BY f.subject, f.n, f.opened, f.due, f.step, f.holding) x
  WHERE NOT (empty AND nxt IS NULL)),
  spans AS (
  SELECT subject, sent_from AS a, sent_to AS b, false AS flushed FROM timer WHERE sent_from IS NOT NULL
  UNION ALL
  SELECT DISTINCT f.subject, f.opened, {_STOP} + 1, true FROM timer f JOIN mails m ON m.subject = f.subject AND m.at_us >= f.opened
  WHERE f.due > {_STOP}),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY a) - 1 AS digest FROM spans),
  inside AS (
  SELECT s.subject, s.digest, s.b, s.flushed, m.body, count(*) OVER w AS n,
    row_number() OVER (PARTITION BY s.subject, s.digest ORDER BY m.at_us, m.arrival) AS rn
  FROM numbered s JOIN mails m ON m.subject = s.subject AND m.at_us >= s.a AND m.at_us < s.b
  WINDOW w AS (PARTITION BY s.subject, s.digest)),
  parts AS (SELECT subject, digest, b, flushed, n, rn, body FROM inside WHERE rn <= 2 OR rn > n - 2 UNION ALL
            SELECT DISTINCT subject, digest, b, flushed, n, 2.5, '... (' || (n - 4) || ' omitted)' FROM inside WHERE n > 4)"""


@query(
    "mail_digest",
    f"WITH RECURSIVE {_DIGEST_SQL} SELECT subject, digest, n AS mails, b AS sent_us, flushed, "
    f"string_agg(body, {_SEP} ORDER BY rn) AS text FROM parts GROUP BY 1, 2, 3, 4, 5",
)
def mail_digest(spark, sf):
    """Digests of all alerts per subject with growing waits and one outage of the mail server."""
    mails = ev.alert_mails(views.alerts(spark, sf)).select("subject", "body", "ts", "arrival")
    out = digest.mail_digest(mails, "PT1H PT6H P1D", 4, views.now(), [_OUTAGE])
    return out.select("subject", "digest", "mails", F.col("to_us").alias("sent_us"), "flushed", "text")


# ---- configurations --------------------------------------------------------------------------


def _old_new(spark, sf) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    old = part.filter(F.col("p_partkey") % 4 != 0).select("p_partkey", "p_size")
    size = F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    return old, part.filter(F.col("p_partkey") % 5 != 0).select("p_partkey", size.alias("p_size"))


_CFG_SQL = (
    "o AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 4 <> 0), "
    "n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 0)"
)


@query(
    "config_diff",
    f"WITH {_CFG_SQL} SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, o.p_size AS old_value, n.p_size AS new_value, "
    "CASE WHEN n.p_partkey IS NULL THEN 'removed' WHEN o.p_partkey IS NULL THEN 'added' "
    "WHEN o.p_size IS NOT DISTINCT FROM n.p_size THEN 'unchanged' ELSE 'changed' END AS change "
    "FROM o FULL JOIN n ON o.p_partkey = n.p_partkey",
)
def config_diff(spark, sf):
    return configs.config_diff(*_old_new(spark, sf), "p_partkey", "p_size")


@query("new_keys", f"WITH {_CFG_SQL} SELECT p_partkey FROM n EXCEPT SELECT p_partkey FROM o")
def new_keys(spark, sf):
    return configs.new_keys(*_old_new(spark, sf), "p_partkey")


@query("gone_keys", f"WITH {_CFG_SQL} SELECT p_partkey FROM o EXCEPT SELECT p_partkey FROM n")
def gone_keys(spark, sf):
    return configs.gone_keys(*_old_new(spark, sf), "p_partkey")


def _commits(spark, sf) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("k"), (key % 500).cast("string")).alias("key"),
        key.alias("version"),
        F.when(key % 6 == 0, None).when(key % 6 == 1, "").otherwise(F.col("p_name")).alias("payload"),
        F.when(key % 6 == 2, "bad yaml").alias("error"),
    )


_COMMIT_SQL = (
    "c AS (SELECT 'k' || (p_partkey % 500) AS key, p_partkey AS version, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_name END AS payload, "
    "CASE WHEN p_partkey % 6 = 2 THEN 'bad yaml' END AS error FROM part)"
)


@query(
    "config_by_key",
    f"WITH {_COMMIT_SQL} SELECT version, CASE WHEN error IS NOT NULL OR payload IS NULL OR trim(payload) = '' THEN 'error' ELSE 'value' END AS outcome "
    "FROM c WHERE key = 'k7'",
)
def config_by_key(spark, sf):
    return configs.config_by_key(_commits(spark, sf), "k7").select("version", "outcome")


@query("valid_configs", f"WITH {_COMMIT_SQL} SELECT key, version FROM c WHERE payload IS NOT NULL AND error IS NULL")
def valid_configs(spark, sf):
    return configs.valid_configs(_commits(spark, sf)).select("key", "version")


@query(
    "config_alerts",
    f"WITH {_COMMIT_SQL} SELECT 'Bad config for probe: ' || key AS description, error FROM c WHERE payload IS NOT NULL AND error IS NOT NULL",
)
def config_alerts(spark, sf):
    return configs.config_alerts(_commits(spark, sf), "probe")


@query(
    "datasource_thresholds",
    "SELECT 'e' || p_partkey AS env, p_type AS datasource, CAST(CASE p_partkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 86400000 * 2 + 1800000 "
    "ELSE (1 + p_size) * 3600000 END AS BIGINT) AS threshold_ms, CASE WHEN p_partkey % 4 = 1 THEN 'key' || p_size END AS pager_key, p_partkey % 4 = 3 AS bad FROM part",
)
def datasource_thresholds(spark, sf):
    hours = F.col("p_size") + 1
    raw = (
        F.when(F.col("p_partkey") % 4 == 0, F.format_string('"PT%dH"', hours))
        .when(F.col("p_partkey") % 4 == 1, F.format_string('{"threshold": "PT%dH", "pagerKey": "key%d"}', hours, F.col("p_size")))
        .when(F.col("p_partkey") % 4 == 2, '{"threshold": "P2DT30M"}')
        .otherwise("[1, 2]")
    )
    alert = F.concat(F.lit('{"'), F.col("p_type"), F.lit('": '), raw, F.lit("}"))
    rows = table(spark, sf, "part").select(F.format_string("e%d", F.col("p_partkey")).alias("env"), alert.alias("alert"))
    out = configs.datasource_thresholds(rows)
    return out.select("env", "datasource", "threshold_ms", "pager_key", F.col("error").isNotNull().alias("bad"))


@query(
    "monitored_pairs",
    "SELECT 'e' || p_partkey AS env, p_brand AS consumer_group, topic, CAST(CASE WHEN topic = 't1' THEN 60000 ELSE 300000 END AS BIGINT) AS alert_ms, "
    "CAST(CASE WHEN topic = 't2' THEN NULL ELSE 3600000 END AS BIGINT) AS pager_ms, topic = 't2' AS bad FROM part, (VALUES ('t1'), ('t2')) v(topic)",
)
def monitored_pairs(spark, sf):
    alert = F.concat(
        F.lit('{"'), F.col("p_brand"),
        F.lit('": {"t1": {"alert": "PT1M", "pager": "PT1H"}, "t2": {"alert": "PT5M", "pager": "x"}}}'),
    )
    rows = table(spark, sf, "part").select(
        F.format_string("e%d", F.col("p_partkey")).alias("env"),
        F.lit("/kafka").alias("path"),
        F.lit("pk").alias("pager_key"),
        alert.alias("alert"),
    )
    out = configs.monitored_pairs(rows)
    return out.select("env", "consumer_group", "topic", "alert_ms", "pager_ms", F.col("error").isNotNull().alias("bad"))


@query(
    "check_definitions",
    "SELECT 'g' || p_partkey AS \"group\", p_type AS name, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 3 END AS fail_count, 2 AS resolve_count, "
    "p_partkey % 3 <> 0 AS enabled, CAST(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 120000 END AS BIGINT) AS period_ms, p_partkey % 5 = 0 AS bad FROM part",
)
def check_definitions(spark, sf):
    size = F.when(F.col("p_size") % 2 == 0, F.format_string(', "failCount": %d', F.col("p_size"))).otherwise("")
    enabled = F.when(F.col("p_partkey") % 3 == 0, ', "enabled": false').otherwise("")
    period = F.when(F.col("p_partkey") % 5 == 0, '"soon"').otherwise('"PT2M"')
    payload = F.concat(
        F.lit('{"checks": {"'), F.col("p_type"), F.lit('": {"checkPeriod": '), period, size, enabled, F.lit("}}}")
    )
    rows = table(spark, sf, "part").select(F.format_string("g%d", F.col("p_partkey")).alias("group"), payload.alias("payload"))
    out = configs.check_definitions(rows, "checks")
    return out.select(
        "group", "name", "fail_count", "resolve_count", "enabled", "period_ms", F.col("error").isNotNull().alias("bad")
    )


# ---- text ------------------------------------------------------------------------------------


@query(
    "uri_masked",
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '://', '://user:*@') WHEN 2 THEN replace(url, '://', '://*@') ELSE url END AS uri FROM pages",
)
def uri_masked(spark, sf):
    info = F.when(F.col("page_id") % 4 == 0, "://user:s3:cr@").when(F.col("page_id") % 4 == 2, "://token@").otherwise("://")
    url = F.replace("url", F.lit("://"), info)
    return table(spark, sf, "pages").select("page_id", text.mask_user_info(url).alias("uri"))


@query(
    "body_trimmed",
    "SELECT doc_id, CASE WHEN length(text) > 1024 THEN substr(text, 1, 1024) || ' ...' ELSE text END AS trimmed, "
    "CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || ' ... (' || format('{:,}', length(text) - 500) || ' more chars)' ELSE text END AS limited FROM documents",
)
def body_trimmed(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.trim_body("text").alias("trimmed"), text.limit_body("text", 500).alias("limited")
    )


@query(
    "period_text",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' AS period "
    "FROM (SELECT *, CAST(floor(l_extendedprice * 10) AS BIGINT) AS s FROM lineitem) x",
)
def period_text(spark, sf):
    seconds = F.floor(F.col("l_extendedprice") * 10)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.period_text(seconds).alias("period")
    )


@query(
    "period_millis",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE (o_orderkey % 4) * 86400000 + (o_custkey % 24) * 3600000 + 90500 END AS ms FROM orders",
)
def period_millis(spark, sf):
    iso = F.when(F.col("o_orderkey") % 10 == 0, "P1M").otherwise(
        F.format_string("P%dDT%dH1M30.5S", F.col("o_orderkey") % 4, F.col("o_custkey") % 24)
    )
    return table(spark, sf, "orders").select("o_orderkey", period_millis_column(iso).alias("ms"))


@query(
    "topology_paths",
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'topic-' || c_custkey WHEN 1 THEN 't.' || c_custkey END AS topic, "
    "CASE WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 9 AS INTEGER) END AS partition FROM customer",
)
def topology_paths(spark, sf):
    key = F.col("c_custkey")
    path = (
        F.when(key % 3 == 0, F.format_string("/brokers/topics/topic-%d", key))
        .when(key % 3 == 1, F.format_string("/brokers/topics/t.%d/partitions/%d/state", key, key % 9))
        .otherwise("/brokers/ids/1")
    )
    at_path = text.partition_of_path(path)
    topic = F.coalesce(at_path["topic"], F.nullif(text.topic_of_path(path), F.lit("")))
    return table(spark, sf, "customer").select("c_custkey", topic.alias("topic"), at_path["partition"].alias("partition"))


@query(
    "checkpoint_freshness",
    f"WITH {E_SQL}, s AS (SELECT event_id, event_id % 3 <> 0 AS init, t AS started, t + 60000000 AS last_ok FROM e) "
    f"SELECT event_id, CASE WHEN init THEN CASE WHEN last_ok // 1000 < {NOW_US // 1000 - 86_400_000} THEN 'error' ELSE 'values' END "
    f"WHEN started // 1000 < {NOW_US // 1000 - 86_400_000} THEN 'error' ELSE 'none' END AS outcome, "
    f"CASE WHEN init AND last_ok // 1000 < {NOW_US // 1000 - 86_400_000} THEN 'boom' END AS cause FROM s",
)
def checkpoint_freshness(spark, sf):
    from ..operators.lag import checkpoint_freshness as freshness_of

    states = views.events(spark, sf).select(
        "event_id",
        F.lit("app").alias("app"),
        F.lit("cp").alias("topic"),
        (F.col("event_id") % 3 != 0).alias("initialised"),
        F.col("ts").alias("started"),
        shift("ts", 60_000).alias("last_ok"),
        F.lit("boom").alias("failure"),
    )
    return freshness_of(states, views.now(), 86_400_000).select("event_id", "outcome", "cause")
