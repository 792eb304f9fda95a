"""JSON and XML documents of probed systems to rows. Every reader takes a DataFrame with a text
column `doc`, keeps the other columns, and turns what cannot be read into an `error`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, host_port, split_pair
from ..functions.times import instant

PIPE = "struct<pipeId:string,intervals:array<string>,more:struct<log:string>>"
PIPELINE = "map<string,struct<pipes:array<struct<id:string,channel:string>>>>"
MASTER = "hostname string, id string, pid string, port int, version string"
FEED = (
    "entry array<struct<title:string,summary:string,modified:string,issued:string,"
    "author:struct<name:string,email:string>>>"
)
JOB_LIST = "struct<results:array<struct<pipeline:string,jobs:array<string>>>>"
JOB_EXPLAIN = "struct<results:struct<explanation:array<map<string,string>>>>"


def _rest(df: DataFrame, *drop: str) -> list[str]:
    return [c for c in df.columns if c not in ("doc", *drop)]


def _fields(df: DataFrame, schema: str, *drop: str) -> DataFrame:
    """The document's fields as columns next to the kept ones; parsed once per row."""
    return df.select(*[c for c in df.columns if c not in drop], F.inline(F.array(F.from_json("doc", schema))))


def broker_map(df: DataFrame) -> DataFrame:
    """Nodes (node, doc) to id, host, port."""
    rest = _rest(df, "node")
    return _fields(df, "host string, port int").select(
        *rest, F.col("node").try_cast("int").alias("id"), "host", "port"
    )


def partition_state(df: DataFrame, brokers: DataFrame) -> DataFrame:
    """Nodes (topic, partition, doc) to leader and in-sync endpoints; unknown ids disappear."""
    rows = _fields(df, "leader int, isr array<int>").select(
        "topic", F.col("partition").cast("int").alias("partition"), "leader", "isr"
    )
    known = brokers.select("id", F.concat_ws(":", "host", F.col("port").cast("string")).alias("at"))
    isr = (
        rows.select("topic", "partition", F.explode_outer("isr").alias("id"))
        .join(known, "id", "left")
        .groupBy("topic", "partition")
        .agg(F.sort_array(F.collect_list("at")).alias("isr"))
    )
    leaders = known.select(F.col("id").alias("leader_id"), F.col("at").alias("leader"))
    return (
        rows.select("topic", "partition", F.col("leader").alias("leader_id"))
        .join(leaders, "leader_id", "left")
        .join(isr, ["topic", "partition"], "left")
        .select("topic", "partition", "leader", "isr")
    )


def consumer_offsets(df: DataFrame) -> DataFrame:
    """Nodes whose text is an offset."""
    return df.select(*_rest(df), F.trim("doc").try_cast("bigint").alias("offset"))


def load_status(df: DataFrame) -> DataFrame:
    """{datasource: segments left}."""
    entries = F.from_json("doc", "map<string,int>")
    return df.select(*_rest(df), F.explode(entries).alias("datasource", "load"))


def data_sources(df: DataFrame) -> DataFrame:
    return df.select(*_rest(df), F.explode(F.from_json("doc", "array<string>")).alias("datasource"))


def max_time(df: DataFrame) -> DataFrame:
    """Head of an array of {result}: the newest data time."""
    head = F.get(F.from_json("doc", "array<struct<result:string>>"), F.lit(0))["result"]
    out = df.select(*_rest(df), "doc", F.explode(F.array(instant(head))).alias("max_time"))
    problem = F.concat(F.lit("Cannot parse response from broker: "), F.col("doc"))
    return out.select(
        *_rest(df), "max_time", F.when(F.col("max_time").isNull(), problem).alias("error")
    )


def _interval(text: Column) -> Column:
    return bind(
        split_pair(text, "/"), lambda p: F.struct(instant(p[0]).alias("start"), instant(p[1]).alias("end"))
    )


def work_items(df: DataFrame) -> DataFrame:
    """Array of [id, object] pairs; of the same id the later one counts. Decided within each document, by
    sorting its pairs by id and place."""
    pairs = F.from_json("doc", "array<array<string>>")
    rest = _rest(df)
    placed = F.array_sort(
        F.transform(
            pairs,
            lambda p, i: F.struct(F.get(p, F.lit(0)).alias("id"), i.alias("at"), F.get(p, F.lit(1)).alias("raw")),
        )
    )

    def last_ones(found: Column) -> Column:
        def is_last(p: Column, i: Column) -> Column:
            return (i == F.size(found) - 1) | ~F.get(found, i + 1)["id"].eqNullSafe(p["id"])

        return F.filter(found, is_last)

    last = df.select(*rest, F.explode(bind(placed, last_ones)).alias("_p"))
    last = last.select(*rest, F.col("_p.id").alias("item_id"), F.col("_p.raw").alias("_raw"))
    out = last.select(*rest, "item_id", F.inline(F.array(F.from_json("_raw", PIPE))))
    return out.select(
        *rest,
        "item_id",
        F.col("pipeId").alias("pipe_id"),
        F.transform("intervals", _interval).alias("intervals"),
        F.col("more.log").alias("log"),
    )


def pipelines(df: DataFrame) -> DataFrame:
    """Values of a map of pipelines, each with its pipes."""
    each = df.select(*_rest(df), F.explode(F.map_values(F.from_json("doc", PIPELINE))).alias("p"))
    return each.select(*_rest(df), F.col("p.pipes").alias("pipes"))


def running_jobs(listing: DataFrame, explanations: DataFrame) -> DataFrame:
    """Pipelines with at least one job, with the configuration of each job."""
    rest = _rest(listing)
    active = (
        listing.select(*rest, F.explode(F.from_json("doc", JOB_LIST)["results"]).alias("r"))
        .filter(F.size("r.jobs") > 0)
        .select(*rest, F.col("r.pipeline").alias("pipeline"))
    )
    jobs = explanations.select(
        "pipeline", F.explode(F.from_json("doc", JOB_EXPLAIN)["results"]["explanation"]).alias("config")
    )
    return active.join(jobs, "pipeline", "inner")


def job_config(df: DataFrame, config: str = "config") -> DataFrame:
    """Name and inputs of a job, one row per input, with the servers of the input's system: the
    property bootstrap.servers, else metadata.broker.list. Missing or odd settings give an error."""
    c = F.col(config)
    inputs = F.transform(F.split(F.element_at(c, F.lit("task.inputs")), ","), lambda s: F.trim(s))
    each = df.withColumn("_input", F.explode_outer(inputs))
    pair = split_pair("_input", "[.]")
    system = pair[0]

    def setting(suffix: str) -> Column:
        return F.element_at(c, F.concat(F.lit("systems."), system, F.lit(f".{suffix}")))

    listed = F.coalesce(setting("producer.bootstrap.servers"), setting("producer.metadata.broker.list"))
    servers = F.transform(F.split(listed, ","), lambda s: host_port(s))
    bad_server = F.exists(servers, lambda s: s.isNull())
    name = F.element_at(c, F.lit("job.name"))
    problem = (
        F.when(name.isNull(), "job.name wasn't found in config")
        .when(F.col("_input").isNull(), "task.inputs wasn't found in config")
        .when(pair.isNull(), F.format_string("Unable to split '%s'", F.col("_input")))
        .when(listed.isNull(), F.concat(F.lit("No servers found in config for "), system))
        .when(bad_server, F.format_string("Unable to split '%s'", listed))
    )
    return each.select(
        *[x for x in df.columns if x != config],
        name.alias("job"),
        system.alias("system"),
        pair[1].alias("stream"),
        servers.alias("servers"),
        setting("consumer.zookeeper.connect").alias("zk_path"),
        F.element_at(c, F.lit("task.checkpoint.system")).alias("checkpoint_system"),
        problem.alias("error"),
    )


def kafka_inputs(df: DataFrame) -> DataFrame:
    return df.filter(F.startswith("system", F.lit("kafka-")))


def atom_entries(df: DataFrame) -> DataFrame:
    """Entries of an Atom mail feed; a feed that cannot be parsed has none."""
    each = df.select(*_rest(df), F.explode(F.from_xml("doc", FEED)["entry"]).alias("e"))
    return each.select(
        *_rest(df),
        "e.title",
        F.trim("e.summary").alias("summary"),
        F.col("e.author.name").alias("author"),
        F.col("e.author.email").alias("email"),
        instant("e.modified").alias("modified"),
        instant("e.issued").alias("issued"),
    )


def masters(df: DataFrame) -> DataFrame:
    """Nodes named json.info_* to master endpoints; a bad one carries an error."""
    rest = _rest(df, "node")
    nodes = _fields(df.filter(F.startswith("node", F.lit("json.info_"))), MASTER, "id", "host")
    bad = F.col("hostname").isNull() | F.col("port").isNull()
    return nodes.select(
        *rest,
        F.col("hostname").alias("host"),
        "id",
        "port",
        "version",
        F.when(bad, F.concat(F.lit("Mesos master ZK parse exception at "), F.col("node"))).alias("error"),
    )


def checkpoint_rows(df: DataFrame) -> DataFrame:
    """Checkpoint log (log_offset, key, is_checkpoint, offsets map of "system.stream.partition" to
    offset text) to one row per input partition. A row without a key is an error; other keys and
    empty payloads are skipped."""
    rows = df.filter(F.col("key").isNull() | (F.col("is_checkpoint") & F.col("offsets").isNotNull()))
    each = rows.select("log_offset", "key", F.explode_outer("offsets").alias("_at", "_offset"))
    parts = F.split("_at", "[.]")
    return each.select(
        "log_offset",
        parts[0].alias("system"),
        F.get(parts, F.lit(1)).alias("stream"),
        F.get(parts, F.lit(2)).try_cast("int").alias("partition"),
        F.col("_offset").try_cast("bigint").alias("offset"),
        F.when(F.col("key").isNull(), "Encountered message without key").alias("error"),
    )
