"""An append-only log of messages as a streaming source of its own, for feeds without a broker.

Layout: `<path>/partition=<p>/<offset of the first row>.parquet` with columns offset, received_at and payload; offsets of
a partition rise by one from file to file. Writers add files (`append`), retention removes the oldest ones.

The source registers as `tidewarden_log`. It starts at the newest offset (option `startingOffsets`: `latest`, or
`earliest`), goes on from the query's checkpoint after a restart, and reads each partition in tasks of its own, opening
only files that hold wanted offsets. If the log has lost what comes next (retention), or is shorter than what was read
(it was made anew), the partition is read again from its beginning. Row counts are taken from file footers, so looking
for new messages reads no data. Paths are of any file system that pyarrow knows by URI, and are seen by all executors.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

NAME = "tidewarden_log"
SCHEMA = "`partition` int, offset bigint, received_at timestamp, payload string"


@dataclass
class Stretch(InputPartition):
    """Offsets from `start` up to before `end` of a partition, in some of its files."""

    partition: int
    start: int
    end: int
    files: list[str]


class Log:
    """The files of a log."""

    def __init__(self, path: str):
        self.fs, self.root = fs.FileSystem.from_uri(path)

    def files(self) -> dict[int, list[tuple[int, str]]]:
        """First offsets and paths by partition, in order."""
        found: dict[int, list[tuple[int, str]]] = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            folder, _, name = info.path.rpartition("/")
            key, _, number = folder.rpartition("/")[2].partition("=")
            if info.type == fs.FileType.File and key == "partition" and name.endswith(".parquet") and name[0] not in "._":
                found.setdefault(int(number), []).append((int(name.removesuffix(".parquet")), info.path))
        return {p: sorted(own) for p, own in found.items()}

    def spans(self) -> dict[int, tuple[int, int]]:
        """First offset and end of each partition."""
        out = {}
        for partition, own in self.files().items():
            with self.fs.open_input_file(own[-1][1]) as last:
                out[partition] = (own[0][0], own[-1][0] + pq.ParquetFile(last).metadata.num_rows)
        return out

    def stretches(self, start: dict[int, int], end: dict[int, int]) -> list[Stretch]:
        found = []
        for partition, own in self.files().items():
            high = end.get(partition, 0)
            low = start.get(partition, own[0][0])
            if low < own[0][0] or low > high:
                low = own[0][0]  # out of range: from the beginning
            firsts = [first for first, _ in own]
            a, b = max(bisect.bisect_right(firsts, low) - 1, 0), bisect.bisect_left(firsts, high)
            if low < high:
                found.append(Stretch(partition, low, high, [path for _, path in own[a:b]]))
        return found

    def rows(self, stretch: Stretch) -> Iterator[pa.RecordBatch]:
        for path in stretch.files:
            with self.fs.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(columns=["offset", "received_at", "payload"]):
                    first = batch.column(0)[0].as_py() if batch.num_rows else 0
                    low, high = max(stretch.start - first, 0), min(stretch.end - first, batch.num_rows)
                    if low < high:
                        some = batch.slice(low, high - low)
                        number = pa.array([stretch.partition] * some.num_rows, pa.int32())
                        when = some.column(1).cast(pa.timestamp("us", "UTC"))
                        yield pa.RecordBatch.from_arrays(
                            [number, some.column(0), when, some.column(2).cast(pa.string())], ["partition", "offset", "received_at", "payload"]
                        )


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStream(self.options["path"], self.options.get("startingOffsets", "latest"))


class LogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Stretch]:
        log = Log(self.path)
        return log.stretches({}, {p: end for p, (_, end) in log.spans().items()})

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return Log(self.path).rows(partition)


class LogStream(DataSourceStreamReader):
    """Offsets are the ends of what was read, by partition."""

    def __init__(self, path: str, starting: str):
        if starting not in ("latest", "earliest"):
            raise ValueError(f"startingOffsets must be latest or earliest, not {starting}")
        self.path, self.starting = path, starting

    def initialOffset(self) -> dict:
        place = 1 if self.starting == "latest" else 0
        return {str(p): span[place] for p, span in Log(self.path).spans().items()}

    def latestOffset(self) -> dict:
        return {str(p): end for p, (_, end) in Log(self.path).spans().items()}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        ends = {int(p): o for p, o in end.items()}
        return Log(self.path).stretches({int(p): o for p, o in start.items()}, ends)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return Log(self.path).rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to tell: the query's checkpoint holds the offsets."""


def read(spark: SparkSession, path: str, streaming: bool = True, starting: str = "latest") -> DataFrame:
    """A log as payload, received_at, partition and arrival, as `feeds.read_kafka` gives them."""
    spark.dataSource.register(LogSource)
    reader = spark.readStream if streaming else spark.read
    raw = reader.format(NAME).option("path", path).option("startingOffsets", starting).load()
    return raw.select("payload", "received_at", "partition", F.col("offset").alias("arrival"))


def append(messages: DataFrame, path: str, partitions: int, first: dict[int, int] | None = None) -> None:
    """Add messages (payload, received_at, and order columns if there are any) to a log, one file per partition. `first`
    are the next offsets where the log is not to be asked. Each file is written whole and then moved to its place."""
    log = Log(path)
    next_offset = first if first is not None else {p: end for p, (_, end) in log.spans().items()}
    number = F.pmod(F.xxhash64("payload", "received_at"), F.lit(partitions)).cast("int").alias("_p")
    order = Window.partitionBy("_p").orderBy("received_at", "payload")
    placed = messages.select("payload", F.col("received_at").cast("timestamp"), number)
    starts = F.create_map(*[F.lit(x) for p in range(partitions) for x in (p, int(next_offset.get(p, 0)))])
    placed = placed.withColumn("offset", starts[F.col("_p")].cast("long") + F.row_number().over(order) - 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pq.ParquetWriter] = {}
        names: dict[int, tuple[str, str]] = {}
        target = Log(path)
        for batch in batches:
            numbers = batch.column(batch.schema.names.index("_p"))
            for p in sorted(set(numbers.to_pylist())):
                own = batch.filter(pa.compute.equal(numbers, p)).select(["offset", "received_at", "payload"])
                if p not in held:
                    folder = f"{target.root}/partition={p}"
                    target.fs.create_dir(folder, recursive=True)
                    name = f"{own.column(0)[0].as_py():020d}.parquet"
                    names[p] = (f"{folder}/.{name}", f"{folder}/{name}")
                    held[p] = pq.ParquetWriter(target.fs.open_output_stream(names[p][0]), own.schema)
                held[p].write_batch(own)
        for p, writer in held.items():
            writer.close()
            target.fs.move(*names[p])
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32())], ["partition"])

    written = placed.repartition("_p").sortWithinPartitions("_p", "offset").mapInArrow(write, "`partition` int")
    written.write.format("noop").mode("overwrite").save()
