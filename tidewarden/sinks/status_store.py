"""Status tables fed by micro-batches.

A batch writes only what it changes: its newest status per track and its own trimmed history, as a
delta. Both rules give the same answer on merged parts as on all rows, so a read merges the last
base with the deltas after it, and every `compact_every` batches the merge is written as a new
base. What counts is named by the newest version of the store's log (`versions`), committed by one rename for both
tables: a lost executor or a restart in the middle leaves the old version in force, a reader sees an old or a new one
and never a part, and a batch that runs twice does nothing the second time. Batch numbers must grow, as those of a
streaming query do. Folders that none of the last `keep` versions and no published table names are removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators import status
from .versions import Versions

TABLES = ("current", "history")


def create_status_tables(spark: SparkSession, database: str, location: str) -> None:
    """Catalog tables for a written-out state, made only where they are missing."""
    for table in TABLES:
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.status_{table} ({schemas.STATUS_TABLE}) "
            f"USING parquet LOCATION '{location}/{table}'"
        )


class StatusStore:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        history_size: int = status.HISTORY_SIZE,
        compact_every: int = 20,
        keep: int = 3,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.history_size, self.compact_every, self.keep = history_size, compact_every, keep
        self.versions = Versions(spark, root)

    def _committed(self) -> tuple[int | None, list[int]]:
        """Number of the last base and of the deltas after it."""
        _, document = self.versions.newest()
        return document.get("base"), document.get("deltas", [])

    def _merge(self, table: str, parts: DataFrame) -> DataFrame:
        if table == "current":
            return status.latest_status(parts)
        return status.status_history(parts, self.history_size)

    def _read(self, table: str, base: int | None, deltas: list[int]) -> DataFrame:
        paths = [f"{self.root}/{table}/base={base}"] if base is not None else []
        paths += [f"{self.root}/{table}/delta={d}" for d in deltas]
        if not paths:
            return self.spark.createDataFrame([], schemas.STATUS_TABLE)
        parts = [self.spark.read.schema(schemas.STATUS_TABLE).parquet(p) for p in paths]
        return self._merge(table, reduce(DataFrame.unionByName, parts))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The `current` or `history` table of the newest version, or of one of the last `keep`."""
        document = self.versions.newest()[1] if version is None else self.versions.read(version)
        return self._read(table, document.get("base"), document.get("deltas", []))

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """`foreachBatch` body."""
        number, document = self.versions.newest()
        if batch_id <= document.get("batch", -1):
            return
        columns = self._read("current", None, []).columns
        rows = batch.select(*columns)
        for table in TABLES:
            part = self._merge(table, rows)
            part.write.mode("overwrite").parquet(f"{self.root}/{table}/delta={batch_id}")
        deltas = [*document.get("deltas", []), batch_id]
        self.versions.commit(number + 1, {**document, "batch": batch_id, "deltas": deltas})
        if len(deltas) >= self.compact_every:
            self.compact()
        self._clean()

    def compact(self) -> int | None:
        """Write the merge of all deltas as a new base, and return its number."""
        number, document = self.versions.newest()
        deltas = document.get("deltas", [])
        if not deltas:
            return document.get("base")
        base = document["batch"]
        for table in TABLES:
            merged = self._read(table, document.get("base"), deltas)
            merged.write.mode("overwrite").parquet(f"{self.root}/{table}/base={base}")
        self.versions.commit(number + 1, {**document, "base": base, "deltas": []})
        return base

    def _clean(self) -> None:
        """Remove what no version to keep and no published table names."""
        numbers = self.versions.numbers()[-self.keep :]
        used = {f"delta={self.versions.newest()[1].get('batch')}"}
        for number in numbers:
            document = self.versions.read(number)
            used |= {f"base={b}" for b in (document.get("base"), *document.get("published", []))}
            used |= {f"delta={d}" for d in document.get("deltas", [])}
        for table in TABLES:
            for name in self.versions.names(table):
                if name not in used:
                    self.versions.remove(table, name)
        self.versions.forget(numbers[0] if numbers else 0)

    def publish(self, database: str) -> None:
        """Let the catalog tables of `create_status_tables` show the newest version: a base is written if there are
        deltas, and then each table's location is changed to it. Readers see the old base or the new one; the one
        published before is kept for queries that still read it."""
        base = self.compact()
        if base is None:
            return
        number, document = self.versions.newest()
        published = [b for b in document.get("published", []) if b != base][-1:] + [base]
        self.versions.commit(number + 1, {**document, "published": published})
        for table in TABLES:
            name = f"{database}.status_{table}"
            self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{self.root}/{table}/base={base}'")
            self.spark.catalog.refreshTable(name)
        self._clean()
