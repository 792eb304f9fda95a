"""A log of versions of a folder, each committed by one rename.

A version is a small JSON document. It is written beside the log under a name of its own and then renamed to its number;
a rename that finds the number taken fails. So a reader sees a whole version or the one before, and of two writers of
the same number one is refused. The calls go to the file system that the folder's URI names, from the driver."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

LOG = "_versions"


class VersionTaken(RuntimeError):
    """Another writer has committed this version."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(conf)
        self._context = self._jvm.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        kind = self._jvm.fs.Options.Rename
        self._keep_target = spark.sparkContext._gateway.new_array(kind, 0)

    def _path(self, *parts):
        return self._jvm.fs.Path("/".join([self.root, *parts]))

    def names(self, *parts: str) -> list[str]:
        """Names in a folder below the root; none if there is no such folder."""
        folder = self._path(*parts)
        return [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names(LOG) if n.endswith(".json"))

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(LOG, f"{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict]:
        """Number and document of the newest version; 0 and an empty document before the first one."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def commit(self, number: int, document: dict) -> None:
        draft = self._path(LOG, f".{uuid.uuid4().hex}")
        target = self._path(LOG, f"{number:012d}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(document).encode()))
        finally:
            out.close()
        if self._fs.exists(target):
            self._fs.delete(draft, False)
            raise VersionTaken(f"version {number} of {self.root} is committed already")
        try:
            self._context.rename(draft, target, self._keep_target)
        except Exception as problem:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(problem):
                raise VersionTaken(f"version {number} of {self.root} is committed already") from problem
            raise

    def remove(self, *parts: str) -> None:
        self._fs.delete(self._path(*parts), True)

    def forget(self, before: int) -> None:
        """Remove the documents of versions before a number."""
        for number in self.numbers():
            if number < before:
                self._fs.delete(self._path(LOG, f"{number:012d}.json"), False)
