"""Small files in the folders that Spark can reach: markers that are replaced at once, and lists of names."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder in any of Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _path(self, name: str):
        return self._hadoop.Path(self.at(name))

    def names(self) -> list[str]:
        """What is in the folder; nothing if it does not exist."""
        here = self._hadoop.Path(self.path)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(here)) if self._fs.exists(here) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def complete(self, name: str) -> bool:
        """Is this a table that was written to its end?"""
        return self.exists(f"{name}/_SUCCESS")

    def write(self, name: str, content: bytes) -> None:
        """A new file, there whole or not at all: written beside and then renamed."""
        beside = self._path(f".{name}-{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        out.write(bytearray(content))
        out.close()
        if self.exists(name):
            self.remove(name)
        if not self._fs.rename(beside, self._path(name)):
            raise OSError(f"could not name {self.at(name)}")

    def read(self, name: str) -> bytes:
        """A small file, by Spark's reader."""
        return bytes(self.spark.read.format("binaryFile").load(self.at(name)).select("content").first()[0])

    def move(self, name: str, to: str) -> None:
        self.remove(to)
        if not self._fs.rename(self._path(name), self._path(to)):
            raise OSError(f"could not move {self.at(name)}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class Versions:
    """Numbered versions of something; the highest that has a marker is current.

    A marker is a file of its own that is renamed into place after its version was
    written, and none is ever overwritten, so at any time a reader finds a version
    that is whole. The version before the current one is kept for those that read
    it; older ones are removed.
    """

    _MARKER = re.compile(r"v(\d+)\.json")

    def __init__(self, folder: Folder) -> None:
        self.folder = folder

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for m in map(self._MARKER.fullmatch, self.folder.names()) if m)

    def current(self) -> dict | None:
        numbers = self.numbers()
        return json.loads(self.folder.read(f"v{numbers[-1]}.json")) if numbers else None

    def place(self, number: int) -> str:
        """Where a version's rows go."""
        return self.folder.at(f"v{number}")

    def name(self, number: int, about: dict) -> None:
        """Make a version current."""
        self.folder.write(f"v{number}.json", json.dumps(about).encode())
        for n in self.numbers()[:-2]:
            self.folder.remove(f"v{n}.json")
            self.folder.remove(f"v{n}")
