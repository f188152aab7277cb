"""A table that is replaced as a whole: readers see the old rows or the new ones, never a part of either.

Each replacement is a folder of Parquet files of its own, and counts from the moment that its numbered
marker, an empty file, exists. Readers take the highest marker. A write that fails, or loses its driver, leaves no
marker; the next one clears what it left. The folder must be one that driver and executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_MARKER = "current-"


class ReplacedTable:
    """A table in `folder`; the last `keep` replacements stay for readers that began on them."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder, keep
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        self._fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        if not self._fs.exists(self._path(".")):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._path("."))]

    def _markers(self) -> list[tuple[int, str]]:
        """(number, version) of all replacements that count, oldest first."""
        found = [n.removeprefix(_MARKER).split("-", 1) for n in self._names() if n.startswith(_MARKER)]
        return sorted((int(k), version) for k, version in found)

    def replace(self, rows: DataFrame) -> None:
        """Puts `rows` in the table's place; they may be made of what the table holds now."""
        markers = self._markers()
        version = f"v{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{version}")
        number = markers[-1][0] + 1 if markers else 1
        self._fs.create(self._path(f"{_MARKER}{number:09d}-{version}"), False).close()
        self._clear()

    def _clear(self) -> None:
        """Drops replacements beyond those kept, markers first, and what failed writes left."""
        markers = self._markers()
        for number, version in markers[: -self.keep]:
            self._fs.delete(self._path(f"{_MARKER}{number:09d}-{version}"), False)
        kept = {version for _, version in markers[-self.keep :]}
        for name in self._names():
            if name.startswith("v") and name not in kept:
                self._fs.delete(self._path(name), True)

    def read(self) -> DataFrame:
        """The rows of the last replacement."""
        markers = self._markers()
        if not markers:
            raise FileNotFoundError(f"{self.folder} holds no table yet")
        return self.spark.read.parquet(f"{self.folder}/{markers[-1][1]}")
