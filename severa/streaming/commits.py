"""Commits of batches: files are written first, and one rename makes them count together with the batch's number."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Commits:
    """Numbered JSON files in a folder, each naming all that counts from then on. What a batch wrote before it died is named
    by none of them, so nobody reads it. One writer at a time, with rising numbers, as a stream's batches have."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.jvm, self.path, self.folder = spark.sparkContext._jvm, hadoop.Path, folder
        self.files = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """What lies in a folder; nothing if there is none."""
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self.files.listStatus(path)) if self.files.exists(path) else []

    def last(self) -> tuple[int, dict]:
        """The number and the entry of the last commit; (-1, {}) before the first."""
        numbers = [int(n.removesuffix(".json")) for n in self.names(self.folder) if n.endswith(".json")]
        if not numbers:
            return -1, {}
        stream = self.files.open(self.path(f"{self.folder}/{max(numbers):012d}.json"))
        try:
            return max(numbers), json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def add(self, batch: int, entry: dict) -> None:
        final, new = self.path(f"{self.folder}/{batch:012d}.json"), self.path(f"{self.folder}/{batch:012d}.new")
        if self.files.exists(final):
            raise FileExistsError(f"batch {batch} is committed")
        stream = self.files.create(new, True)
        stream.write(bytearray(json.dumps(entry), "utf8"))
        stream.close()
        if not self.files.rename(new, final):
            raise OSError(f"batch {batch} was not committed")

    def keep_only(self, folder: str, names: set[str]) -> None:
        """Delete what a folder has beside these names."""
        for name in set(self.names(folder)) - names:
            self.files.delete(self.path(f"{folder}/{name}"), True)
