"""Where a grid's files lie and in which format: the storage interface, and files beside them that hold small facts."""

from __future__ import annotations

import json
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Files:
    """The few file operations a grid needs, by Hadoop's client, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession, base: str):
        self.base = base.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        return self._path(f"{self.base}/{name}" if name else self.base)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(name))) if self.exists(name) else []

    def read(self, name: str) -> dict:
        stream = self._fs.open(self.at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, facts: dict) -> None:
        """All of a file or none: it is written aside and renamed."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self.at(aside), True)
        try:
            stream.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
        finally:
            stream.close()
        if not self.rename(aside, name):
            self.delete(aside)
            if not self.exists(name):
                raise OSError(f"{self.base}/{name} could not be written")

    def rename(self, source: str, target: str) -> bool:
        return bool(self._fs.rename(self.at(source), self.at(target)))

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def mkdirs(self, name: str = "") -> None:
        self._fs.mkdirs(self.at(name))


class Storage(Protocol):
    """How samples with tag_bucket and time_bucket columns are appended to a base and read from it; read gives None for a base without data."""

    def append(self, placed: DataFrame, base: str, rows_per_file: int) -> None: ...

    def read(self, spark: SparkSession, base: str, schema: str) -> DataFrame | None: ...


class FileStorage:
    """Partitioned files of one of Spark's columnar formats."""

    def __init__(self, format: str = "parquet", **options: str):
        self.format, self.options = format, options

    def append(self, placed: DataFrame, base: str, rows_per_file: int) -> None:
        placed.write.mode("append").format(self.format).options(**self.options).option("maxRecordsPerFile", rows_per_file).partitionBy("tag_bucket", "time_bucket").save(base)

    def read(self, spark: SparkSession, base: str, schema: str) -> DataFrame | None:
        if not any(n.startswith("tag_bucket=") for n in Files(spark, base).names()):
            return None
        return spark.read.schema(schema).format(self.format).load(base)
