"""Results kept as Parquet under a hash of what was asked."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Files


def _canonical(name: str, value):
    """A value as JSON that is equal only for what asks the same: tags lose order and repeats, tables become what they hold."""
    if isinstance(value, DataFrame):
        rows = (value.select("tag_id") if name == "tags" else value).distinct()
        own = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(17), *rows.columns)).alias("x")).first()
        return {"table": [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema], "content": [own.n, str(own.s), own.x]}
    if isinstance(value, (set, frozenset)) or name == "tags":
        return sorted(set(value))
    if isinstance(value, (list, tuple)):
        return [_canonical("", v) for v in value]
    if isinstance(value, dict):
        return {str(k): _canonical("", v) for k, v in value.items()}
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    raise TypeError(f"{name} of type {type(value).__name__} can't be part of a cache key")


def cache_key(**asked) -> str:
    return hashlib.md5(json.dumps({k: _canonical(k, v) for k, v in asked.items()}, sort_keys=True).encode()).hexdigest()


class ResultCache:
    """A result is served while it is as new as the last write; it is kept only once writes have cooled down.

    An entry is a folder of its own under a name that no other has, and counts once it is renamed to that name. The newest
    two entries of a key stay, so that a reader of the one before the last can end.
    """

    def __init__(self, spark: SparkSession, base: str, cool_down: int = 300_000):
        self.spark, self.base, self.cool_down = spark, base.rstrip("/"), cool_down
        self._files = Files(spark, self.base)

    def _entries(self, key: str) -> list[tuple[int, str]]:
        """(time, name), oldest first."""
        return sorted((int(n.split("-")[1]), f"plan-{key}/{n}") for n in self._files.names(f"plan-{key}") if n.startswith("t-"))

    def get(self, key: str, last_write: int) -> DataFrame | None:
        found = [n for t, n in self._entries(key) if t >= last_write]
        return self.spark.read.parquet(f"{self.base}/{found[-1]}") if found else None

    def through(self, key: str, last_write: int, now: int, make: Callable[[], DataFrame], read: bool = True, update: bool = True) -> DataFrame:
        hit = self.get(key, last_write) if read else None
        if hit is not None:
            return hit
        made = make()
        if not update or now - last_write <= self.cool_down:
            return made
        own = uuid.uuid4().hex
        aside, target = f"tmp-{own}", f"plan-{key}/t-{now}-{own}"
        made.write.parquet(f"{self.base}/{aside}")
        self._files.mkdirs(f"plan-{key}")
        if not self._files.rename(aside, target):  # the commit
            self._files.delete(aside)
            raise OSError(f"{self.base}/{target} could not be written")
        for _, name in self._entries(key)[:-2]:
            self._files.delete(name)
        return self.spark.read.parquet(f"{self.base}/{target}")
