"""The canonical sample row and helpers to get to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("tag_id", T.LongType(), False),
        T.StructField("sample_time", T.LongType(), False),
        T.StructField("insert_time", T.LongType(), False),
        T.StructField("n_value", T.DoubleType()),
        T.StructField("o_value", T.StringType()),
        T.StructField("ingest_seq", T.LongType()),
    ]
)


@dataclass(frozen=True)
class GridSchema:
    """Names of the columns that a table of samples uses; insert and sequence may be missing from a table."""

    tag: str = "tag_id"
    time: str = "sample_time"
    insert: str = "insert_time"
    n_value: str = "n_value"
    o_value: str = "o_value"
    sequence: str = "ingest_seq"

    def _pairs(self) -> list[tuple[str, str]]:
        return [(self.tag, "tag_id"), (self.time, "sample_time"), (self.insert, "insert_time"), (self.n_value, "n_value"), (self.o_value, "o_value"), (self.sequence, "ingest_seq")]

    def to_samples(self, df: DataFrame) -> DataFrame:
        """A table with these names as samples; columns of other names are left out."""
        missing = {self.tag, self.time} - set(df.columns)
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")
        kinds = {f.name: f.dataType for f in SAMPLE_SCHEMA}
        return df.select(*[F.col(f"`{own}`").cast(kinds[name]).alias(name) for own, name in self._pairs() if own in df.columns])

    def from_samples(self, df: DataFrame) -> DataFrame:
        """Samples under these names."""
        return df.withColumnsRenamed({name: own for own, name in self._pairs()})


def flat_records(spark: SparkSession, records: dict[int, list]) -> DataFrame:
    """{tag: [time, ignored, n_value, o_value, time, ...]} -> samples in order of arrival, without insert_time."""
    rows, seq = [], 0
    for tag, flat in records.items():
        if len(flat) % 4:
            raise ValueError(f"records of tag {tag} are not a multiple of 4 long")
        for i in range(0, len(flat), 4):
            time, _, n, o = flat[i : i + 4]
            if time is None or int(time) != time:
                raise ValueError(f"sample time {time!r} of tag {tag} is not a whole number")
            rows.append((int(tag), int(time), None if n is None else float(n), o, seq))
            seq += 1
    return spark.createDataFrame(rows, "tag_id long, sample_time long, n_value double, o_value string, ingest_seq long")


def epoch_ms(ts, zoned: bool = False):
    """Milliseconds since the epoch: of a TIMESTAMP_NTZ column, read as UTC whatever the session's zone, or of a zoned TIMESTAMP."""
    if zoned:
        return F.unix_millis(ts)
    since = ts - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), since).cast("long")
    millis = F.floor(F.extract(F.lit("SECOND"), since) * 1000).cast("long")
    return part("DAY") * 86_400_000 + part("HOUR") * 3_600_000 + part("MINUTE") * 60_000 + millis


def samples(df: DataFrame, tag, time, insert, n_value=None, o_value=None, sequence=None) -> DataFrame:
    """A table of samples from expressions over any table."""
    col = lambda x, kind: (F.lit(None) if x is None else F.col(x) if isinstance(x, str) else x).cast(kind)
    return df.select(col(tag, "long").alias("tag_id"), col(time, "long").alias("sample_time"), col(insert, "long").alias("insert_time"), col(n_value, "double").alias("n_value"), col(o_value, "string").alias("o_value"), (F.lit(0) if sequence is None else F.col(sequence)).cast("long").alias("ingest_seq"))
