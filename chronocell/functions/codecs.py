"""String to number codecs as column expressions; only the unbounded one needs Python."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .grid import djb2

CODE_POINTS, LONGEST = 0x110000, 2000


def md5_words(s: Column) -> Column:
    """The digest as four little-endian signed 32-bit integers."""

    def word(i: int) -> Column:
        hexed = F.concat(*[F.substring(F.md5(s), 8 * i + 2 * b + 1, 2) for b in (3, 2, 1, 0)])
        n = F.conv(hexed, 16, 10).cast("long")
        return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")

    return F.array(*[word(i) for i in range(4)])


def tag_split(s: Column) -> Column:
    """The number after `Tag` (null if there is none, or none that fits 64 bits), else the DJB2 hash."""
    number = F.regexp_extract(s, r"^Tag\s*([+-]?\d+)", 1)
    return F.when(s.startswith("Tag"), number.try_cast("long")).otherwise(djb2(s))


def code_points(s: Column) -> Column:
    return F.when(F.length(s) == 0, F.expr("cast(array() as array<int>)")).otherwise(F.transform(F.split(s, ""), lambda c: F.ascii(c)))


def short_bigint(s: Column) -> Column:
    """The code points as one number to base 0x110000, exact for up to six characters."""
    base = F.lit(CODE_POINTS).cast("decimal(38,0)")
    digits = F.transform(code_points(s), lambda c: c.cast("decimal(38,0)"))
    return F.aggregate(digits, F.lit(0).cast("decimal(38,0)"), lambda h, c: (h * base + c).cast("decimal(38,0)"))


@F.pandas_udf(StringType())
def long_bigint(s: pd.Series) -> pd.Series:
    """The same for any length up to LONGEST, as decimal text."""

    def one(x):
        if x is None:
            return None
        if len(x) > LONGEST:
            raise ValueError(f"longer than {LONGEST} characters")
        n = 0
        for c in x:
            n = n * CODE_POINTS + ord(c)
        return format(Decimal(n), "f")  # str() of an int ends at 4,300 digits

    return s.map(one)


#: The codecs by name, for callers that take one as a setting.
STRING_TO_NUMBER = {"MD5": md5_words, "DJB2": djb2, "StringSplit": tag_split}
STRING_TO_BIGINT = {"UnicodeToUint32Array": code_points, "StringToBigint": long_bigint}


def format_kb(x: Column) -> Column:
    return x / 1024


def format_mb(x: Column) -> Column:
    return format_kb(x) / 1024


def format_gb(x: Column) -> Column:
    return format_mb(x) / 1024
