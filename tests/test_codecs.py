"""The string codecs on whole strings, held against plain Python."""

import sys

import pytest

from chronocell.catalogue import QUERIES
from chronocell.functions import codecs

sys.set_int_max_str_digits(0)
SF = "/root/testdata/sf0.001"


def number(s):
    return None if s is None else str(sum(ord(c) * 0x110000**i for i, c in enumerate(reversed(s))))


def test_long_bigint_takes_whole_strings(spark):
    texts = ["", "A", "AB", "Customer#000000001", "Customer#000000002", "é😀z", "x" * 2000, None]
    found = spark.createDataFrame([(t,) for t in texts], "s string").select("s", codecs.long_bigint("s").alias("n")).collect()
    assert [r.n for r in found] == [number(t) for t in texts] and found[2].n == "72417346"
    with pytest.raises(Exception, match="longer than 2000"):
        spark.createDataFrame([("x" * 2001,)], "s string").select(codecs.long_bigint("s")).collect()


def test_codec_bigint_whole_tells_all_names_apart(spark):
    names = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    found = {r.c_custkey: r.number for r in QUERIES["codec_bigint_whole"](spark, SF).collect()}
    assert found == {k: number(v) for k, v in names.items()} and len(set(found.values())) == len(set(names.values()))
