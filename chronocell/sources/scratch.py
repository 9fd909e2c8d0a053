"""Folders for what a session writes on its way."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local master without that setting gets a folder below its warehouse: on a cluster that may be a machine's own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted by Hadoop's client when the driver ends."""
    path = f"{work_dir(spark).rstrip('/')}/chronocell/{tag}-{uuid.uuid4().hex}"
    files, at = hadoop_path(spark, path)
    files.deleteOnExit(at)
    return path
