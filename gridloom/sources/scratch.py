"""Folders for intermediate tables: below spark.checkpoint.dir, which all executors share; a local one only where that is unset."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    where = spark._jvm.org.apache.hadoop.fs.Path(base)  # a path without a scheme is one of the default file system
    base = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return f"{re.sub('^file:/+', 'file:///', base).rstrip('/')}/{name}-{uuid.uuid4().hex}"
