"""Rows that are read more than once are written to a folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TEMPORARY: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A path that nobody uses yet, under ``spark.checkpoint.dir``; it is dropped when the driver's process ends.

    Only a local session, whose one executor is the driver, may go without that setting and gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _TEMPORARY.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="millrace-")
        _TEMPORARY[spark.sparkContext.applicationId] = root
    path = f"{root.rstrip('/')}/millrace-{os.getpid()}/{label}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def written(df: DataFrame, label: str = "rows") -> DataFrame:
    """``df`` written and read back: its lineage ends here, and an executor that is lost later costs nothing."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
