"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import atexit
import math
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_OWN_DIRS: dict[str, str] = {}
#: Masters whose only executor is the driver's process.
_LOCAL = re.compile(r"local(\[[^\]]*\])?")
#: Most ids (about 16 MB) that are broadcast to spare the other side a shuffle.
BROADCAST_IDS = 500_000
#: Most rows of a few narrow columns (about 10 MB) that are broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, whose executor is the driver's own
    process, may go without and gets a temporary folder, one for the whole application; any other master raises, as
    executors would write rows to disks that nobody else reads.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        master = spark.sparkContext.master
        if not _LOCAL.fullmatch(master):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share; master is {master}")
        application = spark.sparkContext.applicationId
        if application not in _OWN_DIRS:
            _OWN_DIRS[application] = "file://" + tempfile.mkdtemp(prefix="millrace-")
        found = _OWN_DIRS[application]
    return found.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and an executor
    that is lost later costs nothing. The folder goes when ``release`` is called or the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{os.getpid()}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def release(*written: DataFrame) -> None:
    """Drop the folders of results of ``materialize`` that no later plan reads."""
    for df in written:
        _drop(df.sparkSession, df._written)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def limited_to(df: DataFrame, column: Column | str, wanted: DataFrame, how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``df`` whose ``column`` (bigint) is among the distinct ids ``wanted``, a table with one column.

    Up to ``most`` ids are sent to every task, so that ``df`` isn't shuffled; more are joined by shuffle.
    """
    column = F.col(column) if isinstance(column, str) else column
    small = wanted.limit(most + 1).count() <= most
    return df.join(F.broadcast(wanted) if small else wanted, column == F.col(wanted.columns[0]), how)


def without(df: DataFrame, column: Column | str, unwanted: DataFrame) -> DataFrame:
    """The other rows, those with a null included."""
    return limited_to(df, column, unwanted, "left_anti")


def rank_among(marks: list, value: Column) -> Column:
    """How many of the sorted ``marks`` are at most ``value``: a coarse search, then one within its part."""
    if not marks:
        return F.lit(0)
    step = max(1, math.isqrt(len(marks)))
    parts = [marks[at : at + step] for at in range(0, len(marks), step)]

    def within(part: list) -> Column:
        return F.size(F.filter(F.array(*[F.lit(m) for m in part]), lambda m: m <= value))

    coarse = within([p[0] for p in parts])
    fine = F.size(F.filter(F.element_at(F.array(*[F.array(*[F.lit(m) for m in p]) for p in parts]), F.greatest(coarse, F.lit(1))), lambda m: m <= value))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def replace_column(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with ``name`` last; a column of that name (in any case) that was there is replaced."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()], value.alias(name))
