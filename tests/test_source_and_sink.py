"""The range stream across restarts, and the sink that writes to all targets or none."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.sources import metric_sink, range_stream


def test_rows_come_once(spark, tmp_path):
    df = spark.range(103).select((F.col("id") * 7 % 103).cast("string").alias("name"))
    out = range_stream.read_rows_once(spark, df, "name", f"file://{tmp_path}", 20).collect()
    assert sorted(r["name"] for r in out) == sorted(str(k) for k in range(103))
    assert [sum(r["batch_no"] == b for r in out) for b in range(6)] == [20, 20, 20, 20, 20, 3]
    again = range_stream.read_rows_once(spark, df, "name", f"file://{tmp_path}", 20).collect()  # all has been given out
    assert len(again) == 103


def test_ledger_ahead_of_the_stream(tmp_path):
    """A driver that ends between ledger and offset log leaves a longer range, not a gap."""
    first = range_stream._RangeReader(100, 30, 4, f"file://{tmp_path}/l")
    assert first.initialOffset() == {"row": 0} and first.latestOffset() == {"row": 30}
    second = range_stream._RangeReader(100, 30, 4, f"file://{tmp_path}/l")
    end = second.latestOffset()
    assert end == {"row": 60}
    got = [k for p in second.partitions({"row": 0}, end) for b in second.read(p) for k in b.column(0).to_pylist()]
    assert got == list(range(60)) and second.partitions(end, end) == []


def test_backlog_in_few_batches(spark, tmp_path):
    """The number of micro-batches grows with the digits of the backlog, that of ranges with its rows."""
    out = range_stream.read_rows_once(spark, spark.range(1003).withColumnRenamed("id", "k"), "k", f"file://{tmp_path}", 10)
    assert {(r["batch_no"], r["n"]) for r in out.groupBy("batch_no").agg(F.count("*").alias("n")).collect()} == {*((b, 10) for b in range(100)), (100, 3)}
    assert out.where(F.col("batch_no") != F.floor(F.col("k") / 10)).count() == 0
    assert [p.name for p in sorted(Path(tmp_path, "out").glob("micro_batch=*"))] == [f"micro_batch={n}" for n in range(4)]


def test_all_targets_or_none(spark, tmp_path):
    targets = [f"file://{tmp_path}/a.jsonl", f"file://{tmp_path}/b"]
    df = spark.range(50).select(F.col("id").alias("step"), F.lit("loss").alias("key"), (F.col("id") / 8).alias("value")).repartition(3)
    metric_sink.write_metrics(df, targets)
    metric_sink.write_metrics(df.limit(5), targets, "second")
    metric_sink.write_metrics(df.limit(7), targets, "second")
    for t in targets:
        assert metric_sink.read_metrics(df, t).count() == 57
    hidden = lambda: [p for p in Path(tmp_path).rglob("*") if p.name.startswith(("_staged", "_former"))]
    assert not hidden()
    broken = df.withColumn("value", F.when(F.col("step") == 49, F.raise_error(F.lit("no metric")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no metric"):
        metric_sink.write_metrics(broken, targets, "third")
    before = hidden()  # of tasks that outlived the job, if any
    (Path(tmp_path) / "b" / "job=fourth").write_text("in the way")  # the second target can't be renamed to
    with pytest.raises(Exception):  # noqa: B017, PT011
        metric_sink.write_metrics(df, targets, "fourth")
    (Path(tmp_path) / "b" / "job=fourth").unlink()
    for t in targets:
        assert metric_sink.read_metrics(df, t).count() == 57
    assert hidden() == before
    metric_sink.write_metrics(df.limit(0), targets, "empty")
    assert {r["job"] for r in metric_sink.read_metrics(df, targets[1]).select("job").distinct().collect()} >= {"second"}


def test_stream_writes_each_batch_once(spark, tmp_path):
    spark.dataSource.register(metric_sink.MetricSink)
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    target = f"file://{tmp_path}/out"
    for checkpoint in ("c", "d"):  # the same batches again, under the same numbers
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = stream.writeStream.format("metric_sink").option("targets", f'["{target}"]').option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
        query.awaitTermination(60)
    read = spark.read.schema("id bigint, job string").parquet(target)
    assert sorted(r["id"] for r in read.collect()) == list(range(30)) and read.select("job").distinct().count() == 3
