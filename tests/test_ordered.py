"""Order over all rows: any type of key, hot keys, equal first columns, and even tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered, partition, retrieval, sequences
from millrace.streaming import stateful


@pytest.fixture(scope="module")
def rows():
    """(k, t, v, s): a third of all rows have key 0."""
    draw = random.Random(2)
    return [(0 if n % 3 == 0 else draw.choice([None, *range(1, 40)]), n * 7919 % 3001, draw.choice([None, 1, 2, 2]), f"s{n % 700}") for n in range(3000)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k int, t int, v int, s string").repartition(5).persist()


def key_of(x):
    return (x is not None, x or 0)


def test_numbers_by_text_and_nulls(spark, table, rows):
    found = {(r["s"], r["t"]): r["row_id"] for r in ordered.number_rows(table, "s", "t").collect()}
    assert found == {x: n for n, x in enumerate(sorted((r[3], r[1]) for r in rows))}
    by_null = [(r["k"], r["t"]) for r in ordered.number_rows(table, "k", F.desc("t")).orderBy("row_id").collect()]
    assert by_null == [(r[0], r[1]) for r in sorted(rows, key=lambda r: (key_of(r[0]), -r[1]))]
    stamps = spark.range(50).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(1).alias("row_id"))
    assert [r["row_id"] for r in ordered.number_rows(stamps, "ts").orderBy("ts").collect()] == list(range(50))
    assert ordered.number_rows(table.limit(0), "s").columns == ["k", "t", "v", "s", "row_id"] and ordered.number_rows(table.limit(0), "s").count() == 0


@pytest.mark.parametrize("order", [("k", "t"), ("one", "t"), ("one",)])
def test_no_task_has_twice_the_mean(spark, table, order):
    """Neither for a key with a third of all rows nor for a first column that is equal in all of them."""
    dealt = ordered.deal(table.withColumn("one", F.lit(1)), *order)
    sizes = [r["count"] for r in dealt.groupBy("range_").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 3000 and max(sizes) <= 2 * 750
    tasks = dealt.withColumn("n_", F.row_number().over(ordered.along())).withColumn("task_", F.spark_partition_id()).groupBy("task_").count().collect()
    assert max(r["count"] for r in tasks) <= 2 * 750


def test_number_within(table, rows):
    seen, want = {}, {}
    for k, t, _, _ in sorted(rows, key=lambda r: r[1]):
        want[t] = seen.get(k, 0)
        seen[k] = want[t] + 1
    assert {r["t"]: r["place_"] for r in ordered.number_within(table, ["k"], "t").collect()} == want


def test_last_before(table, rows):
    last, want = {}, {}
    for k, t, v, _ in sorted(rows, key=lambda r: r[1]):
        want[t] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    assert {r["t"]: r["x"] for r in ordered.last_before(table, ["k"], ["t"], F.col("v"), "x").collect()} == want


@pytest.mark.parametrize("within", [None, ["k"]])
def test_runs(table, rows, within):
    lines = {}
    for r in rows:
        lines.setdefault(r[0] if within else 0, []).append(r)
    want = {}
    for line in lines.values():
        previous, place = object(), 0
        for r in sorted(line, key=lambda r: r[1]):
            place = place + 1 if r[2] == previous else 0
            previous, want[r[1]] = r[2], place
    assert {r["t"]: r["n"] for r in sequences.run_counter(table, "v", "t", within, "n").collect()} == want


def test_as_of_ties(spark):
    """Whatever the order of rows: a question doesn't see answers of its own time."""
    rows = [(1, 5, "ask", 0.0), (1, 5, "tell", 1.0), (1, 3, "tell", 0.5), (1, 9, "ask", 0.0), (None, 1, "tell", 7.0), (None, 2, "ask", 0.0), (2, 1, "ask", 0.0), (1, 5, "tell", 0.9)]
    for turn in range(4):
        df = spark.createDataFrame(rows[turn:] + rows[:turn], "k int, t int, kind string, v double").repartition(3)
        found = retrieval.as_of(df, "k", "t", F.col("kind") == "ask", F.col("kind") == "tell", F.col("v"), "x").collect()
        assert sorted((key_of(r["k"]), r["t"], r["x"] or -1) for r in found) == [((False, 0), 2, 7.0), ((True, 1), 5, 0.5), ((True, 1), 9, 1.0), ((True, 2), 1, -1)]


def test_hot_queues_and_windows(table, rows):
    for k, line in {k: sorted(r[1] for r in rows if r[0] == k) for k in (0, None, 5)}.items():
        held = stateful.queue_result(table, "k", "t", 10).where(F.col("k").eqNullSafe(F.lit(k).cast("int"))).collect()
        if k is not None:
            assert sorted(r["t"] for r in held) == line[-10:] and {r["dropped"] for r in held} == {len(line) - 10}
        sums = stateful.count_windows(table, "k", "t", 16, F.sum("t").alias("total")).where(F.col("k").eqNullSafe(F.lit(k).cast("int"))).collect()
        assert {r["window"]: r["total"] for r in sums} == {n: sum(line[n * 16 : n * 16 + 16]) for n in range(len(line) // 16)}


def test_row_ids_that_start_anew_in_each_batch(spark):
    df = spark.createDataFrame([(b, r, 10 * r + n + 1) for n, b in enumerate("xy") for r in range(4)], "batch string, row_id int, n int")
    parts = partition.balance(df, "batch", "n", 2)
    assert parts.count() == 8 and {(r["batch"], r["part"]) for r in parts.collect()} == {(b, p) for b in "xy" for p in (0, 1)}
    assert partition.dynamic_batches(df, "batch", "n", 40).count() == 8


def test_first_rows_by_number(table, rows, monkeypatch):
    """A limit of many rows is the same, found by numbers."""
    want = sorted(r["t"] for r in ordered.first_rows(table, 700, "s", "t").collect())
    monkeypatch.setattr(ordered, "LIMITED", 10)
    assert sorted(r["t"] for r in ordered.first_rows(table, 700, "s", "t").collect()) == want == sorted(r[1] for r in sorted(rows, key=lambda r: (r[3], r[1]))[:700])
    assert ordered.first_rows(table, 10_000, "s").count() == 3000
