"""Balanced partitioning of sequences; sequential within a batch, so each batch is one group."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def workload(length: Column) -> Column:
    """Cost of a sequence: linear and quadratic part of a large decoder."""
    return 24576 * length + length * length


def karmarkar_karp(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Largest differencing: the two most uneven partial solutions are merged, largest part with smallest.

    Parts compare by sum, number and members; of equally uneven solutions the one with the larger first part comes first.
    """
    order = sorted((s, i) for i, s in enumerate(sizes))
    if equal and len(order) % k:
        raise ValueError(f"{len(order)} items can't make {k} equal parts")

    def rank(part):
        return part[0], len(part[1]), part[1]

    def entry(parts):
        parts = sorted(parts, key=rank, reverse=True)
        total, members = parts[0]
        return parts[-1][0] - total, -total, -len(members), [(-i, -s) for i, s in members], parts

    step = k if equal else 1
    heap = []
    for at in range(0, len(order), step):
        parts = [(s, [(i, s)]) for s, i in order[at : at + step]]
        heap.append(entry(parts + [(0, [])] * (k - len(parts))))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[-1], heapq.heappop(heap)[-1]
        heapq.heappush(heap, entry([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)]))
    return [[i for i, _ in part[1]] for part in heap[0][-1]] if heap else [[] for _ in range(k)]


def least_loaded(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Each item in turn goes to the least loaded part, the first of equals; ``equal`` puts numbers before sizes."""
    bias = sum(sizes) + 1 if equal else 0
    heap = [(0, j) for j in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i, s in enumerate(sizes):
        load, j = heapq.heappop(heap)
        parts[j].append(i)
        heapq.heappush(heap, (load + s + bias, j))
    if equal and any(len(p) * k != len(sizes) for p in parts):
        raise ValueError("parts can't be equal")
    return parts


def balance(df: DataFrame, batch: str, size: str, k: int, equal: bool = False, method: str = "karmarkar_karp", key: str = "row_id") -> DataFrame:
    """``part`` of each row within its batch, rows being taken in order of ``key``, which names a row within its batch."""
    split = {"karmarkar_karp": karmarkar_karp, "least_loaded": least_loaded}[method]

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable").reset_index(drop=True)
        part = [0] * len(rows)
        for j, members in enumerate(split([int(x) for x in rows["size_"]], k, equal)):
            for i in members:
                part[i] = j
        return pd.DataFrame({batch: rows[batch], key: rows[key], "part": part})

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in (batch, key)]
    placed = df.select(batch, key, F.col(size).cast("bigint").alias("size_")).groupBy(batch).applyInPandas(assign, f"{', '.join(kinds)}, part int")
    return df.join(placed, [batch, key])


def group_balance(df: DataFrame, batch: str, group: str, size: str, k: int, key: str = "row_id") -> DataFrame:
    """As balance, with runs of equal neighbouring groups kept together and equally many runs in each part."""
    from .sequences import run_counter

    runs = run_counter(df, group, key, [batch], "in_run_")
    w = Window.partitionBy(batch).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("run_no_", F.sum((F.col("in_run_") == 0).cast("bigint")).over(w)).drop("in_run_")
    sums = runs.groupBy(batch, "run_no_").agg(F.sum(workload(F.col(size))).alias("size_"), F.min(key).alias("first_"))
    parts = balance(sums.withColumnRenamed("first_", "row_id_"), batch, "size_", k, True, key="row_id_").select(batch, "run_no_", "part")
    return runs.join(parts, [batch, "run_no_"]).drop("run_no_")


def micro_batch_count(total: int, rows: int, most_tokens: int, least: int = 1, multiple: int = 1) -> int:
    n = max(min(rows, -(-total // most_tokens)), least)
    return -(-n // multiple) * multiple


def order_parts(loads: DataFrame, part: str = "part", load: str = "load") -> DataFrame:
    """Place of each part so that small ones are at both ends: by load descending, every second reversed, then the others."""
    w = Window.partitionBy().orderBy(F.desc(load), part)
    ranked = loads.withColumn("rank_", F.row_number().over(w) - 1).withColumn("n_", F.count("*").over(Window.partitionBy()))
    evens = F.ceil(F.col("n_") / 2)
    place = F.when(F.col("rank_") % 2 == 0, evens - 1 - F.col("rank_") / 2).otherwise(evens + (F.col("rank_") - 1) / 2)
    return ranked.withColumn("place", place.cast("int")).drop("rank_", "n_")


def ceildiv(a: Column, b: Column) -> Column:
    return F.ceil(a / b)


def round_up(a: Column, b: Column) -> Column:
    return (F.floor((a + b - 1) / b) * b).cast("bigint")


def batch_multiple(ranks: int, mini_batches: int, n: int) -> int:
    return math.lcm(ranks, mini_batches * n)


def dynamic_batches(df: DataFrame, batch: str, length: str, most_tokens: int, least: int = 1, multiple: int = 1, balanced: bool = True, key: str = "row_id") -> DataFrame:
    """``micro`` (number of the micro-batch) and ``place`` in it for each row of each batch.

    Micro-batches are balanced by workload, as many as the tokens ask for; with ``balanced`` the small ones are at both
    ends. A batch is one group, as its rows are partitioned one after another.
    """

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable").reset_index(drop=True)
        lengths = [int(x) for x in rows["size_"]]
        loads = [24576 * x + x * x for x in lengths]
        n = micro_batch_count(sum(lengths), len(lengths), most_tokens, least, multiple)
        if n > len(lengths):
            raise ValueError(f"{n} micro-batches for {len(lengths)} rows")
        parts = [sorted(p) for p in karmarkar_karp(loads, n)]
        parts.sort(key=lambda p: p[0] if p else len(lengths))
        if balanced:
            parts.sort(key=lambda p: (sum(loads[i] for i in p), p[0] if p else 0), reverse=True)
            parts = parts[::2][::-1] + parts[1::2]
        where = {i: (j, k) for j, p in enumerate(parts) for k, i in enumerate(p)}
        return pd.DataFrame({batch: rows[batch], key: rows[key], "micro": [where[i][0] for i in range(len(rows))], "place": [where[i][1] for i in range(len(rows))]})

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in (batch, key)]
    placed = df.select(batch, key, F.col(length).cast("bigint").alias("size_")).groupBy(batch).applyInPandas(assign, f"{', '.join(kinds)}, micro int, place int")
    return df.join(placed, [batch, key])


def restore_order(df: DataFrame, batch: str, positions: DataFrame, key: str = "row_id") -> DataFrame:
    """Results that are numbered by micro-batch (``micro``, ``place``) get back their rows' ``key`` from ``positions``.

    Every result must have a position and every position a result.
    """
    both = positions.select(batch, "micro", "place", key).withColumn("asked_", F.lit(1)).join(df.withColumn("given_", F.lit(1)), [batch, "micro", "place"], "full")
    whole = F.when(F.col("asked_").isNotNull() & F.col("given_").isNotNull(), True).otherwise(F.raise_error(F.lit("results and positions differ")).cast("boolean"))
    return both.where(whole).drop("asked_", "given_", "micro", "place")
