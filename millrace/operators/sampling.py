"""Seeded sampling that does not depend on partitioning: hashes take the place of a random generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batch import hashed, hashed_int
from .ordered import first_rows, number_rows, number_within


def exact_sample(df: DataFrame, n: int, seed, *keys: str) -> DataFrame:
    """``n`` rows at most, without replacement."""
    return first_rows(df, n, hashed(seed, *keys), *keys)


def weights(df: DataFrame, score: str, method: str, power: float = 2.0, out: str = "w") -> DataFrame:
    """Resampling weights: ``pow`` of the size, ``max_min`` (extremes 1, others 0) or ``max_random`` (extremes 0.4, others 0.1)."""
    if method == "pow":
        return df.withColumn(out, F.pow(F.abs(score), power) + 1e-8)
    ends = df.agg(F.min(score).alias("low_"), F.max(score).alias("high_"))
    extreme = (F.col(score) == F.col("low_")) | (F.col(score) == F.col("high_"))
    high, low = {"max_min": (1.0, 0.0), "max_random": (0.4, 0.1)}[method]
    joined = df.join(F.broadcast(ends))  # one row
    return joined.withColumn(out, F.when(extreme, high).otherwise(low) + 1e-8).drop("low_", "high_")


def resample(df: DataFrame, key: str, weight: str, draws: int, seed) -> DataFrame:
    """``draws`` rows with replacement, in proportion to their weights: ``k`` counts the draws.

    Draws fall into the rows' bins of the running weight. Running sums are taken in buckets of the key's order and within
    them, and draws and rows of a bucket are passed through once, in order of position: no task holds all rows, and no draw
    is compared with rows other than its own.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = sorted(set(df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m <= F.col(key))) if marks else F.lit(0)
    dealt = df.withColumn("bucket_", bucket)
    sums = dealt.groupBy("bucket_").agg(F.sum(weight).alias("sum_"))
    before = Window.partitionBy().orderBy("bucket_")
    spans = sums.select("bucket_", (F.sum("sum_").over(before) - F.col("sum_")).alias("from_"), F.sum("sum_").over(before).alias("to_"), F.sum("sum_").over(Window.partitionBy()).alias("all_"))
    unit = hashed_int(seed, "k") / F.lit(4294967296.0)
    drawn = df.sparkSession.range(draws).withColumnRenamed("id", "k").withColumn("u_", unit)
    placed = drawn.join(F.broadcast(spans), (F.col("u_") * F.col("all_") >= F.col("from_")) & (F.col("u_") * F.col("all_") < F.col("to_")))  # a row a bucket
    within = Window.partitionBy("bucket_").orderBy(key)
    bins = dealt.withColumn("high_", F.sum(weight).over(within)).withColumn("at_", F.coalesce(F.lag("high_").over(within), F.lit(0.0)))
    rows = bins.select("bucket_", "at_", F.lit(0).alias("turn_"), F.struct(*[F.col(c) for c in df.columns]).alias("row_"), F.col(key).alias("key_"))
    asked = placed.select("bucket_", (F.col("u_") * F.col("all_") - F.col("from_")).alias("at_"), F.lit(1).alias("turn_"), "k")
    along = Window.partitionBy("bucket_").orderBy("at_", "turn_", "key_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.unionByName(asked, allowMissingColumns=True).withColumn("row_", F.last("row_", ignorenulls=True).over(along)).where("turn_ = 1")
    return met.select("k", "row_.*")


def allocate(df: DataFrame, task: str, total: int, seed, key: str) -> DataFrame:
    """``total`` rows, dealt round-robin over tasks that still have some; ``rank_in_task`` counts from 1.

    Each task's rows are numbered by ranges, so a task may have any number of them.
    """
    ranked = number_within(df.withColumn("draw_", hashed(seed, key)), [task], "draw_", key, out="rank_in_task")
    some = ranked.where(F.col("rank_in_task") < total).drop("draw_").withColumn("rank_in_task", (F.col("rank_in_task") + 1).cast("int"))
    return first_rows(some, total, "rank_in_task", task)


def stratified(df: DataFrame, positive: str, n: int, ratio: float, seed, key: str) -> DataFrame:
    """``n`` rows without replacement, ``round(n * ratio)`` of them positive as far as there are enough of either kind."""
    counts = {r[0]: r[1] for r in df.groupBy(F.coalesce(F.col(positive), F.lit(False))).count().collect()}  # two rows
    have, others = counts.get(True, 0), counts.get(False, 0)
    want = min(round(n * ratio), have)
    rest = min(n - want, others)
    want = min(have, want + max(0, n - want - rest))
    kind = F.coalesce(F.col(positive), F.lit(False))
    return exact_sample(df.where(kind), want, seed, key).unionByName(exact_sample(df.where(~kind), rest, seed, key))


def keep_traced(df: DataFrame, sample: str, most: int, seed) -> DataFrame:
    """All rows of at most ``most`` sample ids."""
    ids = df.select(sample).distinct().orderBy(hashed(seed, sample), sample).limit(most)
    return df.join(ids, sample, "left_semi")


def curriculum(df: DataFrame, scores: DataFrame, key: str, seed, score: str = "score") -> DataFrame:
    """``place`` of each row in the next epoch: rows whose last score is lowest come first, unscored ones before all.

    ``scores`` (key, step, score) grows with each finished batch; the last step's score of a key counts.
    """
    last = scores.groupBy(key).agg(F.max_by(score, "step").alias("last_"))
    joined = df.join(last, key, "left").withColumn("sort_", F.coalesce("last_", F.lit(float("-inf")))).withColumn("draw_", hashed_int(seed, key))
    return number_rows(joined, "sort_", "draw_", key, out="place").drop("last_", "sort_", "draw_")
