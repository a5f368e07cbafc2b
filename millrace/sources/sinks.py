"""Sinks: generation dumps, metric logs, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.batch import hashed


def dump_generations(df: DataFrame, path: str, step: str = "step") -> None:
    """JSON lines in a folder a step."""
    df.write.mode("append").partitionBy(step).json(path)


def generation_rows(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """input, output, gts, score and step of each row, the score being the sum of its tokens', and extra columns."""
    total = F.aggregate("token_level_scores", F.lit(0.0), lambda a, v: a + v)
    return df.select("input", "output", F.col("ground_truth").alias("gts"), total.alias("score"), "step", *(extra or []))


def validation_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(hashed(seed, "input", "output")).limit(n)


def wide_samples(df: DataFrame, n: int) -> DataFrame:
    """One row a step with three columns a sample; samples are numbered from 1 in ``sample``."""
    return df.groupBy("step").pivot("sample", list(range(1, n + 1))).agg(F.first("input").alias("input"), F.first("output").alias("output"), F.first("score").alias("score"))


def metric_rows(df: DataFrame, step: str = "step") -> DataFrame:
    """A row of metrics as a long table (step, key, value)."""
    keys = [c for c in df.columns if c != step]
    return df.unpivot([step], keys, "key", "value")


def metric_json(step: Column, metrics: Column) -> Column:
    return F.to_json(F.struct(step.alias("step"), metrics.alias("data")))


def title_and_series(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, "/", 2)
    return parts[0], F.get(parts, F.lit(1))


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def dump_generation_batch(df: DataFrame, path: str, train_step: int, gen_step: int) -> DataFrame:
    """Store a batch under its generation step and append its line to the index, which is returned.

    The index has line_no (its number of lines before), train_step and gen_step; the batch is written first, so a
    line never names a batch that isn't there.
    """
    from pyspark.errors import AnalysisException

    spark, index = df.sparkSession, f"{path.rstrip('/')}/index"
    df.withColumn("gen_step", F.lit(gen_step)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/gen_step={gen_step}")
    try:
        lines = spark.read.parquet(index).count()
    except AnalysisException:
        lines = 0
    spark.createDataFrame([(lines, train_step, gen_step)], "line_no bigint, train_step int, gen_step int").write.mode("append").parquet(index)
    return spark.read.parquet(index)


def save_pools(df: DataFrame, path: str) -> None:
    """Snapshot of ring pools, which ``load_pools`` reads."""
    df.write.mode("overwrite").parquet(path)
