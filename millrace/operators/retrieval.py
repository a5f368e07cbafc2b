"""Nearest vectors, as-of joins and rows picked by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import last_before

#: Queries of a block, on average, and rows of a chunk at most.
QUERY_BLOCK, ROW_CHUNK = 1024, 4096
#: Most queries that are broadcast (8 MB at 256 numbers a vector); more are dealt over tasks by shuffle.
BROADCAST_QUERIES = 4096


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query, ``key``, similarity) of the ``k`` rows most alike each query by cosine, the query's own key apart.

    Rows are packed into chunks, queries into blocks, and each chunk meets each block once, where the best ``k`` of the chunk
    are kept for each query; the best of all chunks follow. The rows are read once. Of equally similar rows the
    smallest key comes first. Null vectors and vectors of zeros are like nothing.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("query"), F.col(vector).cast("array<double>").alias("v"))
    n = asked.count()
    blocks, few = max(1, -(-n // block)), n <= BROADCAST_QUERIES
    packed = asked.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(F.collect_list("query").alias("queries"), F.flatten(F.collect_list("v")).alias("asked"))
    source = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    chunks = source.mapInArrow(_chunks, "keys array<bigint>, vectors array<double>").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    if few:
        met = chunks.join(F.broadcast(packed), "block")
    else:
        salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = packed.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = chunks.withColumn("salt_", F.pmod(F.xxhash64("keys"), F.lit(salts)).cast("int")).join(spread, ["block", "salt_"])
    found = met.select("queries", "asked", "keys", "vectors").mapInArrow(_best(k), "query bigint, key bigint, similarity double")
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    ranked = found.withColumn("rank_", F.row_number().over(best)).where(F.col("rank_") <= k).drop("rank_")
    return ranked.select("query", F.col("key").alias(key), "similarity")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.float64())]
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_CHUNK):
            part = batch.slice(at, ROW_CHUNK)
            columns = [part.column(0), part.column(1).flatten()]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(c)], c).cast(t) for c, t in zip(columns, kinds, strict=True)], ["keys", "vectors"])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-300)


def _best(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own, asked, keys, vectors = (batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in range(4))
                similar = _unit(asked.reshape(len(own), -1)) @ _unit(vectors.reshape(len(keys), -1)).T
                similar = np.round(similar, 12)
                similar[own[:, None] == keys[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(keys, similar.shape), -similar), axis=1)[:, :k]
                top = np.take_along_axis(similar, order, axis=1)
                q, place = np.nonzero(np.isfinite(top))
                yield pa.RecordBatch.from_arrays([pa.array(own[q], pa.int64()), pa.array(keys[order[q, place]], pa.int64()), pa.array(top[q, place])], names=["query", "key", "similarity"])

    return scan


def as_of(df: DataFrame, key: str, order: str, asking: Column, answering: Column, value: Column, out: str) -> DataFrame:
    """The asking rows with ``out``: ``value`` of the last answering row of their key before them.

    An answer counts for questions of later times only: of rows with equal times, those that ask come first. Of answers at
    the same time the one with the largest value counts. A value of null is no answer; null keys are a key. Rows that are
    neither go first; the others are dealt into ranges of key and time whose last answers are carried on, so that a key may
    have any number of rows.
    """
    kept = df.where(asking | answering).withColumn("asks_", F.coalesce(asking, F.lit(False))).withColumn("value_", F.when(answering, value))
    found = last_before(kept, [key], [order, F.desc("asks_"), F.asc_nulls_first("value_")], F.col("value_"), out)
    return found.where("asks_").drop("asks_", "value_")


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, found by aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row_")).select(*keys, "row_.*")


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The rows at the end of each key's order."""
    last = df.groupBy(F.col(key).alias("key_")).agg(F.max(order).alias("last_"))
    return df.join(last, (F.col(key) == F.col("key_")) & (F.col(order) == F.col("last_")), "left_semi")


def mixed_groups(df: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of groups whose values differ."""
    mixed = df.groupBy(key).agg(F.min(value).alias("low_"), F.max(value).alias("high_")).where("low_ < high_").select(key)
    return df.join(mixed, key, "left_semi")


def last_answers(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The assistant's last text of each conversation, and whether a tool spoke in it."""
    own = F.col(role) == "assistant"
    return df.groupBy(key).agg(F.max_by(F.when(own, F.col(text)), F.when(own, F.col(order))).alias("answer"), F.max((F.col(role) == "tool").cast("int")).alias("tool_reward"))
