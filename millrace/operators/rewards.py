"""Reward managers: rows of scores with their penalties and extras."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..functions.scoring import overlong_penalty, score_at_last

MANAGERS: dict[str, Callable[..., DataFrame]] = {}


def register_manager(name: str):
    def put(f):
        if MANAGERS.get(name, f) is not f:
            raise ValueError(f"manager {name} is registered already")
        MANAGERS[name] = f
        return f

    return put


def manager(name: str) -> Callable[..., DataFrame]:
    if name not in MANAGERS:
        raise ValueError(f"unknown manager {name}; known: {sorted(MANAGERS)}")
    return MANAGERS[name]


@register_manager("naive")
def naive(df: DataFrame, score: Column, reuse: str | None = "rm_scores") -> DataFrame:
    """``reward_tensor`` with the score at the last valid token; scores that are there already are reused."""
    value = score_at_last(score, F.col("mask"))
    return df.withColumn("score", score).withColumn("reward_tensor", F.coalesce(F.col(reuse), value) if reuse and reuse in df.columns else value)


@register_manager("batch")
def batch(df: DataFrame, score: Column) -> DataFrame:
    return naive(df, score).withColumn("acc", F.col("score"))


@register_manager("dapo")
def dapo(df: DataFrame, score: Column, most: int | None = None, buffer: int = 0, factor: float = 1.0) -> DataFrame:
    """Scores less the penalty of over-long responses, which is kept with a flag."""
    length = F.aggregate("mask", F.lit(0), lambda a, v: a + v)
    penalty = overlong_penalty(length, most, buffer, factor) if most and buffer else F.lit(0.0)
    out = df.withColumn("score", score).withColumn("overlong_reward", penalty).withColumn("overlong", F.col("overlong_reward") < 0)
    return out.withColumn("reward_tensor", score_at_last(F.col("score") + F.col("overlong_reward"), F.col("mask")))


@register_manager("gdpo")
def gdpo(df: DataFrame, components: dict[str, Column]) -> DataFrame:
    return df.withColumns(components).withColumn("reward_tensor", score_at_last(sum(components.values(), F.lit(0.0)), F.col("mask")))


@register_manager("prime")
def prime(df: DataFrame, score: Column) -> DataFrame:
    """As batch, a score that failed counting as 0."""
    return batch(df, F.coalesce(score, F.lit(0.0)))


def first_of_each(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """The rows that are shown: the first ``n`` of each source."""
    return df.withColumn("shown_", F.row_number().over(Window.partitionBy(source).orderBy(order))).where(F.col("shown_") <= n).drop("shown_")


class TokenBucket:
    """Refilled at ``rate`` a second up to ``most``; a larger request waits until the debt is paid."""

    def __init__(self, rate: float, most: float | None = None, at: float = 0.0):
        if rate <= 0:
            raise ValueError("rate must be positive")
        self.rate, self.most = rate, most if most is not None else rate
        self.tokens, self.at = self.most, at

    def acquire(self, now: float, n: float = 1.0) -> float:
        """Seconds to wait for ``n`` tokens that are asked for at ``now``."""
        self.tokens = min(self.most, self.tokens + max(0.0, now - self.at) * self.rate)
        self.at = max(now, self.at)
        self.tokens -= n
        return max(0.0, -self.tokens / self.rate)


def rate_limited(df: DataFrame, call: Callable[[str], float], text: str, requests_per_minute: float, tokens_per_minute: float | None = None) -> DataFrame:
    """``reward`` and ``failed`` of an external scorer, each task being limited to its share; a failing call has reward 0."""

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        requests = TokenBucket(requests_per_minute / 60, at=time.monotonic())
        tokens = TokenBucket(tokens_per_minute / 60, at=time.monotonic()) if tokens_per_minute else None
        for part in parts:
            rewards, failed = [], []
            for value in part[text]:
                wait = requests.acquire(time.monotonic())
                if tokens:
                    wait = max(wait, tokens.acquire(time.monotonic(), len(value or "") / 4))
                time.sleep(wait)
                try:
                    rewards.append(float(call(value)))
                    failed.append(False)
                except Exception:  # noqa: BLE001  whatever the service raises
                    rewards.append(0.0)
                    failed.append(True)
            yield part.assign(reward=rewards, failed=failed)

    schema = StructType([*df.schema.fields, StructField("reward", DoubleType()), StructField("failed", BooleanType())])
    return df.mapInPandas(score, schema)


def scattered_scores(df: DataFrame, score: str = "rm_score", mask: str = "mask") -> DataFrame:
    """``rm_scores``: the scorer's value at the last valid token of each row."""
    return df.withColumn("rm_scores", score_at_last(F.col(score), F.col(mask)))


def reward_columns(df: DataFrame, extras: list[str], tensor: str = "rm_scores", key: str = "row_id") -> DataFrame:
    """The key, the rewards and the extra columns of a scored batch."""
    return df.select(key, F.col(tensor).alias("reward_tensor"), *extras)


class ClientError(Exception):
    """An answer of the 4xx kind, after which asking again is of no use."""


def retrying(call: Callable[[str], float], tries: int = 16, most_wait: float = 30.0, sleep: Callable[[float], None] | None = None) -> Callable[[str], float]:
    """``call`` asked up to ``tries`` times, waiting 1, 2, 4 ... seconds between; a ClientError isn't tried again."""

    def ask(value: str) -> float:
        import time

        for k in range(tries):
            try:
                return call(value)
            except ClientError:
                raise
            except Exception:  # noqa: BLE001  whatever the service raises
                if k == tries - 1:
                    raise
                (sleep or time.sleep)(min(2.0**k, most_wait))
        raise ValueError("tries must be positive")

    return ask


@register_manager("visual")
def visual(df: DataFrame, score: Column) -> DataFrame:
    """Scores of images: one reward a row, at its only step."""
    return df.withColumn("score", score).withColumn("reward_tensor", F.array(score))
