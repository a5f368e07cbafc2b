"""Stateful operators: bounded queues, ring pools, barriers and count windows, as streams and as their batch results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import number_within
from ..operators.staging import written


def queue_stream(stream: DataFrame, key: str, order: str, payload: str, capacity: int) -> DataFrame:
    """A first-in-first-out queue a key that drops its oldest entry when full; a row a key and micro-batch.

    Returns key, size, produced, dropped and the queue's entries (JSON). State is bounded by ``capacity`` entries a key.
    """
    import json

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, produced, dropped = (json.loads(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, 0)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        for value in rows[payload]:
            if len(held) >= capacity:
                held.pop(0)
                dropped += 1
            held.append(value if isinstance(value, str) else str(value))
            produced += 1
        state.update((json.dumps(held), produced, dropped))
        yield pd.DataFrame({key: [keys[0]], "size": [len(held)], "produced": [produced], "dropped": [dropped], "entries": [json.dumps(held)]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, size bigint, produced bigint, dropped bigint, entries string", "entries string, produced bigint, dropped bigint", "update", GroupStateTimeout.NoTimeout)


def queue_result(df: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """What the queue holds at the end: the last ``capacity`` entries, with the number dropped and their places from the end."""
    counts = df.groupBy(F.col(key).alias("key_")).agg(F.count("*").alias("produced"))
    kept = number_within(df, [key], F.desc(order), out="from_end_").where(F.col("from_end_") < capacity)
    joined = kept.join(counts, F.col(key).eqNullSafe(F.col("key_"))).withColumn("dropped", F.greatest(F.col("produced") - capacity, F.lit(0)))
    return joined.drop("from_end_", "key_")


def count_window_stream(stream: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """Sums of full windows of ``size`` arrivals a key; a short tail waits for more."""

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, n, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        for v in pd.concat(list(parts)).sort_values(order, kind="stable")[value]:
            n, total = n + 1, total + float(v)
            if n == size:
                out.append((keys[0], number, total))
                number, n, total = number + 1, 0, 0.0
        state.update((number, n, total))
        yield pd.DataFrame(out, columns=[key, "window", "total"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, window bigint, total double", "number bigint, n bigint, total double", "append", GroupStateTimeout.NoTimeout)


def count_windows(df: DataFrame, key: str, order: str, size: int, *aggregates: Column) -> DataFrame:
    """Aggregates of the full windows of ``size`` rows a key; a short tail is left out."""
    numbered = number_within(df, [key], order).withColumn("window", F.floor(F.col("place_") / size).cast("bigint")).drop("place_")
    return numbered.groupBy(key, "window").agg(F.count("*").alias("n_"), *aggregates).where(F.col("n_") == size).drop("n_")


def ring_pool_stream(stream: DataFrame, task: str, positive: str, order: str, payload: str, capacity: int) -> DataFrame:
    """Rings of positive and negative entries a task, each overwriting its oldest entry when full."""
    import json

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pools, at = (json.loads(state.get[0]), json.loads(state.get[1])) if state.exists else ([[], []], [0, 0])
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        for value, good in zip(rows[payload], rows[positive], strict=True):
            k = int(bool(good))
            if len(pools[k]) < capacity:
                pools[k].append(str(value))
            else:
                pools[k][at[k]] = str(value)
            at[k] = (at[k] + 1) % capacity
        state.update((json.dumps(pools), json.dumps(at)))
        yield pd.DataFrame({task: [keys[0]], "negatives": [json.dumps(pools[0])], "positives": [json.dumps(pools[1])]})

    kind = stream.schema[task].dataType.simpleString()
    return stream.groupBy(task).applyInPandasWithState(step, f"{task} {kind}, negatives string, positives string", "pools string, places string", "update", GroupStateTimeout.NoTimeout)


def ring_pools(df: DataFrame, keys: list[str], order: str, capacity: int) -> DataFrame:
    """The last ``capacity`` rows of each key: what the rings hold at the end."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("from_end_", F.row_number().over(w)).where(F.col("from_end_") <= capacity).drop("from_end_")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keyed upsert: the last row of each key."""
    return ring_pools(df, keys, order, 1)


def ready_groups(df: DataFrame, group: str, status: str) -> DataFrame:
    """Successes of groups in which nothing runs any more; other states are passed over."""
    done = df.groupBy(group).agg(F.count_if(F.col(status) == "running").alias("n_")).where("n_ = 0").select(group)
    return df.join(done, group, "left_semi").where(F.col(status) == "success")


def fresh(df: DataFrame, version: str, current: int, staleness: int) -> DataFrame:
    """Rows at most ``staleness`` versions behind."""
    return df.where(F.lit(current) - F.col(version) <= staleness)


def admission_limit(required: int, threshold: float, sync_steps: int) -> int:
    """Samples that may be under way before generation pauses."""
    return int(required * (1 + threshold) * sync_steps)


def version_of(batch_no: Column, every: int) -> Column:
    return F.floor(batch_no / every)


def cleared(df: DataFrame, key: str, order: str, clears: DataFrame) -> DataFrame:
    """Entries of each key that came after its last clearing; ``clears`` has key and the same order column."""
    last = clears.groupBy(key).agg(F.max(order).alias("cleared_at_"))
    return df.join(last, key, "left").where(F.col("cleared_at_").isNull() | (F.col(order) > F.col("cleared_at_"))).drop("cleared_at_")


def removed(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Entries without those whose keys are to be removed."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def memory_use(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Entries, bytes of payload and mean bytes of an entry of each queue."""
    size = F.octet_length(payload)
    return df.groupBy(key).agg(F.count("*").alias("entries"), F.sum(size).alias("bytes"), F.avg(size).alias("mean_bytes"))


def fed_samples(df: DataFrame, epochs: int, most: int, order: str = "row_id") -> DataFrame:
    """Single samples of an endless run over the table: epoch, step from 0, sample_id and end, set on the last one.

    Rows follow in their order, epoch by epoch, until ``most`` steps are done.
    """
    from ..operators.batch import batches

    one = batches(df.withColumnRenamed(order, "row_id") if order != "row_id" else df, 1, epochs, drop_last=False)
    n = df.count()
    steps = one.withColumn("step", F.col("epoch") * n + F.col("place")).where(F.col("step") <= most).drop("batch", "place")
    last = min(most, epochs * n - 1)
    return steps.withColumn("sample_id", F.concat(F.lit("sample_"), "epoch", F.lit("_"), "step")).withColumn("end", F.col("step") == last)


def staleness_resets(events: DataFrame, versions: DataFrame) -> DataFrame:
    """A row a version: stale samples at its beginning and the share of its time that nothing was generated.

    ``events`` has version, in_flight, queued, started, idle_from and ended (seconds): counts and times at the update
    that ends a version. ``versions`` names the versions to report.
    """
    joined = versions.join(events, "version")
    active, whole = F.col("idle_from") - F.col("started"), F.col("ended") - F.col("started")
    return joined.select("version", (F.col("in_flight") + F.col("queued")).alias("stale"), active.alias("active_time"), whole.alias("version_time"), (1 - F.try_divide(active, whole)).alias("idle_ratio"))


def pool_resampler(path: str, tasks: list, capacity: int, seed: int = 0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each batch enters the pools under ``path``, and as many rows are drawn from them.

    The pools after each batch, the last ``capacity`` rows of each task and kind, and the draw from them are stored by the
    batch's number and replace themselves when it is run again; a batch reads the pools of the one before it and no
    earlier rows. Rows have task, positive and seq.
    """
    from pyspark.errors import AnalysisException

    from ..operators.sampling import allocate

    def put(batch: DataFrame, number: int) -> None:
        spark, root = batch.sparkSession, path.rstrip("/")
        rows = written(batch.where(F.col("task").isin(tasks)).drop("batch_no"), "batch")
        try:
            stored = spark.read.parquet(f"{root}/pools").where(F.col("batch_no") < number)
            before = stored.agg(F.max("batch_no")).first()[0]
        except AnalysisException:  # the first batch
            before = None
        both = rows if before is None else rows.unionByName(stored.where(F.col("batch_no") == before).drop("batch_no"))
        ring_pools(both, ["task", "positive"], "seq", capacity).write.mode("overwrite").parquet(f"{root}/pools/batch_no={number}")
        pools = spark.read.parquet(f"{root}/pools/batch_no={number}")
        allocate(pools, "task", rows.count(), f"{seed}:{number}", "seq").drop("rank_in_task").write.mode("overwrite").parquet(f"{root}/drawn/batch_no={number}")

    return put


def queue_statistics(queues: DataFrame, limits: dict[str, int]) -> DataFrame:
    """A row of totals over all queues (size, produced, dropped) beside the fixed limits."""
    out = queues.agg(F.sum("size").alias("monitor/queue_size"), F.sum("produced").alias("count/total_generated_samples"), F.sum("dropped").alias("count/dropped_stale_samples"))
    return out.withColumns({f"static/{k}": F.lit(v) for k, v in limits.items()})


class Conversation:
    """Turns with an outside party, one instance a trajectory: ``begin``, then ``answer`` for each turn, then ``end``.

    ``answer`` returns (done, text, score). Subclasses keep what they need on the instance.
    """

    def begin(self, key, first: str) -> None: ...

    def answer(self, text: str) -> tuple[bool, str, float]:
        raise NotImplementedError

    def end(self) -> None: ...


def conversations(df: DataFrame, make: Callable[[], Conversation], key: str, order: str, text: str) -> DataFrame:
    """key, ``order``, reply, score and done of each turn up to the one that ends its trajectory.

    A trajectory is one group, as its turns follow one another; tools with create, execute, reward and release fit the
    same three steps.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        party, out = make(), []
        party.begin(rows[key].iloc[0], rows[text].iloc[0])
        for at, said in zip(rows[order], rows[text], strict=True):
            done, reply, score = party.answer(said)
            out.append((rows[key].iloc[0], at, reply, score, done))
            if done:
                break
        party.end()
        return pd.DataFrame(out, columns=[key, order, "reply", "score", "done"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}
    return df.select(key, order, text).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, reply string, score double, done boolean")
