"""Queues, replay buffers and tool sessions as stateful processors: an update touches its own entries of state only.

State is kept in values, maps and timers of Spark's state store, which needs the RocksDB provider (``keyed_state``). A
micro-batch's rows of one key are put in order before they are applied; how many they are, the source's admission
limits say (``maxFilesPerTrigger`` and the like). Whatever a stream gives out has its batch result beside it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import staging
from ..operators.ordered import number_rows

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession, idle: bool = True):
    """Queries started in here keep their state in RocksDB and, unless ``idle``, have no micro-batches without rows."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _sorted(parts: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(list(order), kind="stable")


def _int(x) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


# ---- bounded queues

#: Rows that are given out at a time.
ROWS_OUT = 50_000
#: Entries of a queue in a value of the state store.
CHUNK = 512


class _Queue(StatefulProcessor):
    """Entries by number from ``head`` up to ``tail``, ``chunk`` of them in a value of the state store.

    Entries that come and go in one micro-batch don't touch the store.
    """

    def __init__(self, capacity: int, chunk: int):
        self.capacity, self.chunk = capacity, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "number bigint", "payloads array<string>")
        self.counters = handle.getValueState("counters", "head bigint, tail bigint, consumed bigint, dropped bigint, closed boolean")

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head, tail, consumed, dropped, closed = self.counters.get() or (0, 0, 0, 0, False)
        first, stored = head, tail  # entries of these numbers are in the state store, later ones in ``fresh``
        fresh: deque = deque()
        read: tuple = (None, None)
        columns = ["key", "at", "action", "done", "payload", "size", "produced", "consumed", "dropped", "closed"]
        held = _sorted(rows, "at")[["at", "action", "payload"]]
        for begin in range(0, len(held), ROWS_OUT):
            out = []
            for at, action, payload in held.iloc[begin : begin + ROWS_OUT].itertuples(index=False, name=None):
                given, given_out = None, True
                if action == "put":
                    if tail - head >= self.capacity:
                        if head >= stored and fresh:
                            fresh.popleft()
                        head, dropped, given_out = head + 1, dropped + 1, False
                    fresh.append(payload)
                    tail += 1
                elif action == "get" and tail > head:
                    if head < stored and read[0] != head // self.chunk:
                        read = head // self.chunk, self._payloads(head // self.chunk)
                    given = fresh.popleft() if head >= stored else read[1][head % self.chunk]
                    head, consumed = head + 1, consumed + 1
                elif action == "get":
                    given_out = False
                elif action == "clear":
                    fresh.clear()
                    head = tail
                elif action == "close":
                    closed = True
                else:
                    raise ValueError(f"unknown action {action}")
                out.append((key[0], at, action, given_out, given, tail - head, tail, consumed, dropped, closed))
            yield pd.DataFrame(out, columns=columns)
        for number in range(first // self.chunk, min(head // self.chunk, -(-stored // self.chunk))):
            self.chunks.removeKey((number,))
        if fresh:
            begin = max(head, stored)
            number, place = divmod(begin, self.chunk)
            line = [*(self._payloads(number) if place and head < stored else [None] * place), *fresh]
            for k in range(0, len(line), self.chunk):
                self.chunks.updateValue((number + k // self.chunk,), (line[k : k + self.chunk],))
        self.counters.update((head, tail, consumed, dropped, closed))

    def _payloads(self, number: int) -> list:
        return list(self.chunks.getValue((number,))[0])

    def close(self) -> None: ...


def queues(stream: DataFrame, key: str, order: str, action: Column, payload: Column, capacity: int, chunk: int = CHUNK) -> DataFrame:
    """A row for each action on the first-in-first-out queue of its key, in the order of a whole number.

    ``put`` drops the oldest entry of a full queue and is then not ``done``; ``get`` gives out the oldest entry, or is not
    done if there is none; ``clear`` empties the queue; ``close`` marks it. Each row has the size and the totals after it.
    """
    kind = stream.schema[key].dataType.simpleString()
    asked = stream.select(F.col(key).alias("key"), F.col(order).cast("bigint").alias("at"), action.alias("action"), payload.cast("string").alias("payload"))
    schema = f"key {kind}, at bigint, action string, done boolean, payload string, size bigint, produced bigint, consumed bigint, dropped bigint, closed boolean"
    return asked.groupBy("key").transformWithStateInPandas(_Queue(capacity, chunk), schema, "Update", "None")


# ---- replay buffers


class _Barrier(StatefulProcessor):
    """Items of one step of a partition by key, and how many of them run; a step is given out when the last one ends."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item string", "status string, tags string", self.keep_ms)
        self.running = handle.getValueState("running", "n bigint, round bigint")

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        running, released = self.running.get() or (0, 0)
        touched = False
        at = None
        for at, item, status, tags in _sorted(rows, "at")[["at", "item", "status", "tags"]].itertuples(index=False):  # noqa: B007
            if item is None:
                continue
            before = self.items.getValue((item,)) if self.items.containsKey((item,)) else (None, None)
            running -= before[0] == "running"
            touched = True
            if status == "removed":
                if before[0] is not None:
                    self.items.removeKey((item,))
                continue
            status = before[0] if status is None else status
            running += status == "running"
            self.items.updateValue((item,), (status, before[1] if tags is None else tags))
        out = []
        if touched and running:
            out = [(key[0], key[1], at, released, True, None, None)]
        elif touched:
            released += 1
            out = [(key[0], key[1], at, released, False, item[0], held[1]) for item, held in self.items.iterator() if held[0] == "success"]
            out = out or [(key[0], key[1], at, released, False, None, None)]
        self.running.update((running, released))
        yield pd.DataFrame(out, columns=["partition", "step", "at", "round", "waits", "item", "tags"])

    def close(self) -> None: ...


def replay_buffer(stream: DataFrame, partition: str, step: str, order: str, item: str, status: Column, tags: Column, keep_ms: int = 7 * 24 * 3_600_000) -> DataFrame:
    """Successes of each step of a partition, whenever a micro-batch leaves none of its items running; ``round`` counts these times.

    A micro-batch that leaves some running gives one row that ``waits``, without an item; one that leaves none and no success gives one
    row without an item that doesn't. ``at`` is the order of the step's last
    row. A row puts or changes an item: a null status or null tags leave what was there, ``removed`` takes it out. Items that
    aren't touched for ``keep_ms`` are forgotten, by the clock: a run that is to end by itself must do without idle
    micro-batches (``keyed_state``). A step that gets new items afterwards is given out again, in a later round.
    """
    kinds = [stream.schema[c].dataType.simpleString() for c in (partition, step)]
    asked = stream.select(F.col(partition).alias("partition"), F.col(step).alias("step"), F.col(order).cast("bigint").alias("at"), F.col(item).cast("string").alias("item"), status.alias("status"), tags.cast("string").alias("tags"))
    schema = f"partition {kinds[0]}, step {kinds[1]}, at bigint, round bigint, waits boolean, item string, tags string"
    return asked.groupBy("partition", "step").transformWithStateInPandas(_Barrier(keep_ms), schema, "Update", "ProcessingTime")


def replay_result(df: DataFrame, partition: str, step: str, order: str, item: str, status: Column, tags: Column) -> DataFrame:
    """What ``replay_buffer`` gives out for each step after all rows: the successes of steps in which nothing runs."""
    rows = df.select(F.col(partition).alias("partition"), F.col(step).alias("step"), F.col(order).alias("at"), F.col(item).cast("string").alias("item"), status.alias("status"), tags.cast("string").alias("tags")).where("item is not null")
    keys = ["partition", "step", "item"]
    gone = rows.groupBy(*keys).agg(F.max(F.when(F.col("status") == "removed", F.col("at"))).alias("gone"))
    left = rows.join(gone, keys).where(F.col("gone").isNull() | (F.col("at") > F.col("gone")))
    last = left.groupBy(*keys).agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("at"))).alias("status"), F.max_by("tags", F.when(F.col("tags").isNotNull(), F.col("at"))).alias("tags"))
    done = last.groupBy("partition", "step").agg(F.count_if(F.col("status") == "running").alias("n")).where("n = 0").drop("n")
    return last.join(done, ["partition", "step"], "left_semi").where("status = 'success'").select(*keys, "tags")


# ---- tool sessions


class Tool:
    """An outside party that keeps its state as one text: ``create``, then ``execute`` for each turn, then ``reward``.

    Instances hold nothing between calls, as each may be made in another task.
    """

    def create(self, key, first: str) -> str:
        return ""

    def execute(self, state: str, text: str) -> tuple[str, str, float]:
        """(state, reply, score of the turn)."""
        raise NotImplementedError

    def reward(self, state: str, scores: float) -> float:
        return scores

    def release(self, state: str) -> None: ...


class _Session(StatefulProcessor):
    """One session a key: its state, turns and scores in a value, and a timer that ends it."""

    def __init__(self, make: Callable[[], Tool], gap_ms: int):
        self.make, self.gap_ms = make, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.tool = handle, self.make()
        self.held = handle.getValueState("session", "state string, turns bigint, scores double, expires bigint, closed boolean")

    def _end(self, key, at: int, how: str, held: tuple) -> tuple:
        state, turns, scores, _, _ = held
        reward = self.tool.reward(state, scores)
        self.tool.release(state)
        self.held.update((state, turns, scores, at, True))
        return (key[0], how, at, turns, None, reward)

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for turn, at, text, ends in _sorted(rows, "at", "turn")[["turn", "at", "text", "ends"]].itertuples(index=False):
            held = self.held.get() if self.held.exists() else None
            if held and not held[4] and at > held[3]:  # its timer is due, but its turn hasn't come
                self.handle.deleteTimer(held[3])
                out.append(self._end(key, held[3], "expired", held))
                held = self.held.get()
            if held and held[4]:
                out.append((key[0], "refused", at, _int(turn), None, None))
                continue
            state, turns, scores, expires, _ = held or (self.tool.create(key[0], text), 0, 0.0, None, False)
            if expires is not None:
                self.handle.deleteTimer(expires)
            state, reply, score = self.tool.execute(state, text)
            held = (state, turns + 1, scores + score, int(at) + self.gap_ms, False)
            out.append((key[0], "turn", at, _int(turn), reply, score))
            if ends:
                out.append(self._end(key, int(at), "released", held))
            else:
                self.held.update(held)
                self.handle.registerTimer(held[3])
        yield pd.DataFrame(out, columns=["key", "event", "at", "number", "reply", "score"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.held.get() if self.held.exists() else None
        if held and not held[4] and held[3] <= expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame([self._end(key, held[3], "expired", held)], columns=["key", "event", "at", "number", "reply", "score"])

    def close(self) -> None: ...


SESSION = "event string, at bigint, number bigint, reply string, score double"


def tool_sessions(stream: DataFrame, make: Callable[[], Tool], key: str, turn: str, time: str, text: str, ends: Column, gap_ms: int, delay: str = "0 seconds") -> DataFrame:
    """What happens in each key's one session, by event time: ``turn`` (reply and score), then ``released`` or ``expired`` with
    the number of turns and the reward, then ``refused`` for each later turn.

    The first turn creates the session; a turn with ``ends`` releases it; if none comes within ``gap_ms`` of the last, it
    expires at that time, when the watermark passes it or a later turn comes. Turns that come later than ``delay`` after
    others are dropped by Spark. ``at`` is milliseconds.
    """
    kind = stream.schema[key].dataType.simpleString()
    asked = stream.withWatermark(time, delay).select(F.col(key).alias("key"), F.col(turn).cast("bigint").alias("turn"), F.col(time).alias("time"), F.unix_millis(F.col(time)).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(ends, F.lit(False)).alias("ends"))
    return asked.groupBy("key").transformWithStateInPandas(_Session(make, gap_ms), f"key {kind}, {SESSION}", "Append", "EventTime")


# ---- runs over tables


def run_in_parts(df: DataFrame, order: str, parts: int, build: Callable[[DataFrame], DataFrame], stop_after: int, mode: str = "update", idle: bool = True) -> DataFrame:
    """All rows that the stream ``build`` gives out when ``df`` comes in ``parts`` files, in the order of a column.

    Rows that are equal in it come in the same file, as by event time the later ones would be late.
    The stream is stopped after ``stop_after`` files and started again from its checkpoint for the others. Each
    micro-batch writes its own folder and replaces it when it is run again, so every row counts once. Without ``idle`` there
    are no micro-batches without rows, which streams by processing time would ask for without end.
    """
    spark, root = df.sparkSession, staging.folder(df.sparkSession, "stream")
    numbered = number_rows(df.select(order), order, out="stream_place_")
    n = numbered.count()
    begins = [-(-n * part // parts) for part in range(1, parts)]
    at = dict(numbered.where(F.col("stream_place_").isin(begins)).select("stream_place_", F.col(f"`{order}`")).collect())  # a row a part
    reached = [F.lit(True) if at[b] is None else F.coalesce(F.col(f"`{order}`") >= F.lit(at[b]), F.lit(False)) for b in begins if b in at]
    own = sum((r.cast("int") for r in reached), F.lit(0))
    cut = staging.written(df.withColumn("stream_part_", own), "parts")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_no={number}")

    schema = None
    with keyed_state(spark, idle):
        for begin, end in ((0, stop_after), (stop_after, parts)):
            for part in range(begin, end):
                cut.where(F.col("stream_part_") == part).drop("stream_part_").coalesce(1).write.mode("append").parquet(f"{root}/in")
            stream = build(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{root}/in"))
            schema = stream.schema
            query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            finally:
                query.stop()
    return spark.read.schema(schema).option("basePath", f"{root}/out").parquet(f"{root}/out/*").select(*schema.names)


def session_result(df: DataFrame, key: str, turn: str, time: str, ends: Column, gap_ms: int) -> DataFrame:
    """(key, turn, event): ``turn`` or ``refused`` for each turn, as ``tool_sessions`` has it, by windows over each key."""
    w = Window.partitionBy(key).orderBy(time, turn)
    at = F.unix_millis(F.col(time))
    over = (at - F.lag(at).over(w) > gap_ms) | F.lag(F.coalesce(ends, F.lit(False))).over(w)
    marked = df.withColumn("over_", F.coalesce(over, F.lit(False)).cast("int"))
    return marked.select(key, turn, F.when(F.max("over_").over(w) == 1, "refused").otherwise("turn").alias("event"))
