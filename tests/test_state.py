"""Stateful streams that are stopped and started again, against plain loops."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from millrace.streaming import state


def test_queues(spark):
    draw = random.Random(3)
    rows = [(n, n % 3, draw.choice(["put"] * 5 + ["get"] * 3 + ["clear", "close"] * (n % 9 == 0)), f"e{n}") for n in range(150)]
    df = spark.createDataFrame(rows, "n int, k int, action string, payload string")
    out = state.run_in_parts(df, "n", 4, lambda s: state.queues(s, "k", "n", F.col("action"), F.col("payload"), 4), 2)
    held, totals, want = {}, {}, {}
    for n, k, action, payload in rows:
        q, t = held.setdefault(k, deque()), totals.setdefault(k, [0, 0, 0, False])
        done, given = True, None
        if action == "put":
            if len(q) == 4:
                q.popleft()
                t[2] += 1
                done = False
            q.append(payload)
            t[0] += 1
        elif action == "get":
            done = bool(q)
            given = q.popleft() if q else None
            t[1] += done
        elif action == "clear":
            q.clear()
        else:
            t[3] = True
        want[n] = (k, action, done, given, len(q), *t)
    assert {r["at"]: (r["key"], r["action"], r["done"], r["payload"], r["size"], r["produced"], r["consumed"], r["dropped"], r["closed"]) for r in out.collect()} == want


def test_replay_buffer(spark):
    draw = random.Random(6)
    rows = [(n, "train" if n % 4 else "val", n % 5, f"i{draw.randint(0, 12)}" if n % 40 else None, draw.choice(["running", "success", "success", "failed", "removed", None]), draw.choice([None, f"t{n}"])) for n in range(200)]
    df = spark.createDataFrame(rows, "n int, part string, step int, item string, status string, tags string")
    columns = ("part", "step", "n", "item", F.col("status"), F.col("tags"))
    given = state.run_in_parts(df, "n", 5, lambda s: state.replay_buffer(s, *columns), 2, idle=False).collect()
    want, rounds = {}, {}
    for r in given:
        rounds.setdefault((r["partition"], r["step"]), {}).setdefault(r["at"], set()).add((r["waits"], r["item"], r["tags"]))
    items = {}
    for _, part, step, item, status, tags in rows:
        if item is None:
            continue
        own = items.setdefault((part, step), {})
        if status == "removed":
            own.pop(item, None)
        else:
            before = own.get(item, (None, None))
            own[item] = (before[0] if status is None else status, before[1] if tags is None else tags)
    for key, own in items.items():
        if not any(s == "running" for s, _ in own.values()):
            want[key] = {(i, t) for i, (s, t) in own.items() if s == "success"}
    batch = {}
    for r in state.replay_result(df, *columns).collect():
        batch.setdefault((r["partition"], r["step"]), set()).add((r["item"], r["tags"]))
    assert batch == {k: v for k, v in want.items() if v}
    for key, own in want.items():
        assert rounds[key][max(rounds[key])] == ({(False, *x) for x in own} or {(False, None, None)})
    assert all(rounds[key][max(rounds[key])] == {(True, None, None)} for key in rounds if any(s == "running" for s, _ in items[key].values()))


def adder():
    """A class that is sent to tasks as a whole."""

    class Adder(state.Tool):
        """Adds up what is said; the reward is the sum and the turns' scores."""

        def create(self, key, first):
            return "0"

        def execute(self, held, text):
            total = int(held) + int(text)
            return str(total), f"so far {total}", -0.1

        def reward(self, held, scores):
            return int(held) + scores

    return Adder


@pytest.mark.parametrize("stop_after", [1, 3])
def test_tool_sessions(spark, stop_after):
    draw = random.Random(5)
    rows, at = [], dict.fromkeys(range(12), 0)
    for n in range(140):
        k = draw.randint(0, 11)
        at[k] = max(at[k], n * 2_000) + draw.choice([1, 1000])
        rows.append((k, n, at[k] + n, str(draw.randint(0, 9)), draw.random() < 0.1))
    rows.sort(key=lambda r: r[2])
    rows.append((99, 1000, 10**8, "0", True))  # moves the watermark on
    df = spark.createDataFrame(rows, "k int, turn int, ms long, text string, ends boolean").withColumn("ts", F.timestamp_millis("ms"))
    out = state.run_in_parts(df, "ms", 4, lambda s: state.tool_sessions(s, adder(), "k", "turn", "ts", "text", F.col("ends"), 30_000), stop_after, "append").collect()
    want, open_ = set(), {}
    for k, turn, ms, text, ends in rows:
        s = open_.setdefault(k, {"total": 0, "turns": 0, "last": None, "closed": False})
        if not s["closed"] and s["last"] is not None and ms > s["last"] + 30_000:
            s["closed"] = True
            want.add((k, "expired", s["last"] + 30_000, s["turns"], None, round(s["total"] - 0.1 * s["turns"], 6)))
        if s["closed"]:
            want.add((k, "refused", ms, turn, None, None))
            continue
        s["total"], s["turns"], s["last"] = s["total"] + int(text), s["turns"] + 1, ms
        want.add((k, "turn", ms, turn, f"so far {s['total']}", -0.1))
        if ends:
            s["closed"] = True
            want.add((k, "released", ms, s["turns"], None, round(s["total"] - 0.1 * s["turns"], 6)))
    for k, s in open_.items():
        if not s["closed"]:
            want.add((k, "expired", s["last"] + 30_000, s["turns"], None, round(s["total"] - 0.1 * s["turns"], 6)))
    got = [(r["key"], r["event"], r["at"], r["number"], r["reply"], None if r["score"] is None else round(r["score"], 6)) for r in out]
    assert len(got) == len(set(got)) and set(got) == want
    events = {(r["k"], r["turn"]): r["event"] for r in state.session_result(df, "k", "turn", "ts", F.col("ends"), 30_000).collect()}
    assert events == {(k, number): event for k, event, _, number, _, _ in want if event in ("turn", "refused")}


@pytest.mark.parametrize("chunk", [3, 512])
def test_queues_in_chunks(spark, chunk):
    """Entries that stay for several micro-batches, cleared and dropped amid a chunk of the state store."""
    draw = random.Random(chunk)
    rows = [(n, n % 2, draw.choice(["put"] * 6 + ["get"] * 3 + ["clear"] * (n % 40 == 7)), f"e{n}") for n in range(160)]
    df = spark.createDataFrame(rows, "n int, k int, action string, payload string")
    out = state.run_in_parts(df, "n", 3, lambda s: state.queues(s, "k", "n", F.col("action"), F.col("payload"), 11, chunk), 1)
    held, want = {}, {}
    for n, k, action, payload in rows:
        q = held.setdefault(k, deque())
        given = q.popleft() if q and (action == "get" or action == "put" and len(q) == 11) else None
        if action == "put":
            q.append(payload)
        elif action == "clear":
            q.clear()
        want[n] = (given if action == "get" else None, len(q))
    assert {r["at"]: (r["payload"], r["size"]) for r in out.collect()} == want


def test_queue_entries_leave_the_store_alone():
    """Of a micro-batch's rows only the chunks that change are written, not each entry."""
    import pandas as pd

    class Store(dict):
        writes = 0
        getValue, updateValue = dict.get, lambda s, k, v: (s.__setitem__(k, v), setattr(s, "writes", s.writes + 1))  # noqa: N815
        removeKey = lambda s, k: s.pop(k, None)  # noqa: N815, E731

    class Value:
        get, update = lambda s: getattr(s, "v", None), lambda s, v: setattr(s, "v", v)

    q = state._Queue(40, 512)
    q.chunks, q.counters = Store(), Value()
    for begin in (0, 3000):
        list(q.handleInputRows((1,), iter([pd.DataFrame({"at": range(begin, begin + 3000), "action": "put", "payload": "x"})]), None))
    assert q.chunks.writes <= 4 and q.counters.v == (5960, 6000, 0, 5960, False) and sum(len(v[0]) for v in q.chunks.values()) <= 1024
