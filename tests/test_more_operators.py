"""Operators beyond SQL, and those whose faults show at sizes or values that the tables lack."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import scoring as S
from millrace.functions import text as T
from millrace.operators import advantage, batch, losses, metrics, partition, retrieval, rewards, sampling, sequences
from millrace.sources import readers, sinks
from millrace.streaming import stateful


def test_whitening_of_large_values(spark):
    df = spark.createDataFrame([([1e8 + 1, 1e8 + 2, 0.0], [1, 1, 0]), ([1e8 + 3, 1e8 + 4, math.nan], [1, 1, 0])], "reward array<double>, mask array<int>")
    out = [x for r in advantage.whiten(df, "reward").collect() for x in r["reward"][:2]]
    mean = 4 * (1e8 + 2.5) / (4 + 1e-8)
    var = sum((1e8 + k - mean) ** 2 for k in (1, 2, 3, 4)) / (4 + 1e-8) * 4 / 3
    assert sorted(out) == pytest.approx([(1e8 + k - mean) / math.sqrt(var + 1e-8) for k in (1, 2, 3, 4)], abs=1e-6)


def test_scans_of_long_rows(spark):
    draw = random.Random(1)
    rows = [(k, [draw.random() for _ in range(n)], [draw.randint(0, 1) for _ in range(n)]) for k, n in enumerate((0, 1, 127, 128, 129, 300, 9000))]
    df = spark.createDataFrame(rows, "k int, x array<double>, m array<int>")
    start = F.struct(F.lit(0.0).alias("out"))
    step = lambda s, x: F.struct((0.9 * s["out"] + x).alias("out"))
    out = {r["k"]: r for r in df.select("k", A.scan(F.col("x"), start, step).alias("f"), A.reverse_scan(F.col("x"), start, step).alias("b"), A.position_ids(F.col("m")).alias("p")).collect()}
    for k, x, m in rows:
        forward, total = [], 0.0
        for v in x:
            total = 0.9 * total + v
            forward.append(total)
        backward, total = [], 0.0
        for v in reversed(x):
            total = 0.9 * total + v
            backward.append(total)
        assert out[k]["f"] == pytest.approx(forward) and out[k]["b"] == pytest.approx(backward[::-1])
        want = np.maximum(np.cumsum(m) - 1, 0).tolist() if m else []
        assert out[k]["p"] == want


def test_boxes_in_answers(spark):
    rows = [(r"\boxed 5 then \boxed{7}", "5 then \\boxed{7}", "7"), (r"\fbox{3}", "3", None), (r"a \boxed{\frac{1}{2}} b", r"\frac{1}{2}", r"\frac{1}{2}"), (r"\boxed{1", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, loose string, strict string")
    out = df.select(S.last_boxed(F.col("t")), S.last_braced_box(F.col("t")), "loose", "strict").collect()
    assert all((r[0], r[1]) == (r[2], r[3]) for r in out)
    strict = spark.createDataFrame([(r"\fbox{3}", "3"), (r"\boxed{3}", "3"), (r"\boxed 3", "3")], "s string, t string").select(S.boxed_or_answer(F.col("s"), F.col("t"), strict_box=True)["acc"]).collect()
    assert [r[0] for r in strict] == [False, True, False]


def test_run_counter_over_ranges(spark):
    draw = random.Random(2)
    values = [draw.choice([0, 0, 0, 1, None]) for _ in range(700)]
    df = spark.createDataFrame([(3 * k, v) for k, v in enumerate(values)], "k bigint, v int").repartition(5)
    out = {r["k"]: r["rollout_n"] for r in sequences.run_counter(df, "v", "k").collect()}
    n, before = 0, object()
    for k, v in enumerate(values):
        n = n + 1 if v == before else 0
        before = v
        assert out[3 * k] == n
    constant = sequences.run_counter(df.withColumn("v", F.lit(1)), "v", "k").collect()
    assert all(r["rollout_n"] * 3 == r["k"] for r in constant)


def test_highest_with_ties(spark):
    draw = random.Random(3)
    rows = [(k // 10, k % 10, float(draw.randint(0, 30))) for k in range(2000)]
    df = spark.createDataFrame(rows, "row_id bigint, pos int, cov double")
    for k in (1, 7, 100, 1999, 2000):
        want = {x[:2] for x in sorted(rows, key=lambda x: (-x[2], x[0], x[1]))[:k]}
        assert {(r["row_id"], r["pos"]) for r in losses._highest(df, "cov", k).where("top_").collect()} == want


def test_order_statistics(spark, monkeypatch):
    draw = random.Random(4)
    monkeypatch.setattr(metrics, "BRACKET_ROWS", 50)
    for values in ([draw.random() for _ in range(3000)], [float(draw.randint(0, 3)) for _ in range(3000)], [1.0] * 500 + [2.0], [5.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        for p in (0.0, 0.1, 0.5, 0.95, 1.0):
            assert metrics.quantile(df, "x", p) == pytest.approx(float(np.quantile(values, p)))
    assert metrics.quantile(spark.createDataFrame([], "x double"), "x", 0.5) is None


def test_shuffled_batches(spark):
    df = spark.range(103).withColumnRenamed("id", "row_id").repartition(3)
    rows = batch.batches(df, 10, epochs=3, seed=7).collect()
    for epoch in range(3):
        own = [r for r in rows if r["epoch"] == epoch]
        assert len(own) == 100 and sorted(r["place"] for r in own) == list(range(100)) and all(r["batch"] == r["place"] // 10 for r in own)
    orders = [[r["row_id"] for r in sorted(rows, key=lambda r: r["place"]) if r["epoch"] == e] for e in (0, 1)]
    assert orders[0] != orders[1]
    plain = batch.batches(df, 10, drop_last=False).collect()
    assert all(r["place"] == r["row_id"] for r in plain) and max(r["batch"] for r in plain) == 10


def test_resampling_by_weight(spark):
    df = spark.createDataFrame([(k, 0.0 if k % 3 == 0 else float(k)) for k in range(1, 41)], "key bigint, w double")
    out = sampling.resample(df, "key", "w", 4000, 5).collect()
    seen = [r["key"] for r in out]
    assert sorted(r["k"] for r in out) == list(range(4000)) and not any(k % 3 == 0 for k in seen)
    total = sum(k for k in range(1, 41) if k % 3)
    assert seen.count(40) / 4000 == pytest.approx(40 / total, abs=0.02)


def test_bootstrap_by_hand():
    values, labels = np.array([1.0, 5.0, 3.0]), ["a", "b", "a"]
    places = np.array([[0, 1], [1, 2], [2, 0], [1, 1]])
    best, worst, maj = metrics.sampled_scores(values, labels, places)
    assert best.tolist() == [5, 5, 3, 5] and worst.tolist() == [1, 3, 1, 5] and maj.tolist() == [1, 5, 3, 5]


def test_dynamic_batches_balance(spark):
    draw = random.Random(6)
    rows = [(k, 0, draw.randint(10, 900)) for k in range(60)]
    out = partition.dynamic_batches(spark.createDataFrame(rows, "row_id bigint, batch int, n int"), "batch", "n", 4000, multiple=2).collect()
    loads = {}
    for r in out:
        loads[r["micro"]] = loads.get(r["micro"], 0) + 24576 * r["n"] + r["n"] ** 2
    sizes = [loads[k] for k in sorted(loads)]
    assert len(sizes) % 2 == 0 and sizes[0] <= max(sizes) and sizes[-1] <= max(sizes) and max(sizes) <= 1.2 * min(sizes)
    with pytest.raises(Exception, match="results and positions differ"):
        placed = spark.createDataFrame(out)
        partition.restore_order(placed.select("batch", "micro", "place").limit(59), "batch", placed).collect()


def test_boxes_resized(spark):
    def valid(x0, y0, x1, y1):
        w, h = x1 - x0, y1 - y0
        return w > 0 and h > 0 and max(w, h) / min(w, h) <= 100

    def resized(x0, y0, x1, y1, width, height, least=28):
        x0, y0, x1, y1 = max(0.0, x0), max(0.0, y0), min(float(width), x1), min(float(height), y1)
        if not valid(x0, y0, x1, y1):
            return None
        box, w, h = [x0, y0, x1, y1], x1 - x0, y1 - y0
        if w < least or h < least:
            ratio = least / min(w, h)
            tw, th = w * ratio, h * ratio
            if tw > width:
                th, tw = th * width / tw, width
            if th > height:
                tw, th = tw * height / th, height
            nx, ny = max(0.0, (x0 + x1) / 2 - tw / 2), max(0.0, (y0 + y1) / 2 - th / 2)
            nx, ny = min(nx, width - tw) if nx + tw > width else nx, min(ny, height - th) if ny + th > height else ny
            box = [math.floor(nx), math.floor(ny), math.ceil(nx + tw), math.ceil(ny + th)]
        if not valid(*box) or math.floor(box[3]) - math.floor(box[1]) < least or math.floor(box[2]) - math.floor(box[0]) < least:
            return None
        return box

    draw = random.Random(7)
    rows = []
    for _ in range(400):
        x, y = draw.randint(-20, 150), draw.randint(-20, 80)
        rows.append((float(x), float(y), float(x + draw.randint(-3, 120)), float(y + draw.randint(2, 90)), draw.choice([20, 60, 200]), draw.choice([25, 100])))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a double, b double, c double, d double, w int, h int")
    out = {r[0]: r[1] for r in df.select("k", S.boxes_resized(*(F.col(x) for x in "abcdwh"))).collect()}
    for k, r in enumerate(rows):
        want = resized(*r)
        assert (out[k] is None) == (want is None) and (want is None or out[k] == pytest.approx(want, abs=1.0))
    assert sum(v is not None for v in out.values()) > 30


def test_typed_values():
    assert T._typed("3", "integer") == 3 and T._typed("3.0", "number") == 3 and T._typed("3.5", "float") == 3.5 and T._typed("x", "int") == "x"
    assert T._typed("TRUE", "bool") is True and T._typed("no", "bool") is False and T._typed("NULL", "string") is None
    assert T._typed('{"a": 1}', "object") == {"a": 1} and T._typed("(1, 2)", "array") == (1, 2) and T._typed("f(", "array") == "f("


def test_nearest_in_blocks(spark):
    draw = np.random.default_rng(8)
    vectors = draw.normal(size=(200, 8))
    vectors[50] = vectors[51]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(999, None)], "vec_id bigint, embedding array<double>").repartition(3)
    out = retrieval.nearest(rows, rows.where("vec_id % 10 = 0"), 4, block=7).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(0, 200, 10):
        s = np.round(unit @ unit[q], 12)
        want = sorted((k for k in range(200) if k != q), key=lambda k: (-s[k], k))[:4]
        own = sorted((r for r in out if r["query"] == q), key=lambda r: (-r["similarity"], r["vec_id"]))
        assert [r["vec_id"] for r in own] == want
    assert retrieval.nearest(rows, rows.limit(0), 4).count() == 0


def test_generation_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert readers.stored_generation(spark, path, 3) is None
    for train_step, gen_step in ((3, 1), (3, 2), (4, 3)):
        index = sinks.dump_generation_batch(spark.range(gen_step), path, train_step, gen_step)
    assert [(r["line_no"], r["train_step"], r["gen_step"]) for r in index.orderBy("line_no").collect()] == [(0, 3, 1), (1, 3, 2), (2, 4, 3)]
    assert readers.stored_generation(spark, path, 3).count() == 2 and readers.stored_generation(spark, path, 9) is None
    assert readers.load_pools(spark, path + "/none") is None
    sinks.save_pools(spark.range(5), path + "/pools")
    assert readers.load_pools(spark, path + "/pools").count() == 5


def test_live_table_and_pools(spark, tmp_path):
    put = readers.batch_appender(lambda b: b.select(F.lit("new").alias("prompt")), str(tmp_path / "live"), most=10, length=F.length)
    for number in (0, 1, 1):
        put(spark.range(4), number)
    assert spark.read.parquet(str(tmp_path / "live")).count() == 8
    readers.append_rows(spark.createDataFrame([("a",), ("b" * 50,)], "prompt string"), str(tmp_path / "more"), most=10, length=F.length)
    assert spark.read.parquet(str(tmp_path / "more")).count() == 1
    pool = stateful.pool_resampler(str(tmp_path / "pool"), [1, 2], capacity=3)
    for number in range(3):
        rows = [(1 + k % 2, k % 3 == 0, 10 * number + k) for k in range(6)] + [(9, True, 99)]
        pool(spark.createDataFrame(rows, "task int, positive boolean, seq bigint").withColumn("batch_no", F.lit(number)), number)
    drawn = spark.read.parquet(str(tmp_path / "pool/drawn")).where("batch_no = 2").collect()
    assert len(drawn) == 6 and {r["task"] for r in drawn} == {1, 2}


def test_read_many_names_files_by_path(spark, tmp_path):
    for folder, n in (("a", 3), ("b", 5)):
        spark.range(n).write.parquet(str(tmp_path / folder / "part.parquet"))
    out = readers.read_many(spark, [str(tmp_path / f / "part.parquet") for f in ("a", "b")])
    assert {r["file_no"]: r["count"] for r in out.groupBy("file_no").count().collect()} == {0: 3, 1: 5}
    with pytest.raises(ValueError):
        readers.read_many(spark, ["x.csv"])


def test_retries():
    waits, asked = [], []

    def fails(times, error):
        def call(value):
            asked.append(value)
            if len(asked) <= times:
                raise error
            return 1.0

        return call

    assert rewards.retrying(fails(3, RuntimeError()), sleep=waits.append)("x") == 1.0 and waits == [1.0, 2.0, 4.0]
    asked.clear()
    with pytest.raises(rewards.ClientError):
        rewards.retrying(fails(3, rewards.ClientError()), sleep=waits.append)("x")
    assert len(asked) == 1


def test_custom_scorer(spark, tmp_path):
    (tmp_path / "own.py").write_text("from pyspark.sql import functions as F\ndef score(a, b, bonus=0.0):\n    return (a == b).cast('double') + bonus\n")
    f = S.load_scorer(str(tmp_path / "own.py"), "score", bonus=0.5)
    df = spark.createDataFrame([("x", "x"), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(f(F.col("a"), F.col("b"))).collect()] == [1.5, 0.5]
    with pytest.raises(AttributeError):
        S.load_scorer(str(tmp_path / "own.py"), "none")


def test_settings():
    assert batch.merge_options({"a": 1}, {"a": 1, "b": 2}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        batch.merge_options({"a": 1}, {"a": 2})
    with pytest.raises(KeyError):
        batch.as_columns([{"a": 1, "b": 2}], ["a"])
    with pytest.raises(ValueError):
        losses.register_distillation("k1")(lambda df, name: df)


def test_estimated_bytes(spark):
    assert batch.byte_size(spark.range(1000)) >= 8000


def test_rejection_needs_tokens(spark):
    from millrace.operators import offpolicy

    df = spark.createDataFrame([([0.0], [0.0], [0])], "old_logp array<double>, rollout_logp array<double>, mask array<int>")
    with pytest.raises(Exception, match="no valid token"):
        offpolicy.rejection_metrics(df, "token_k2", "1.0").collect()


def test_group_statistics_of_null_keys(spark):
    df = spark.createDataFrame([(1, None, [1.0], [1]), (2, None, [3.0], [1]), (3, 5, [4.0], [1])], "row_id bigint, uid int, reward array<double>, mask array<int>")
    out = {r["row_id"]: r["advantages"][0] for r in advantage.advantage(df, "rloo").collect()}
    assert out == {1: -2.0, 2: 2.0, 3: 4.0}
    std = {r["row_id"]: r["advantages"][0] for r in advantage.advantage(df, "grpo").collect()}
    assert std[2] == pytest.approx(1 / (statistics.stdev([1, 3]) + 1e-6))


def test_response_block_has_its_width(spark):
    """A response longer than the block is cut at its end, a shorter one padded."""
    from millrace.operators import rollout

    df = spark.createDataFrame([(list(range(17)), 8), ([5, 6, 7], 1)], "v array<int>, head int")
    out = df.select(rollout.response_block(F.col("v"), F.col("head"), F.size("v") - F.col("head"), 8, 0).alias("b")).collect()
    assert [r["b"] for r in out] == [list(range(7, 15)), [5, 6, 0, 0, 0, 0, 0, 0]]
