"""Hand-computed values, invariants and failures of operators."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import scoring as S
from millrace.functions import text as T
from millrace.operators import advantage, batch, losses, metrics, offpolicy, partition, rewards, sampling
from millrace.streaming import stateful


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_group_statistics(spark):
    out = advantage.group_mean_std(frame(spark, [(1.0, 0), (2.0, 1), (3.0, 0)], "v double, g int"), "v", "g").orderBy("g").collect()
    assert [(r["mean"], round(r["std"], 6), r["count"]) for r in out] == [(2.0, 1.414214, 2), (0.0, 1.0, 1)]


def test_masked_mean_and_nan(spark):
    nan = float("nan")
    rows = [([1.0, 2.0, 3.0, 4.0], [1, 0, 0, 1]), ([1.0, 2.0, nan, 4.0], [1, 0, 0, 1]), ([1.0, 2.0, nan, 4.0], [1, 0, 1, 0])]
    out = [r[0] for r in frame(spark, rows, "x array<double>, m array<int>").select(A.masked_mean(F.col("x"), F.col("m"))).collect()]
    assert round(out[0], 6) == round(out[1], 6) == 2.5 and out[2] != out[2]


def test_masked_var_needs_two(spark):
    df = frame(spark, [([1.0, 2.0], [1, 0])], "x array<double>, m array<int>")
    with pytest.raises(Exception, match="masked_var"):
        df.select(A.masked_var(F.col("x"), F.col("m"))).collect()


def test_gae_ignores_masked_values(spark):
    rewards_ = [0, 0, 0.1, 0.1, 0.1, 0, 0, 0.1, 1.0, 0, 0]
    mask = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    random.seed(1)
    rows = []
    for k in range(2):
        values = [random.random() for _ in mask]
        for at, v in zip([2, 3, 4, 7, 8], [4.0, 5.0, 6.0, 7.0, 9.0], strict=True):
            values[at] = v
        rows.append((k, [float(x) for x in rewards_], values, mask))
    out = advantage.gae(frame(spark, rows, "row_id int, reward array<double>, value array<double>, mask array<int>"), whitened=False).collect()
    pick = lambda r, c: [round(x, 9) for x, m in zip(r[c], mask, strict=True) if m]
    assert pick(out[0], "advantages") == pick(out[1], "advantages") and pick(out[0], "returns") == pick(out[1], "returns")


def test_multi_trajectory(spark):
    keys = ["prompt_a_0_0", "prompt_a_0_1", "prompt_a_2_0", "prompt_a_2_1", "prompt_a_3_0", "prompt_a_4_0"]
    values = [[100, 0, 0, 0], [1, 2, 3, 4], [200, 200, 0, 0], [150, 0, 0, 150], [4, 5, 6, 7], [8, 9, 10, 11]]
    masks = [[1, 0, 0, 0], [1, 1, 1, 1], [1, 0, 1, 0], [0, 1, 0, 1], [1, 1, 0, 1], [0, 0, 0, 0]]
    rows = [(k, [float(x) for x in v], m) for k, v, m in zip(keys, values, masks, strict=True)]
    out = {r["key"]: r["advantages"] for r in advantage.multi_trajectory(frame(spark, rows, "key string, reward array<double>, mask array<int>")).collect()}
    scores = [10.0, 300.0, 22.0, 38.0]
    mean = sum(scores) / 4
    std = (sum((s - mean) ** 2 for s in scores) / 3) ** 0.5
    expected = [(s - mean) / (std + 1e-6) for s in scores]
    for key, session, mask in zip(keys[:5], [0, 0, 1, 1, 2], masks[:5], strict=True):
        assert out[key] == pytest.approx([expected[session] * m for m in mask])
    assert out[keys[5]] == [0.0] * 4


def test_passk_needs_two(spark):
    with pytest.raises(Exception, match="two rows"):
        advantage.grpo_passk(frame(spark, [(1, 1, [1.0], [1])], "row_id int, uid int, reward array<double>, mask array<int>")).collect()


def test_registries():
    with pytest.raises(ValueError):
        advantage.estimator("GRPO")
    with pytest.raises(ValueError):
        advantage.register_estimator("grpo")(lambda df: df)
    with pytest.raises(ValueError):
        losses.policy_loss(None, "none")
    with pytest.raises(ValueError):
        rewards.manager("none")


def test_kl_names(spark):
    df = frame(spark, [([-1.0], [-2.0])], "a array<double>, b array<double>")
    assert df.select(A.kl_penalty(F.col("a"), F.col("b"), "k3+")).first() == df.select(A.kl_penalty(F.col("a"), F.col("b"), "low_var_kl")).first()
    with pytest.raises(NotImplementedError):
        A.kl_penalty(F.col("a"), F.col("b"), "full")


def test_importance_band(spark):
    import math

    raw = [0.4, 0.8, 6.0]
    df = frame(spark, [([0.0] * 3, [-math.log(x) for x in raw], [1, 1, 1])], "old_logp array<double>, rollout_logp array<double>, mask array<int>")
    assert offpolicy.importance_weights(df, "token", "0.5_5.0").first()["weights"] == pytest.approx([0, 0.8, 0])
    assert offpolicy.parse_weight_threshold(2) == (None, 2.0)
    for bad in (True, "0", "3_2", "1_2_3"):
        with pytest.raises((TypeError, ValueError)):
            offpolicy.parse_weight_threshold(bad)
    with pytest.raises(ValueError):
        offpolicy.parse_rejection_thresholds(["seq_max_k1"], "2")


def test_batch_slices(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id").withColumn("v", F.col("row_id"))
    for s in (slice(2, 8, 3), slice(None, None, -4), slice(-3, None), slice(5, 5)):
        out = [r["v"] for r in batch.cut(df, 10, s.start, s.stop, s.step or 1).orderBy("row_id").collect()]
        assert out == list(range(10))[s]


def test_union_conflict(spark):
    a = frame(spark, [(0, 1.0), (1, float("nan"))], "row_id bigint, v double")
    assert batch.union_columns(a, a.withColumn("w", F.lit(1))).count() == 2
    with pytest.raises(Exception, match="differ"):
        batch.union_columns(a, a.withColumn("v", F.lit(2.0))).collect()
    with pytest.raises(Exception, match="differ"):
        batch.union_columns(a, a.limit(1)).collect()


def test_pad_round_trip(spark):
    df = spark.range(5).withColumnRenamed("id", "row_id")
    padded = batch.pad_to_divisor(df, 5, 4)
    assert padded.count() == 8 and batch.unpad(padded).count() == 5
    assert batch.pad_to_divisor(spark.range(2).withColumnRenamed("id", "row_id"), 2, 7).count() == 7
    with pytest.raises(ValueError):
        batch.chunk(df, 5, 2)
    assert sorted(r[0] for r in batch.chunk(df, 5, 2, even=False).groupBy("chunk").count().select("count").collect()) == [2, 3]


def test_fold_round_trip(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id").withColumn("v", F.col("row_id") * 2)
    assert sorted(map(tuple, batch.unfold(batch.fold(df, 4), 4, ["v"]).collect())) == sorted(map(tuple, df.collect()))


def test_number_rows_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    rows = batch.number_rows(df, "k").orderBy("k").collect()
    assert [r["row_id"] for r in rows] == list(range(1000))


def test_truncations(spark):
    df = frame(spark, [(list(range(7)),)], "a array<int>")
    for how, expected in (("left", [2, 3, 4, 5, 6]), ("right", [0, 1, 2, 3, 4]), ("middle", [0, 1, 4, 5, 6])):
        assert df.select(A.truncate(F.col("a"), 5, how)).first()[0] == expected
    with pytest.raises(Exception, match="more than"):
        df.select(A.truncate(F.col("a"), 5, "error")).collect()
    assert df.select(A.fit_length(F.col("a"), 9, 0, left_pad=False)).first()[0] == [*range(7), 0, 0]


def test_partitions():
    random.seed(3)
    for equal in (False, True):
        sizes = [random.randint(1, 1000) for _ in range(48)]
        parts = partition.karmarkar_karp(sizes, 6, equal)
        assert sorted(i for p in parts for i in p) == list(range(48))
        loads = [sum(sizes[i] for i in p) for p in parts]
        assert max(loads) - min(loads) <= 0.05 * sum(sizes)
        assert not equal or {len(p) for p in parts} == {8}
    assert partition.least_loaded([5, 1, 1, 1], 2) == [[0], [1, 2, 3]]
    with pytest.raises(ValueError):
        partition.karmarkar_karp([1, 2, 3], 2, True)


def test_group_balance_keeps_runs(spark):
    lengths = [100] * 4 + [200] * 4 + [150] * 4 + [50] * 4
    rows = [(k, 0, k // 4, n) for k, n in enumerate(lengths)]
    out = partition.group_balance(frame(spark, rows, "row_id bigint, batch int, uid int, n bigint"), "batch", "uid", "n", 2).collect()
    by = {}
    for r in out:
        by.setdefault(r["uid"], set()).add(r["part"])
    assert len(out) == 16 and all(len(p) == 1 for p in by.values()) and sorted(sum(next(iter(p)) == k for p in by.values()) for k in (0, 1)) == [2, 2]


def test_majority(spark):
    rows = [(0, 0, "A", 0.9), (0, 1, "B", 0.8), (0, 2, "A", 0.7), (1, 0, "A", 0.9), (1, 1, "B", 0.8), (1, 2, "B", 0.7), (1, 3, "A", 0.6)]
    out = metrics.majority(frame(spark, rows, "g int, pos int, pred string, v double"), ("g",), "pred", "v").orderBy("g").collect()
    assert [r["value"] for r in out] == [0.9, 0.9]


def test_math_answers(spark):
    rows = [
        (r"so \boxed{\frac12}", r"\frac{1}{2}", 1.0),
        (r"\boxed{\sqrt3}", r"\sqrt{3}", 1.0),
        (r"\boxed{0.5}", r"\frac{1}{2}", 1.0),
        (r"\boxed{x=5}", "5", 1.0),
        (r"\boxed{{a}", "a", 0.0),
        (r"\boxed 7$ more", "7", 1.0),
        ("nothing", "7", 0.0),
        (r"\boxed{50\%}", "50", 1.0),
    ]
    out = frame(spark, rows, "s string, t string, e double").select(S.boxed_score(F.col("s"), F.col("t")), "e").collect()
    assert [r[0] for r in out] == [r[1] for r in out]


def test_question_answers(spark):
    df = frame(spark, [("<answer> The Beijing. </answer>", ["beijing"]), ("no tags", ["x"]), ("<answer>big beijing</answer>", ["Beijing"])], "s string, g array<string>")
    assert [r[0] for r in df.select(S.question_score(F.col("s"), F.col("g"))).collect()] == [1.0, 0.0, 0.0]
    assert [r[0] for r in df.select(S.question_score(F.col("s"), F.col("g"), part=True)).collect()] == [1.0, 0.0, 1.0]


def test_multiset_jaccard(spark):
    df = frame(spark, [(["a", "a", "b"], ["a", "b", "b"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(A.multiset_jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0]


def test_safe_number():
    assert S.safe_number("1,234") == 1234 and S.safe_number("2^3") == 8 and S.safe_number("50%") == 0.5
    assert S.safe_number("__import__('os')") is None and S.safe_number("9**9**9**9") is None and S.safe_number(None) is None


def test_tool_formats(spark):
    text = "<think>t</think>\n<tool_call>\n{}\n</tool_call>"
    df = frame(spark, [(text, "<tool_call>"), (text, "<response>"), (text + text, "<tool_call>")], "r string, a string")
    assert [r[0] for r in df.select(S.tool_format(F.col("r"), F.col("a"))).collect()] == [1.0, 0.0, 0.0]


def test_xml_and_channel_calls(spark):
    xml = "<function=find>\n<parameter=q>\na b\n</parameter>\n<parameter=n>\n3\n</parameter></function><function=stop>"
    channel = "<|channel|>analysis<|message|>x<|end|>to=functions.find <|constrain|>json<|message|>{\"q\": 1}<|call|>"
    df = frame(spark, [(xml, channel)], "x string, c string")
    calls = df.select(T.xml_calls(F.col("x"))).first()[0]
    assert [c["name"] for c in calls] == ["find", "stop"] and json.loads(calls[0]["arguments"]) == {"q": "a b", "n": "3"}
    assert [tuple(c) for c in df.select(T.channel_calls(F.col("c"))).first()[0]] == [("find", '{"q": 1}')]


def test_token_bucket():
    b = rewards.TokenBucket(2.0)
    assert b.acquire(0.0) == 0 and b.acquire(0.0) == 0 and b.acquire(0.0) == 0.5
    assert rewards.TokenBucket(1.0, 5.0).acquire(0.0, 8.0) == 3.0
    with pytest.raises(ValueError):
        rewards.TokenBucket(0)


def test_rate_limited(spark):
    def call(text):
        if text == "bad":
            raise RuntimeError(text)
        return len(text)

    out = rewards.rate_limited(frame(spark, [("abc",), ("bad",)], "t string"), call, "t", 60000).collect()
    assert sorted((r["reward"], r["failed"]) for r in out) == [(0.0, True), (3.0, False)]


def test_stratified_sample(spark):
    df = spark.range(100).withColumn("good", F.col("id") < 10)
    out = sampling.stratified(df, "good", 40, 0.5, 1, "id").groupBy("good").count().collect()
    assert {r["good"]: r["count"] for r in out} == {True: 10, False: 30}


def test_kl_controller():
    c = advantage.kl_controller("adaptive", 0.1, 0.2, 100)
    c.update(0.3, 10)
    assert c.value == pytest.approx(0.1 * 1.02)
    with pytest.raises(NotImplementedError):
        advantage.kl_controller("other", 0.1)


def run_stream(spark, tmp_path, build, mode):
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        (folder / f"{part}.json").write_text("".join(json.dumps({"k": n % 2, "n": n, "good": n % 3 == 0, "v": f"e{n}"}) + "\n" for n in range(part * 10, part * 10 + 10)))
        time.sleep(0.01)
    stream = spark.readStream.schema("k int, n bigint, good boolean, v string").option("maxFilesPerTrigger", 1).json(str(folder))
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_queue_stream(spark, tmp_path):
    rows = run_stream(spark, tmp_path, lambda s: stateful.queue_stream(s, "k", "n", "v", 4), "update")
    last = {r["k"]: r for r in sorted(rows, key=lambda r: r["produced"])}
    assert json.loads(last[0]["entries"]) == ["e22", "e24", "e26", "e28"] and last[0]["dropped"] == 11


def test_count_window_stream(spark, tmp_path):
    rows = run_stream(spark, tmp_path, lambda s: stateful.count_window_stream(s, "k", "n", "n", 4), "append")
    assert sorted((r["k"], r["window"], r["total"]) for r in rows)[:3] == [(0, 0, 12.0), (0, 1, 44.0), (0, 2, 76.0)] and len(rows) == 6


def test_ring_pool_stream(spark, tmp_path):
    rows = run_stream(spark, tmp_path, lambda s: stateful.ring_pool_stream(s, "k", "good", "n", "v", 2), "update")
    final = [r for r in rows if r["k"] == 0][-1]
    assert sorted(json.loads(final["positives"])) == ["e18", "e24"] and sorted(json.loads(final["negatives"])) == ["e26", "e28"]


def test_tool_calls_of_all_events(spark, sf_dir):
    from millrace.plans.catalog import QUERIES

    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    found = QUERIES["tool_call_table"](spark, sf_dir).groupBy("k").count().collect()
    assert len(found) == events and {r["count"] for r in found} == {2}


def test_scores_of_all_sources(spark):
    tag = "<answer>The Paris.</answer>"
    rows = [
        ("HuggingFaceH4/MATH-500", r"so \boxed{\frac12}", r"\frac{1}{2}", 1.0),
        ("searchR1_nq", tag, '{"target": ["London", "paris"]}', 1.0),
        ("searchR1_popqa", tag, '{"target": "paris"}', 1.0),
        ("searchR1_musique", tag * 6, "paris", 1.0),
        ("searchR1_bamboogle", tag * 11, '["paris"]', 0.25),
        ("searchR1_hotpotqa", "Paris", '["paris"]', 0.0),
        ("numina_olympiads", "So the answer is 1,234", "1234", 1.0),
        ("numina_cn_k12", r"Step 2: \boxed{x = 3/4}", r"\frac{3}{4}", 1.0),
        ("numina_amc_aime", "The answer is 2/4", "1/2", 1.0),
        ("numina_aops_forum", r"\boxed{(1, 2+3)}", "(1,5)", 1.0),
        ("numina_synthetic_amc", r"\boxed{6.28}", r"2\pi", 1.0),
        ("numina_synthetic_math", "Answer: 5 meters", "7", 0.0),
        ("hiyouga/geometry3k", r"<think>a</think> \boxed{12}", "12.0", 1.0),
        ("hiyouga/geometry3k", r"\boxed{12}", "13", 0.0),
        ("aime2024", "Answer: 7", "7", 1.0),
        ("numina_cn_k12", None, "7", 0.0),
    ]
    df = frame(spark, rows, "source string, solution string, truth string, expected double")
    got = df.select("source", "solution", "expected", S.score_by_source(F.col("source"), F.col("solution"), F.col("truth")).alias("score")).collect()
    assert not [r for r in got if r["score"] is None or abs(r["score"] - r["expected"]) > 1e-9]
    assert not S.grading.same_in_parts("2/4", "1/2") and S.grading.same_answers("2/4", "1/2")  # fractions must be reduced; only values agree


def test_tool_reward(spark):
    one, two = '{"name": "f", "parameters": {"a": 1, "b": 2}}', '{"name": "f", "parameters": {"a": 1, "c": 2}}'
    answer = f"<think>x</think>\n<tool_call>\n{one}\n</tool_call>"
    partly = 6 * (1 + 1 / 3 + 1) / 4 - 3  # names 1, parameter names 1/3, one value, of 1 + 1 + 2
    rows = [(answer, answer, 4.0), (answer.replace(one, two), answer, 1 + partly), ("no", answer, -3.0), (answer, "<think>x</think>", 0.0), ("<think>y</think>", "<think>x</think>", 1.0)]
    df = frame(spark, [(f"<|im_start|>user hi<|im_end|><|im_start|>assistant\n{r}<|im_end|>", a, e) for r, a, e in rows], "solution string, answer string, expected double")
    for r in df.select("expected", S.tool_reward(F.col("solution"), F.col("answer"), "qwen").alias("got")).collect():
        assert abs(r["got"]["score"] - r["expected"]) < 1e-9, r
