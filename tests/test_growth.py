"""What grows with the input: rows shuffled, rows read, memory of a task."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from millrace.operators import advantage, lexical, losses
from millrace.plans import catalog


@contextmanager
def stages_of(spark):
    """A list that holds the figures of the stages of the block once it has ended."""
    sc, found = spark.sparkContext, []

    def known():
        listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {s.stageId(): s for s in (listed.apply(k) for k in range(listed.size()))}

    before = set(known())
    yield found
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found += [s for k, s in known().items() if k not in before]


def test_postings_are_not_shuffled(spark):
    """Texts are shuffled a row each, and of the search a few rows a task, not a row a term of a document."""
    words = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(500)).cast("string")))
    docs = spark.range(3000).select("id", F.array_join(words, " ").alias("body"))
    with stages_of(spark) as stages:
        index, n = lexical.build_index(docs, "id", "body", 64)
        found = lexical.search(index, n, docs.limit(5), "id", "body", 3).collect()
    assert n == 3000 and len(found) == 15
    assert sum(s.shuffleWriteRecords() for s in stages) < 10 * 3000


def test_queries_that_are_many(spark, monkeypatch):
    """Packs that are shuffled instead of broadcast, and results that a task returns in parts, find the same."""
    words = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(40)).cast("string")))
    docs = spark.range(300).select("id", F.array_join(words, " ").alias("body"))
    index, n = lexical.build_index(docs, "id", "body", 8)
    want = sorted(lexical.search(index, n, docs, "id", "body", 4).collect())
    for name, value in {"PACK_QUERIES": 9, "BROADCAST_QUERIES": 10, "PACKS": 2, "GATHERED": 50, "HELD": 100}.items():
        monkeypatch.setattr(lexical, name, value)
    assert len(want) == 1200 and sorted(lexical.search(index, n, docs, "id", "body", 4).collect()) == want


@pytest.mark.parametrize("name", ["kl_cov", "clip_cov"])
def test_tokens_are_made_once(spark, name):
    """However many reads the cut takes, the rows are read once and no token is shuffled by its row."""
    k = F.col("id")
    long = spark.range(4000).select("id", F.transform(F.sequence(F.lit(0), k % 5), lambda j: (F.pmod(F.xxhash64("id", j), F.lit(1000)) / 1000).cast("double")).alias("old_logp"))
    rows = long.select(k.alias("row_id"), "old_logp", F.transform("old_logp", lambda v: 1 - v).alias("logp"), F.transform("old_logp", lambda v: 2 * v).alias("advantages"), F.transform("old_logp", lambda v: F.lit(1)).alias("mask"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    with stages_of(spark) as stages:
        loss = losses.policy_loss(rows.withColumn("row_id", counted.asNondeterministic()("row_id")), name, share=0.05, **({"least": -9.0, "most": 9.0} if name == "clip_cov" else {})).first()[0]
    assert loss is not None and seen.value == 4000
    assert sum(s.shuffleWriteRecords() for s in stages) < 3000


@pytest.mark.parametrize("share", [0.0, 0.1, 0.3, 0.5, 0.9, 1.0])
def test_cut_among_equals(spark, share):
    """Of tokens with equal values at the cut, and values that are null or NaN, those chosen are the first in order."""
    drawn = [(r, p, [None, float("nan"), 1.0, 2.0, 2.0, -0.0, 0.0][(r * 7 + p * 3) % 7]) for r in range(40) for p in range(5)]
    df = spark.createDataFrame(drawn, "row_id long, pos int, v double").repartition(3)
    ranked = sorted((t for t in drawn if t[2] is not None), key=lambda t: (0 if t[2] != t[2] else 1, -t[2] if t[2] == t[2] else 0, t[0], t[1]))
    k = int(share * len(ranked))
    found = {(r["row_id"], r["pos"]) for r in df.where(losses._highest(df, "v", k)).collect()}
    assert found == {t[:2] for t in ranked[:k]}


@pytest.mark.parametrize("dense", [False, True])
def test_rows_of_baselines_are_made_once(spark, dense):
    rows = spark.range(2000).selectExpr("id as row_id", "id % 90 as uid", *[f"transform(sequence(0, id % 4), j -> cast((id * 7 + j) % 5 as {kind})) as {c}" for c, kind in (("reward", "double"), ("old_logp", "double"), ("pi2", "double"), ("one", "int"))])
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    held = rows.withColumn("mask", F.transform("one", lambda v: F.lit(1))).withColumn("uid", counted.asNondeterministic()("uid"))
    assert advantage.optimal_token_baseline(held, dense=dense).select(F.sum(F.size("advantages"))).first()[0] == 5000 and seen.value == 2000


@pytest.mark.parametrize("dense", [False, True])
def test_scans_of_baselines(spark, dense):
    """Rows of all lengths against plain loops, exactly but for the exponential; after a null all is null."""
    import math
    import random

    draw = random.Random(3)
    rows = [(k, *[[draw.random() for _ in range(n)] for _ in range(4)], [draw.randint(0, 1) for _ in range(n)]) for k, n in enumerate([0, 1, 700, 300, *[draw.randint(0, 9) for _ in range(60)]])]
    rows[2][1][5] = rows[3][2][7] = None
    rows.append((99, None, [], [], [], []))
    df = spark.createDataFrame(rows, "row_id long, reward array<double>, old_logp array<double>, pi2 array<double>, w array<double>, mask array<int>").repartition(2)
    found = {r["row_id"]: r for r in advantage._baseline_arrays(df, "w", dense).collect()}
    assert len(found) == len(rows) and all(found[99][c] is None for c in ("togo_", "grown_", "places_"))
    for key, reward, logp, pi2, w, mask in rows[:-1]:
        togo, s = [], 0.0
        for r, m in zip(reward[::-1], mask[::-1], strict=True):
            s = None if s is None or r is None else s + r * m
            togo.append(s)
        grown, s, places, place = [], 0.0, [], -1
        for lp, p, x, m in zip(logp, pi2, w, mask, strict=True):
            s = None if s is None or lp is None else s + (1 - 2 * math.exp(lp) + p) * (x * x) * m
            place += m if dense else 1
            grown.append(s)
            places.append(place)
        assert found[key]["togo_"] == togo[::-1] and found[key]["places_"] == places
        assert len(grown) == len(found[key]["grown_"]) and all(a is b if b is None else a == pytest.approx(b, rel=1e-12) for a, b in zip(found[key]["grown_"], grown, strict=True))


def test_sketches_are_not_held_by_key(spark, tmp_path):
    """The exact count's distinct keys take some bytes each in a task, not a sketch each."""
    spark.range(200_000).select(F.col("id").alias("l_partkey")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    with stages_of(spark) as stages:
        assert catalog.QUERIES["approx_distinct"](spark, str(tmp_path)).collect()[0][0]
    assert max(s.peakExecutionMemory() for s in stages) < 96 << 20
