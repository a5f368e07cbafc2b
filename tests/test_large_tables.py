"""What only tables larger than the test tables have: large keys, long rows, ties where parts are cut."""

from __future__ import annotations

import compare
from pyspark.sql import functions as F

from millrace.plans import catalog


def _held(spark, folder, con_name, df):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{con_name}.parquet")


def test_scores_of_large_keys(spark, tmp_path):
    """Beyond 10,000 a neighbouring number is within a scorer's tolerance of 1e-4."""
    _held(spark, tmp_path, "orders", spark.range(600).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7919 % 3_000_000).alias("o_custkey")))
    assert not compare.difference(catalog.QUERIES["source_scores"](spark, str(tmp_path)), compare.connect(str(tmp_path)), catalog.ORACLE_SQL["source_scores"])


def test_ties_where_a_stream_is_cut(spark, tmp_path):
    """Turns of the same time as the last turn of a part aren't late."""
    k = F.col("id")
    _held(spark, tmp_path, "conversations", spark.range(36).select(((k % 12) * 1000).alias("conv_id"), F.floor(k / 12).alias("turn"), F.repeat(F.lit("x"), (k % 9).cast("int")).alias("text")))
    sql = catalog.ORACLE_SQL["stream_tool_sessions"]
    assert not compare.difference(catalog.QUERIES["stream_tool_sessions"](spark, str(tmp_path)), compare.connect(str(tmp_path)), sql)


def test_repeated_answers_are_graded_once(monkeypatch):
    """A worker compares each pair of answers once, however many rows have it; very long ones aren't kept."""
    import pandas as pd

    from millrace.functions import grading

    asked = []
    monkeypatch.setattr(grading, "same_answers", lambda g, t: asked.append(g) or len(g) == len(t))
    given, truth = pd.Series(["x+y", "x", None, "a" * 3000] * 50), pd.Series(["2+y", "z+1", "1", "b" * 3000] * 50)
    out = grading._graded.func(given, truth, given, truth)
    assert out["in_value"].tolist() == [True, False, False, True] * 50 and not out["in_parts"].any()
    assert asked.count("x+y") == asked.count("x") == 1 and len(asked) == 52


def test_groups_of_a_size_are_scored_together():
    """A batch's groups are scored a size and sample size at a time, with the scores of each alone."""
    import numpy as np

    from millrace.operators import metrics

    draw = np.random.default_rng(8)
    values, labels = draw.random((50, 5)), draw.integers(0, 3, (50, 5))
    places = metrics.drawn_places(5, 4, 30, 1)
    together = metrics.group_scores(values, labels, places)
    for g in range(50):
        for a, b in zip(together, metrics.sampled_scores(values[g], labels[g].tolist(), places), strict=True):
            assert (a[g] == b).all()
        codes = labels[g][places]
        votes = [max(dict.fromkeys(row), key=row.count) for row in codes.tolist()]  # of equals the first drawn
        assert (together[2][g] == [values[g][p[c.index(v)]] for p, c, v in zip(places, codes.tolist(), votes, strict=True)]).all()
