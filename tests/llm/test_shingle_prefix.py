"""The prefix of the join follows from its threshold, whatever links a table has."""

from __future__ import annotations

import random

from millrace.llm import shingle_join


def test_no_sample_decides(spark, monkeypatch):
    """Where nearly all links are near 1, those just at the threshold are still sought with the same prefix."""
    draw, asked = random.Random(4), []
    own = shingle_join.groups
    monkeypatch.setattr(shingle_join, "groups", lambda matched, depth, hooks: asked.append(depth) or own(matched, depth, hooks))
    word = lambda: f"w{draw.randint(0, 10**6)}"
    texts = {}
    for k in range(150):
        base = [word() for _ in range(400)]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join([*base, word()])
    out = shingle_join.shingle_join(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    assert asked == [shingle_join.prefix_depth(0.8, target=1 - 5e-5)] == [4]
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in out.collect()} == {(k, k - k % 2, 1) for k in texts}
