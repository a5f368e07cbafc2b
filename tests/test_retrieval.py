"""Retrieval by words and by vectors against exhaustive search."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import lexical, retrieval

TEXTS = [(n, " ".join(random.Random(n).choices(["common"] * 6 + [f"w{k}" for k in range(40)], k=random.Random(n).randint(1, 60)))) for n in range(300)]
TEXTS += [(300, None), (301, ""), (302, "Été ÉTÉ common"), (5, "w1 w1 w1"), (None, "w2 w3")]
QUERIES = [(1, "w1 w2 common"), (2, "common"), (3, "w1 w1 W9"), (4, None), (5, "nowhere"), (6, "été"), (7, "w3"), (7, "w4")]


def exhaustive(k):
    docs = {}
    for doc, text in TEXTS:
        words = [w.lower() for w in (text or "").split()]
        if words:
            docs.setdefault(doc, Counter()).update(words)
    mean = sum(sum(c.values()) for c in docs.values()) / len([d for d in docs if d is not None])
    n = len([d for d in docs if d is not None])
    asked = {}
    for q, text in QUERIES:
        asked.setdefault(q, Counter()).update(w.lower() for w in (text or "").split())
    holders = Counter(w for c in docs.values() for w in c)
    out = []
    for q, words in asked.items():
        scores = []
        for doc, c in docs.items():
            norm = 1 - lexical.B + lexical.B * sum(c.values()) / mean
            score = sum(t * round(lexical.WEIGHTS * np.log(1 + (n - holders[w] + 0.5) / (holders[w] + 0.5))) * round(lexical.PARTS * c[w] * (lexical.K1 + 1) / (c[w] + lexical.K1 * norm)) for w, t in words.items() if w in c)
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        out += [(q, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block_docs", "k"), [(8, 3), (8, 50), (1000, 10)])
def test_words(spark, block_docs, k):
    docs = spark.createDataFrame([t for t in TEXTS if t[0] is not None], "id int, body string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "q int, body string")
    index, n = lexical.build_index(docs, "id", "body", block_docs)
    found = [tuple(r) for r in lexical.search(index, n, queries, "q", "body", k).collect()]
    held = [t for t in TEXTS]
    TEXTS[:] = [t for t in held if t[0] is not None]
    try:
        assert sorted(found, key=str) == exhaustive(k)
    finally:
        TEXTS[:] = held


def test_no_documents(spark):
    docs, queries = spark.createDataFrame([(1, None)], "id int, body string"), spark.createDataFrame(QUERIES, "q int, body string")
    index, n = lexical.build_index(docs, "id", "body")
    assert n == 0 and lexical.search(index, n, queries, "q", "body", 5).collect() == []


@pytest.mark.parametrize("most", [4096, 10])
def test_vectors(spark, monkeypatch, most):
    """Also with queries that are too many to broadcast, and chunks of a few rows."""
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", most)
    monkeypatch.setattr(retrieval, "ROW_CHUNK", 7)
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(200, 5)).round(3)
    vectors[50] = vectors[51]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(200, None), (201, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    asked = df.where("vec_id % 4 = 2 or vec_id = 201")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {}
    for q in [k for k in range(200) if k % 4 == 2]:
        similar = np.append((unit @ unit[q]).round(12), 0.0)
        order = sorted((k for k in [*range(200), 201] if k != q), key=lambda k: (-similar[min(k, 200)], k))[:6]
        want[q] = order
    found = {}
    for r in retrieval.nearest(df, asked, 6, block=16).orderBy("query", F.desc("similarity"), "vec_id").collect():
        found.setdefault(r["query"], []).append(r["vec_id"])
    assert {q: v for q, v in found.items() if q != 201} == want and len(found[201]) == 6
    assert retrieval.nearest(df.limit(0), asked, 3).count() == 0 and retrieval.nearest(df, asked.limit(0), 3).count() == 0
