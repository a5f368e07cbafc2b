"""The bit-sliced index against SQL and brute force, and on odd and empty tables."""

from __future__ import annotations

import math
import re
from collections import Counter

import compare
import pytest
from pyspark.sql import functions as F

from millrace.llm import entry, ranked_search


def brute_ranks(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by plain loops."""

    def terms(text):
        return re.findall(ranked_search.TERM, (text or "").translate(str.maketrans(ranked_search.UPPER, ranked_search.LOWER)))

    held = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    held = [(doc_id, c) for doc_id, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    holders = Counter(t for _, c in held for t in c)
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, Counter()).update(terms(text))
    out = []
    for item_id, wanted in asked.items():
        scores = []
        for doc_id, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in wanted.items() if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def rows(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def test_against_sql(spark, sf_dir):
    assert not compare.difference(entry.QUERIES["op11_ranked_search"](spark, sf_dir), compare.connect(sf_dir), entry.ORACLE_SQL["op11_ranked_search"])


ITEMS = [(1, "One two TWO ONE one"), (2, None), (3, ""), (4, "the same line line"), (4, "token"), (None, "Straße é x"), (5, "zzzz nowhere"), (6, "a b c d e " * 400), (7, "one two"), (7, "one two")]


def test_odd_rows(spark, odd_docs, odd_texts):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("score", F.lit("own"))
    assert rows(ranked_search.ranked_search(odd_docs, items)) == brute_ranks(odd_texts, ITEMS)
    assert rows(ranked_search.ranked_search(odd_docs, items, k=1)) == brute_ranks(odd_texts, ITEMS, 1)


@pytest.mark.parametrize("block_docs", [1, 3, 70])
def test_blocks_ties_and_all_terms(spark, block_docs):
    """Many equal rows over several blocks and words of bitmaps; an index of all terms gives what one of the items' terms does."""
    docs = [(k % 90 if k % 7 else None, f"alpha{' beta' * (k % 3)} {'gamma' if k % 11 else ''} d{k % 5}") for k in range(200)]
    items = [(1, "alpha"), (2, "beta beta gamma"), (3, "d1 d2 alpha beta"), (4, "gamma " * 70)]
    table, asked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    index = ranked_search.build_index(table, block_docs=block_docs)
    assert index.agg(F.sum("with_terms")).first()[0] == 200
    for k in (1, 10, 64, 300):
        assert rows(ranked_search.search(index, ranked_search.item_terms(asked), k)) == brute_ranks(docs, items, k)


def test_chunks_of_items(spark, sf_dir, monkeypatch):
    """Many rows of items, met through a shuffle, and texts cut into slices."""
    monkeypatch.setattr(ranked_search, "CHUNK_TERMS", 50)
    monkeypatch.setattr(ranked_search, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(ranked_search, "BATCH_ITEMS", 3)
    monkeypatch.setattr(ranked_search, "KEPT_BYTES", 500)
    monkeypatch.setattr(ranked_search, "TERM_BYTES", 0)
    test_against_sql(spark, sf_dir)


def test_slices_of_long_texts(monkeypatch):
    monkeypatch.setattr(ranked_search, "SLICE_BYTES", 5)
    text = "ab cd-ab  éé longerthanfive\tab" * 3
    n, found = ranked_search.count_terms(text.encode())
    assert n == sum(found.values()) and {k.decode(): v for k, v in found.items()} == Counter(re.findall(ranked_search.TERM, text))


def test_empty(spark, no_docs, odd_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for docs, asked in ((no_docs, items), (odd_docs, items.limit(0)), (odd_docs.where("text is null"), items), (odd_docs, items.where("item_id in (2, 3, 5)"))):
        found = ranked_search.ranked_search(docs, asked)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and not found.collect()
