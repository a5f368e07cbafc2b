"""The pipeline against plain versions of its stages."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
from test_llm import check_packed, classes, near_pairs, tokens_of

from millrace.llm import quality_rules
from millrace.llm.shared import materialize


def test_stages(spark, sf_dir, docs, texts):
    import zstandard

    press = zstandard.ZstdCompressor(level=quality_rules.LEVEL).compress
    limits = quality_rules.fit_limits(docs)
    good = {k for k, t in texts.items() if quality_rules.measure((t or "").encode(), press, **limits)[-1]}
    assert all(not brute.quality_base(texts[k])[-1] for k in good)
    stages = dict(corpus_pipeline.STAGES)
    kept = materialize(stages["quality_rules"](spark, docs, sf_dir))
    assert {r["doc_id"] for r in kept.collect()} == good and kept.columns == docs.columns
    spoken = materialize(stages["language_id"](spark, kept, sf_dir))
    assert spoken.columns == docs.columns and spoken.count() >= 0.99 * kept.count()
    left = {r["doc_id"]: r["text"] for r in spoken.collect()}
    alone = materialize(stages["near_duplicates"](spark, spoken, sf_dir))
    groups = classes(left, near_pairs(left))
    assert {r["doc_id"] for r in alone.collect()} == set(groups.values())
    private = materialize(stages["personal_data"](spark, alone, sf_dir))
    assert private.columns == docs.columns
    clean = {r["doc_id"]: r for r in private.collect()}
    for k, r in clean.items():
        assert r["n_chars"] == len(r["text"]) and not brute.base_spans(r["text"])
        if not brute.base_spans(left[k]) and "token =" not in left[k]:
            assert r["text"] == left[k]
    rows = stages["packing"](spark, private, sf_dir).collect()
    check_packed(rows, {k: [tokens_of(r["text"])] for k, r in clean.items()})


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(n == 1 for n in Counter((r["doc_id"], r["start"]) for r in rows).values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "personal_data", "packing"]


def test_stages_on_odd_rows(spark, sf_dir, odd_docs, odd_texts):
    """Nulls, repeated rows, clashing names and very long texts go through every stage on its own."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, sf_dir)
        assert out.columns == odd_docs.columns, name
        left = Counter(r["doc_id"] for r in out.collect())
        assert all(n <= Counter(k for k, _ in odd_texts)[k] for k, n in left.items()) and left[1] == 1, name
        if name in ("near_duplicates", "personal_data"):
            assert left[4] == left[5] == 1, name
    packed = corpus_pipeline.STAGES[-1][1](spark, odd_docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {k for k, _ in odd_texts}


def test_empty_tables(spark, docs, sf_dir, tmp_path):
    """Every query of the subpackage, and the pipeline, on tables without rows."""
    from millrace.llm import entry

    for name in ("documents", "pages", "labels", "benchmark", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in entry.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
