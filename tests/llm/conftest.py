from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

CLASHING = "kept boolean, ids string, spans string, rep long, root long, component long, window int, task string, digest string, score double, quality_rules string, row string, found int, bin int, salt int"


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """(id, text) of texts that are easily got wrong."""
    base = words(1, 200)
    edited = base.split()
    edited[100] = "changed"
    return [
        (1, base),
        (2, base),
        (2, base),  # a repeated row
        (3, " ".join(edited)),
        (4, None),
        (5, ""),
        (6, "   \n\t "),
        (7, words(2, 40_000)),
        (8, "a" * 30_000),
        (9, "x@y.zz, +49 (30) 1234-5678; 4111 1111 1111 1111 and 10.0.0.300 or 10.0.0.30 \U0001f600 a@b.c_d@e.f"),
        (10, "one two"),
        (11, "é ﬁ İ STRASSE straße é " + words(3, 60)),
        (12, "the same line\n" * 80),
        (None, base),
        (None, None),
        (13, "a\x00b \x1c c d\n \n  e"),
        (14, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" +1 (377) 555-0271 ' + words(4, 30)),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    df = spark.createDataFrame(odd_texts, "doc_id bigint, text string").repartition(3)
    from pyspark.sql import functions as F

    extra = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in CLASHING.split(", "))]
    return df.select("*", F.when(F.col("doc_id") % 2 == 0, "en").alias("lang"), F.lit("src0").alias("source"), F.length("text").cast("bigint").alias("n_chars"), *extra)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
