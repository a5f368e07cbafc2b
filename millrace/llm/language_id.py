"""Language identification: text likelihoods, declared language, address and host priors in one posterior."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fingerprints import wide_hash
from .shared import BROADCAST_ROWS, free_name, limited_to, materialize, table

#: Buckets of hashed byte trigrams (a power of two).
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: A text counts as so many independent trigrams at most, as neighbours aren't independent.
EFFECTIVE = 150
#: Pseudo-counts of the parent's distribution in a host's and a domain's.
HOST_WEIGHT, DOMAIN_WEIGHT = 8.0, 32.0
#: Pseudo-counts in the likelihoods of declared languages and address suffixes.
DECLARED_WEIGHT = 2.0
#: A host with more than this share of the rows is hot; fewer than its reciprocal can be.
HOT_SHARE = 1 / 64
#: Most languages that labels may name; each is one row of BUCKETS numbers on every executor.
MAX_LANGUAGES = 200
UNKNOWN = "und"
LEAST_POSTERIOR = 0.5

#: Country suffixes of addresses and the language that they suggest (fixed values).
SUFFIX_LANGUAGE = {
    "de": "de", "at": "de", "li": "de", "fr": "fr", "mc": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es",
    "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh",
}
_MARKUP = r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>"
_DECLARED = r"(?is)<(?:html|body)\b[^>]*?\slang=[\x22']?([a-z]{2,3})|http-equiv=[\x22']?content-language[\x22']?[^>]*?content=[\x22']?([a-z]{2,3})"


def trigram_buckets(text: str) -> np.ndarray:
    """Bucket of each trigram of the lowercased UTF-8 text, with a space at either end."""
    b = np.frombuffer(b" " + text.lower().encode() + b" ", dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, dtype=np.uint32)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = held.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            counts += np.bincount(trigram_buckets(text.as_py() or ""), minlength=BUCKETS)
    for lang, counts in held.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["lang", "bucket", "n"])


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of each bucket, from all rows that name a language.

    Counts are summed in each task and then over all; languages * BUCKETS numbers come to the driver. More than
    MAX_LANGUAGES languages raise an error; without a column of that name no row names one.
    """
    if lang_col.lower() not in {c.lower() for c in df.columns}:
        return [], np.zeros((0, BUCKETS), dtype=np.float32)
    named = df.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    if named.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_col}")
    counted = named.mapInArrow(_trigram_counts, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table_ = counted.toArrow()
    if not table_.num_rows:
        return [], np.zeros((0, BUCKETS), dtype=np.float32)
    held = pa.concat_arrays(table_.column("lang").chunks).dictionary_encode()
    names = held.dictionary.to_pylist()
    languages = sorted(names)
    counts = np.full((len(languages), BUCKETS), SMOOTHING)
    row = np.array([languages.index(x) for x in names])[held.indices.to_numpy()]
    counts[row, table_.column("bucket").to_numpy()] += table_.column("n").to_numpy()
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def softmax(logs: np.ndarray) -> np.ndarray:
    """Each row's exponentials as shares of their sum."""
    raised = np.exp(logs - logs.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _rows(values: pa.Array, n: int) -> np.ndarray:
    """An array column of ``n`` numbers a row as a matrix; null rows are all 0."""
    return np.array([x if x is not None else [0.0] * n for x in values.to_pylist()], dtype=np.float64).reshape(-1, n)


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.array(list(matrix), pa.list_(pa.float64()))


def likelihoods(df: DataFrame, text_col: str, logs: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` and ``scores``: the tempered log likelihood of each language and, last, of none (every bucket alike);
    ``alone``, what they say by themselves as probabilities; and ``blank``, whether there is no text to say anything.
    """
    schema = df.select(*keep).schema
    held = df.sparkSession.sparkContext.broadcast(logs)  # at most MAX_LANGUAGES * BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        none = -math.log(BUCKETS)
        for batch in batches:
            scores = np.zeros((batch.num_rows, len(own) + 1))
            blank = np.ones(batch.num_rows, dtype=bool)
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                buckets = trigram_buckets(text.as_py() or "")
                n = len(buckets)
                if n <= 1 or not len(own):
                    continue
                counts = np.bincount(buckets, minlength=BUCKETS)
                some = np.flatnonzero(counts)
                blank[k] = False
                scores[k, :-1] = own[:, some] @ counts[some] * (min(n, EFFECTIVE) / n)
                scores[k, -1] = none * min(n, EFFECTIVE)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, _lists(scores), _lists(softmax(scores)), pa.array(blank)], names=[*keep, "scores", "alone", "blank"])

    numbers = T.ArrayType(T.DoubleType())
    return df.select(*keep, F.col(text_col)).mapInArrow(score, schema.add("scores", numbers).add("alone", numbers).add("blank", T.BooleanType()))


def _sums(column: str, n: int) -> list[Column]:
    return [F.sum(F.col(column)[k]).alias(f"s{k}") for k in range(n)]


def posteriors(scores, alone, host, domain, world, declared, suffix) -> np.ndarray:
    """Posterior of each row over the languages and none, from matrices with a row each.

    ``scores`` are log likelihoods of the text, ``alone`` its posterior by itself; ``host``, ``domain`` and ``world``
    are sums of ``alone`` over all rows of the row's host, domain and of the table (rows without a host or domain: the
    level above's alone, marked by sums of 0). ``declared`` and ``suffix`` are pairs: sums of ``alone`` over all
    rows with the row's value, and sums over all rows with any value beside the number of values (or zeros). A
    row's own share is taken out of all of them.
    """
    def without(sums: np.ndarray) -> np.ndarray:
        return np.maximum(sums - alone, 0.0)

    everywhere = without(world) + 1.0
    prior = everywhere / everywhere.sum(axis=1, keepdims=True)
    for sums, weight in ((domain, DOMAIN_WEIGHT), (host, HOST_WEIGHT)):
        there = sums.sum(axis=1, keepdims=True) > 0
        rest = np.where(there, without(sums), 0.0)
        prior = (rest + weight * prior) / (rest.sum(axis=1, keepdims=True) + weight)
    logs = scores + np.log(prior + 1e-9)
    for own, every, values in (declared, suffix):
        said = own.sum(axis=1, keepdims=True) > 0
        likely = (without(own) + DECLARED_WEIGHT) / (without(every) + DECLARED_WEIGHT * np.maximum(values, 1.0))
        logs = logs + np.where(said, np.log(likely), 0.0)
    return softmax(logs)


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """``lang`` and ``posterior`` for rows (row, host, domain, declared, suffix, blank, scores, alone) beside their other columns.

    Text posteriors summed by host, domain and over all give priors, each level smoothed by the one above; the same
    sums by declared language and by suffix give their likelihoods. A row's own share is taken out of all these sums, so
    no evidence counts twice. Null evidence says nothing; a row without text, declared language and suffix is
    ``und`` with the posterior of that. Sums of hosts are joined by shuffle but for hot hosts, each with HOT_SHARE
    of all rows or more, which therefore are few and are broadcast.
    """
    n = len(languages) + 1
    s = [f"s{k}" for k in range(n)]
    rows = materialize(evidence, "evidence")
    hosts = materialize(rows.where("host is not null").groupBy("host", "domain").agg(F.count("*").alias("n"), *_sums("alone", n)), "hosts")
    total = rows.agg(F.count("*").alias("n"), *_sums("alone", n)).first()
    world = np.array([total[c] or 0.0 for c in s])
    counts = F.array(*s)
    domains = hosts.where("domain is not null").groupBy("domain").agg(*[F.sum(c).alias(c) for c in s]).select("domain", counts.alias("domain_sums"))
    by_host = hosts.groupBy("host").agg(F.sum("n").alias("n"), F.max("domain").alias("domain"), *[F.sum(c).alias(c) for c in s])
    by_host = materialize(by_host.join(domains, "domain", "left").select("host", "n", counts.alias("host_sums"), "domain_sums"), "priors")
    hot = by_host.where(F.col("n") >= max(1.0, HOT_SHARE * (total["n"] or 0))).drop("n")
    is_hot = F.coalesce(F.col("host").isin([r["host"] for r in hot.select("host").collect()]), F.lit(False))
    plain = rows.where(F.col("host").isNotNull() & ~is_hot).join(by_host.drop("n"), "host")
    nowhere = rows.where("host is null")
    joined = plain.unionByName(rows.where(is_hot).join(F.broadcast(hot), "host")).unionByName(nowhere, allowMissingColumns=True)

    def said(column: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Sums by the value of ``column``, of which there are at most languages + 1."""
        found = {r[column]: np.array([r[c] for c in s]) for r in rows.where(F.col(column).isNotNull()).groupBy(column).agg(*_sums("alone", n)).collect()}
        return found, sum(found.values(), np.zeros(n))

    tables = {c: said(c) for c in ("declared", "suffix")}
    names = [*languages, UNKNOWN]
    keep = [c for c in rows.columns if c not in ("scores", "alone", "blank")]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores, alone, host, domain = (_rows(batch.column(c), n) for c in ("scores", "alone", "host_sums", "domain_sums"))
            pairs, silent = [], batch.column("blank").to_numpy(zero_copy_only=False).copy()
            for c, (found, every) in tables.items():
                values = batch.column(c).to_pylist()
                own = np.array([found[v] if v is not None else np.zeros(n) for v in values])
                pairs.append((own, np.broadcast_to(every, own.shape), float(len(found))))
                silent &= np.array([v is None for v in values])
            posterior = posteriors(scores, alone, host, domain, np.broadcast_to(world, alone.shape), *pairs)
            best = np.where(silent, n - 1, posterior.argmax(axis=1))
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([names[k] for k in best], pa.string()), pa.array(posterior[np.arange(len(best)), best])], names=[*keep, "lang", "posterior"])

    schema = rows.select(*keep).schema.add("lang", T.StringType()).add("posterior", T.DoubleType())
    return joined.select(*rows.columns, "host_sums", "domain_sums").mapInArrow(decide, schema)


def address_parts(url: Column, languages: list[str]) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and the language that the last label or the first path folder suggests."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    folder = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([A-Za-z]{2})(?:/|$)", 1))
    by_suffix = F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair]), F.substring_index(host, ".", -1))
    known = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    return host, F.substring_index(host, ".", -2), F.when(F.array_contains(known, folder), folder).otherwise(by_suffix)


def declared_language(html: Column) -> Column:
    """The language that markup declares, or null."""
    found = F.lower(F.coalesce(F.nullif(F.regexp_extract(html, _DECLARED, 1), F.lit("")), F.nullif(F.regexp_extract(html, _DECLARED, 2), F.lit(""))))
    return found


def page_evidence(pages: DataFrame, languages: list[str], logs: np.ndarray) -> DataFrame:
    """Evidence of web pages (page_id, url, html)."""
    host, domain, suffix = address_parts(F.col("url"), languages)
    declared = declared_language(F.col("html"))
    known = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    source = pages.select(
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("row"), F.lit(None).cast("bigint").alias("doc_id"), F.col("page_id").cast("bigint").alias("page_id"),
        host.alias("host"), domain.alias("domain"), F.when(F.array_contains(known, declared), declared).when(declared.isNotNull(), "other").alias("declared"), suffix.alias("suffix"),
        F.regexp_replace(F.coalesce("html", F.lit("")), _MARKUP, " ").alias("body"),
    )
    return likelihoods(source, "body", logs, EVIDENCE)


def document_evidence(docs: DataFrame, languages: list[str], logs: np.ndarray, key: Column | None = None) -> DataFrame:
    """Evidence of plain documents: their text, and their source as host; ``key``, a string, names a row instead of its id."""
    key = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) if key is None else key
    nothing = F.lit(None).cast("string")
    source = docs.select(
        key.alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("page_id"),
        (F.col("source").cast("string") if "source" in docs.columns else nothing).alias("host"), nothing.alias("domain"), nothing.alias("declared"), nothing.alias("suffix"), F.coalesce("text", F.lit("")).alias("body"),
    )
    return likelihoods(source, "body", logs, EVIDENCE)


EVIDENCE = ["row", "doc_id", "page_id", "host", "domain", "declared", "suffix"]


def identify(spark: SparkSession, docs: DataFrame, pages: DataFrame | None = None, labelled: DataFrame | None = None, key: Column | None = None) -> DataFrame:
    """One row for each document and page: doc_id or page_id, host, declared, suffix, lang, posterior and kept.

    Likelihoods are trained on the rows of ``labelled`` (by default ``docs``) that name a language; a text of more than
    EFFECTIVE trigrams has its likelihood scaled to that many, as neighbours aren't independent. A row is kept
    unless no language is likeliest or the posterior is under LEAST_POSTERIOR. Null and empty texts have no text
    evidence and, with no other evidence than their host's, are not kept; equal rows get equal results; without
    labelled rows, or a column ``lang``, every language is ``und``; without a column ``source`` documents have no
    host; empty tables give no rows; other columns are ignored. Labels may name MAX_LANGUAGES languages at most; for more
    an error is raised, and nothing is judged. With ``key``, a string, there is a column ``row`` that has it for documents.
    """
    languages, logs = train(docs if labelled is None else labelled)
    evidence = document_evidence(docs, languages, logs, key)
    if pages is not None:
        evidence = evidence.unionByName(page_evidence(pages, languages, logs))
    return fuse(evidence, languages).select(*(["row"] if key is not None else []), "doc_id", "page_id", "host", "declared", "suffix", "lang", "posterior").withColumn(
        "kept", (F.col("lang") != UNKNOWN) & (F.col("posterior") >= LEAST_POSTERIOR)
    )


def keep_documents(spark: SparkSession, docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is clear, ids being ignored.

    A verdict follows from text and source alone, so rows are known again by a 128-bit hash of both; null counts as empty
    text, a missing column ``source`` as null. More than MAX_LANGUAGES languages raise an error. If no row of ``labelled`` (by default ``docs``) names a language, or
    the column is missing, nothing can be judged and all rows stay. Repeated rows share their verdict.
    """
    known = docs if labelled is None else labelled
    if "lang" not in known.columns or known.where("lang is not null").isEmpty():
        return docs
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    both = F.concat(F.coalesce(F.length(source).cast("string"), F.lit("")), F.lit(":"), F.coalesce(source, F.lit("")), F.coalesce("text", F.lit("")))
    held = free_name(docs, "__rejected__")
    with_ids = docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    rejected = identify(spark, with_ids, labelled=labelled, key=wide_hash(both)).where("not kept").select(F.col("row").alias(held)).distinct()
    return limited_to(docs, wide_hash(both), materialize(rejected, "rejected"), "left_anti", BROADCAST_ROWS)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``identify`` of all documents and pages; null, empty and repeated rows, and more than MAX_LANGUAGES languages, as stated there."""
    return identify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
