"""Retrieval by words: an inverted index in blocks of documents, searched with upper bounds of whole blocks.

A row of the index is a block: its documents, its terms, and how often each document has each. Queries come to the blocks in
packs. A query's bound in a block is the sum of its terms' largest impacts there; a task scores a block only for queries whose
bound reaches the k-th best score that it has met so far, and returns the best of all its blocks. Queries and postings are
tables throughout: nothing of them comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import written

#: Words (fixed value) and the parameters of the ranking function.
WORD = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
#: Units of a document's part of an impact, and of a term's weight.
PARTS, WEIGHTS = 1_000_000, 1_000
#: Documents of a block, on average.
BLOCK_DOCS = 512
#: Queries of a pack, on average; most that are broadcast (more are dealt over tasks by shuffle); packs that a task keeps unpacked.
PACK_QUERIES, BROADCAST_QUERIES, PACKS = 1024, 4096, 64
#: Found rows that a task gathers before it keeps the best of them, and that it keeps before it returns them.
GATHERED, HELD = 100_000, 1_000_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _listed(values) -> pa.Array:
    """One row that holds all ``values``."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(rows: pa.Table) -> pa.Table:
    """A block's row of the index, documents in their order; rows that repeat a key are one document. Without words there is no row."""
    rows = rows.filter(pc.greater(pc.list_value_length(rows.column("words")), 0))
    keys, words = rows.column("doc").combine_chunks(), rows.column("words").combine_chunks()
    different = pc.unique(keys)
    docs = different.take(pc.sort_indices(different))
    place = np.repeat(pc.index_in(keys, value_set=docs).to_numpy(), pc.list_value_length(words).to_numpy())
    coded = words.flatten().dictionary_encode()
    pairs, times = np.unique(coded.indices.to_numpy().astype(np.int64) * len(docs) + place, return_counts=True)
    columns = [_listed(docs), _listed(np.bincount(place, minlength=len(docs)).astype(np.int64)), _listed(coded.dictionary)]
    columns += [_listed(x.astype(np.int32)) for x in (np.bincount(pairs // len(docs), minlength=len(coded.dictionary)), pairs % len(docs), times)]
    block = rows.column("block").combine_chunks()[:1]
    return pa.Table.from_arrays([block, *[c[: len(block)] for c in columns]], ["block", "docs", "lengths", "terms", "held", "places", "times"])


def build_index(docs: DataFrame, key: str, text: str, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, int]:
    """(block, docs, lengths, terms, held, places, times), written, and the number of documents in it.

    A term of a block is held by so many documents (``held``), whose places in ``docs`` and occurrences follow one another in
    the order of terms. Documents without words or key are not in it; rows that repeat a key are one document. Documents are
    dealt into blocks by hash, so no block grows with a common word. Texts are shuffled once, as they are, and read once
    for their words.
    """
    blocks = max(1, -(-docs.count() // block_docs))
    dealt = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"))
    found = dealt.repartition("block").sortWithinPartitions("block").select("block", "doc", words_of(F.col("text")).alias("words"))  # a filter here would go under the shuffle and look for words twice
    schema = f"block bigint, docs array<{docs.schema[key].dataType.simpleString()}>, lengths array<bigint>, terms array<string>, held array<int>, places array<int>, times array<int>"
    index = written(found.groupBy("block").applyInArrow(_block, schema), "postings")
    return index, index.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0))).first()[0]


class _Pack:
    """A pack of queries in a task: each query's terms and weights, and its best scores so far."""

    def __init__(self, rows: pa.StructArray, k: int):
        query, term, weight = rows.flatten()
        self.queries = pc.unique(query)
        own = pc.index_in(query, value_set=self.queries).to_numpy()
        order = np.argsort(own, kind="stable")
        coded = term.take(pa.array(order)).dictionary_encode()
        self.terms, self.code = coded.dictionary, coded.indices.to_numpy()
        self.own, self.weight = own[order], weight.to_numpy()[order]
        self.tops = np.zeros((len(self.queries), k), np.int64)


def _impacts(times: np.ndarray, lengths: np.ndarray, mean: float) -> np.ndarray:
    """Integer parts of impacts: Okapi's ranking function, occurrences, saturated, by the document's length beside the mean."""
    tf = times.astype(np.float64)
    part = PARTS * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / mean))
    whole = np.floor(part)
    return (whole + (part - whole >= 0.5)).astype(np.int64)


def _score(pack: _Pack, k: int, terms: pa.Array, lengths, held, places, parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of documents, and scores, of a block's documents that may be among the best of a query."""
    at = pc.fill_null(pc.index_in(pack.terms, value_set=terms), -1).to_numpy()[pack.code]
    met = at >= 0
    at, own, weight = at[met], pack.own[met], pack.weight[met]
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    starts = np.concatenate([[0], np.cumsum(held)[:-1]]).astype(np.int64)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    bound = np.add.reduceat(weight * np.maximum.reduceat(parts, starts)[at], first)
    chosen = bound >= pack.tops[own[first]].min(axis=1)
    row = np.repeat(np.where(chosen, np.cumsum(chosen) - 1, -1), np.diff(first, append=len(own)))
    asks, n = own[first][chosen], held[at].astype(np.int64)
    at, weight, n, row = at[row >= 0], weight[row >= 0], n[row >= 0], row[row >= 0]
    posting = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    scores = np.zeros((len(asks), len(lengths)), np.int64)
    np.add.at(scores, (np.repeat(row, n), places[posting]), np.repeat(weight, n) * parts[posting])
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # of equals the smallest document
    top = np.take_along_axis(scores, best, axis=1)
    pack.tops[asks] = -np.sort(-np.concatenate([pack.tops[asks], top], axis=1), axis=1)[:, :k]
    q, place = np.nonzero((top > 0) & (top >= pack.tops[asks].min(axis=1)[:, None]))
    return asks[q], best[q, place], top[q, place]


def _kept(found: pa.Table, k: int) -> pa.Table:
    """The best ``k`` rows of each query."""
    found = found.take(pc.sort_indices(found, [("query", "ascending"), ("score", "descending"), ("doc", "ascending")]))
    own = pc.rank(found.column("query"), tiebreaker="dense").to_numpy() if found.num_rows else np.zeros(0)
    begins = np.maximum.accumulate(np.where(np.diff(own, prepend=0) != 0, np.arange(len(own)), 0))
    return found.filter(pa.array(np.arange(len(own)) - begins < k))


def _searched(mean: float, k: int):
    def search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, _Pack] = {}
        best, found, n = None, [], 0

        def cut() -> pa.Table:
            return _kept(pa.concat_tables([*([best] if best else []), *found]).combine_chunks(), k)

        for batch in batches:
            for r in range(batch.num_rows):
                name = batch.column("pack")[r].as_py()
                asked, docs, terms = (batch.column(c)[r].values for c in ("asked", "docs", "terms"))
                lengths, held, places, times = (batch.column(c)[r].values.to_numpy() for c in ("lengths", "held", "places", "times"))
                if name not in packs:
                    if len(packs) >= PACKS:
                        packs.clear()
                    packs[name] = _Pack(asked, k)
                pack = packs[name]
                q, d, score = _score(pack, k, terms, lengths, held, places, _impacts(times, lengths[places], mean))
                if len(q):
                    found.append(pa.table([pack.queries.take(pa.array(q)), docs.take(pa.array(d)), pa.array(score)], ["query", "doc", "score"]))
                    n += len(q)
                if n >= GATHERED:
                    best, found, n = cut(), [], 0
                    if best.num_rows >= HELD:
                        yield from best.to_batches()
                        best = None
        if best or found:
            yield from cut().to_batches()

    return search_blocks


def search(index: DataFrame, n_docs: int, queries: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(``key``, rank, doc, score) of the ``k`` best documents of each query; of equal scores the smaller doc comes first.

    ``n_docs`` is the number of documents with words. A word counts as often as the query has it. Queries whose words no
    document has get no rows; rows that repeat a key are one query.
    """
    words = written(queries.select(F.col(key).alias("query"), F.explode(words_of(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times")), "words")
    n = words.agg(F.countDistinct("query")).first()[0]
    few, spread = n <= BROADCAST_QUERIES, F.broadcast if n <= BROADCAST_QUERIES else lambda df: df
    posted = index.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.held").alias("held"))
    holders = posted.join(spread(words.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("held").alias("holders"))
    weight = F.round(WEIGHTS * F.log(1 + (F.lit(float(n_docs)) - F.col("holders") + 0.5) / (F.col("holders") + 0.5))).cast("bigint")
    asked = words.join(holders, "term").select("query", "term", (F.col("times") * weight).alias("weight")).where("weight > 0")
    total = index.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    packs = max(1, -(-n // PACK_QUERIES))
    packed = asked.groupBy(F.pmod(F.xxhash64("query"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("query", "term", "weight")).alias("asked"))
    if few:
        met = index.crossJoin(F.broadcast(packed))
    else:
        salts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = index.withColumn("salt_", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).join(packed.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "salt_")
    schema = f"query {queries.schema[key].dataType.simpleString()}, doc {index.schema['docs'].dataType.elementType.simpleString()}, score bigint"
    found = met.select("pack", "asked", "docs", "lengths", "terms", "held", "places", "times").mapInArrow(_searched(total / max(1, n_docs), k), schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc"))))
    return ranked.where(F.col("rank") <= k).select(F.col("query").alias(key), F.col("rank").cast("int").alias("rank"), "doc", "score")
