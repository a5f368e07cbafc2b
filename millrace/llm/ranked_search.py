"""Ranked lexical search over a bit-sliced impact index.

Documents are held in blocks. A term's impacts in a block are bit slices: one bitmap of documents for each bit of the
impact, kept over those machine words only that hold a document of the term. The terms of an item are added slice by
slice with carries, for many items at a time, and the best documents are found from the highest slice downwards.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import BROADCAST_ROWS, materialize, partitions, table

#: A term (fixed value): whatever is no ASCII character but a letter or digit.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8 to those of terms: small letters, and a space for what stands between terms.
_FOLD = bytes((b if b >= 128 or chr(b).isalnum() else 32) for b in bytes(range(256)).lower())
#: Most documents and about the most bytes of text in a block; a longer text is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 8192, 32_000_000
#: Texts are cut into terms so many bytes at a time.
SLICE_BYTES = 1_000_000
#: Items that are added together, and terms of items that one row of a query table holds, about.
BATCH_ITEMS, CHUNK_TERMS = 64, 20_000
#: Bytes of slices that are kept for the next item that has the term.
KEPT_BYTES = 16_000_000
#: Bytes of terms that go to every task, so that only their postings are written; for more, all postings are.
TERM_BYTES = 8_000_000

INDEX = "doc_ids binary, nulls int, lengths binary, with_terms bigint, all_terms bigint, terms array<string>, holders array<bigint>, places array<binary>, counts array<binary>"


def terms_of(text: Column) -> Column:
    """The terms of a text in order, with A to Z in lower case; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


# ---- the index


def count_terms(raw: bytes, among: frozenset | None = None) -> tuple[int, Counter]:
    """How many terms a text in UTF-8 has, and how often each of them (or of those ``among``) occurs."""
    n, found, at, raw = 0, Counter(), 0, raw.translate(_FOLD)
    while at < len(raw):
        end = raw.find(b" ", at + SLICE_BYTES) if len(raw) - at > SLICE_BYTES else len(raw)
        end = len(raw) if end < 0 else end
        terms = raw[at:end].split()
        n += len(terms)
        found.update(terms if among is None else filter(among.__contains__, terms))
        at = end
    return n, found


class _Builder:
    """A block of documents as they come; ``row`` gives the index's row, in which they stand by id, nulls last."""

    def __init__(self):
        self.ids, self.lengths, self.postings, self.bytes = [], array("q"), {}, 0

    def add(self, doc_id: int | None, raw: bytes, among: frozenset | None) -> None:
        n, found = count_terms(raw, among)
        for term, count in found.items():
            places, counts = self.postings.get(term) or self.postings.setdefault(term, (array("H"), array("I")))
            places.append(len(self.ids))
            counts.append(count)
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.bytes += len(raw)

    def row(self) -> pa.RecordBatch:
        order = np.array(sorted(range(len(self.ids)), key=lambda p: (self.ids[p] is None, self.ids[p] or 0)))
        moved = np.empty(len(order), np.uint16)
        moved[order] = np.arange(len(order))
        lengths = np.frombuffer(self.lengths, np.int64)[order]
        places, counts = [], []
        for held in self.postings.values():
            at = moved[np.frombuffer(held[0], np.uint16)]
            by = np.argsort(at)
            places.append(at[by].tobytes())
            counts.append(np.frombuffer(held[1], np.uint32)[by].tobytes())
        row = {
            "doc_ids": np.array([self.ids[p] or 0 for p in order], np.int64).tobytes(), "nulls": sum(x is None for x in self.ids), "lengths": lengths.tobytes(),
            "with_terms": int((lengths > 0).sum()), "all_terms": int(lengths.sum()), "terms": [t.decode() for t in self.postings], "holders": [len(p) // 2 for p in places],
            "places": places, "counts": counts,
        }
        return pa.RecordBatch.from_pylist([row], _INDEX_ARROW)


_INDEX_ARROW = pa.schema([
    ("doc_ids", pa.binary()), ("nulls", pa.int32()), ("lengths", pa.binary()), ("with_terms", pa.int64()), ("all_terms", pa.int64()),
    ("terms", pa.list_(pa.string())), ("holders", pa.list_(pa.int64())), ("places", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary())),
])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", among: Iterable[str] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """A table of blocks of documents with the postings of all their terms, or of those ``among``, written to the shared folder.

    Every row is indexed, repeated rows each for themselves; null and empty texts have no terms; ids are integers or null.
    Other columns, whatever their names, are not looked at; an empty table has no blocks.
    """
    if not 0 < block_docs <= 65536:
        raise ValueError("a block has 1 to 65,536 documents")
    wanted = None if among is None else frozenset(t.encode() for t in among)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Builder()
        for batch in batches:
            texts = batch.column(1)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                raw = texts[k].as_py() or b""
                if block.ids and (len(block.ids) >= block_docs or block.bytes + len(raw) > BLOCK_BYTES):
                    yield block.row()
                    block = _Builder()
                block.add(doc_id, raw, wanted)
        if block.ids:
            yield block.row()

    read = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return materialize(read.mapInArrow(blocks, INDEX), "impact_index")


# ---- queries


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, repeats): how often each item has each of its terms; rows that share an id are one item."""
    read = items.select(F.col(f"`{id_col}`").alias("item_id"), F.explode(terms_of(F.col(f"`{text_col}`"))).alias("term"))
    return read.groupBy("item_id", "term").agg(F.count("*").alias("repeats"))


def weight(holders: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * holders + 1).cast("double"))).cast("bigint")


class _Block:
    """A row of the index while items are looked up in it."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.known = len(self.ids) - row["nulls"]
        self.words = (len(self.ids) + 63) // 64
        self.m = 25 + 75 * np.frombuffer(row["lengths"], np.int64) * n_docs // n_terms
        self.at = {term: k for k, term in enumerate(row["terms"])}
        self.row, self.kept, self.free = row, {}, KEPT_BYTES

    def slices(self, term: str, w: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """(words, their slices from the lowest on, the largest impact) of a term; None if nothing here has an impact."""
        if term not in self.at:
            return None
        if term not in self.kept:
            places = np.frombuffer(self.row["places"][self.at[term]], np.uint16).astype(np.int64)
            tf = np.frombuffer(self.row["counts"][self.at[term]], np.uint32).astype(np.int64)
            impact = w * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[places]))
            most = int(impact.max())
            if not most:
                found = None
            else:
                words, starts = np.unique(places >> 6, return_index=True)
                bits = impact >> np.arange(most.bit_length())[:, None] & 1
                found = words, np.bitwise_or.reduceat(bits.astype(np.uint64) << (places & 63).astype(np.uint64), starts, axis=1), most
            if found is None or found[1].nbytes <= self.free:
                self.free -= 0 if found is None else found[1].nbytes
                self.kept[term] = found
            return found
        return self.kept[term]

    def sums(self, items: list[list[tuple[str, int, int]]]) -> np.ndarray:
        """Slices (bit, item, word) of the sum over each item's (term, repeats, weight)."""
        steps, most = [], 1
        for terms in items:
            own, bound = [], 0
            for term, repeats, w in terms:
                found = self.slices(term, w)
                if found:
                    bound += repeats * found[2]
                    own += [(term, w, shift) for shift in range(repeats.bit_length()) if repeats >> shift & 1]
            steps.append(own)
            most = max(most, bound)
        out = np.zeros((most.bit_length(), len(items), self.words), np.uint64)
        added = np.zeros_like(out)
        for step in range(max(map(len, steps), default=0)):
            added[:] = 0
            top = 0
            for k, own in enumerate(steps):
                if step < len(own):
                    term, w, shift = own[step]
                    words, planes, _ = self.slices(term, w)
                    added[shift : shift + len(planes), k, words] = planes
                    top = max(top, shift + len(planes))
            carry = np.zeros_like(out[0])
            for b in range(len(out)):
                if b >= top and not carry.any():
                    break
                half = out[b] ^ added[b]
                both = out[b] & added[b]
                np.bitwise_xor(half, carry, out=out[b])
                carry = both | carry & half
        return out

    def best(self, sums: np.ndarray, k: int) -> list[list[tuple[int | None, int]]]:
        """For each item its k highest (doc_id, sum) above 0; of equal sums those with the smallest ids."""
        open_ = np.bitwise_or.reduce(sums, axis=0)
        sure = np.zeros_like(open_)
        for plane in sums[::-1]:
            more = sure | open_ & plane
            over = (np.bitwise_count(more).sum(axis=1) > k)[:, None]
            open_ = np.where(over, open_ & plane, open_ & ~plane)
            sure = np.where(over, sure, more)
        out = []
        for item in range(sums.shape[1]):
            places = _places(sure[item])
            places = np.concatenate([places, _places(open_[item])[: k - len(places)]])
            words, bits = places >> 6, (places & 63).astype(np.uint64)
            scores = sum(((sums[b, item, words] >> bits & np.uint64(1)).astype(np.int64) << b for b in range(len(sums))), np.zeros(len(places), np.int64))
            out.append([(int(self.ids[p]) if p < self.known else None, int(s)) for p, s in zip(places, scores, strict=True)])
        return out


def _places(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def search(index: DataFrame, entries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item of ``item_terms``.

    Scores are those of the contract of ``op11_ranked_search``. Equal scores go by doc_id, a document without an id last;
    rows that repeat an id have a rank each. Items without terms, or whose terms no document has, get no rows; without
    documents there are no rows. An index that was built ``among`` terms must have those of the items.

    While the items have at most ``BROADCAST_ROWS`` terms, all go to every task. More are dealt into rows of about
    ``CHUNK_TERMS`` terms, each of which meets each block once, by a shuffle that deals the blocks of a row over all tasks.
    A block gives ``k`` documents an item, of which Spark keeps ``k`` in each task before it shuffles them.
    """
    spark = index.sparkSession
    id_type = entries.schema["item_id"].dataType.simpleString()
    n_docs, n_terms = index.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("all_terms"), F.lit(0))).first()
    if not n_docs or entries.isEmpty():
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id bigint, score bigint")
    holders = index.select(F.explode(F.arrays_zip("terms", "holders")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.holders").alias("holders"))
    weighed = materialize(entries.join(holders, "term").withColumn("w", weight(F.col("holders"), n_docs)).where("w > 0"), "item_terms")
    total = weighed.count()
    by_item = weighed.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "repeats", "w"))).alias("entries"))
    columns = ["doc_ids", "nulls", "lengths", "terms", "places", "counts"]
    asked = None
    if total <= BROADCAST_ROWS:
        asked = [(r["item_id"], [tuple(e) for e in r["entries"]]) for r in by_item.toLocalIterator()]
        met = index.select(*columns)
    else:
        chunks, salts = -(-total // CHUNK_TERMS), partitions(spark)
        dealt = by_item.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("item_id", "entries")).alias("items"))
        spread = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        blocks = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))
        met = blocks.withColumn("salt", F.pmod(F.xxhash64("doc_ids", "lengths"), F.lit(salts)).cast("int")).join(spread, ["chunk", "salt"]).select(*columns, "items")
    id_kind = to_arrow_type(entries.schema["item_id"].dataType)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                items = asked if asked is not None else [(x["item_id"], [(e["term"], e["repeats"], e["w"]) for e in x["entries"]]) for x in row["items"]]
                block, out = _Block(row, n_docs, n_terms), ([], [], [])
                for begin in range(0, len(items), BATCH_ITEMS):
                    part = items[begin : begin + BATCH_ITEMS]
                    for (item_id, _), best in zip(part, block.best(block.sums([terms for _, terms in part]), k), strict=True):
                        for doc_id, score in best:
                            for column, value in zip(out, (item_id, doc_id, score), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], id_kind), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["item_id", "doc_id", "score"])

    scored = met.mapInArrow(found, f"item_id {id_type}, doc_id bigint, score bigint")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``search`` of all ``items`` in all ``docs``; see there and at ``build_index`` for nulls, ties and empty tables.

    While the items' terms have at most ``TERM_BYTES`` bytes, only their postings are written.
    """
    entries = materialize(item_terms(items, item_col, item_text_col), "item_terms")
    terms = entries.select("term").distinct()
    small = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0] <= TERM_BYTES
    among = [r["term"] for r in terms.toLocalIterator()] if small else None  # at most TERM_BYTES
    return search(build_index(docs, id_col, text_col, among), entries, k)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of each ``benchmark`` item, of all documents; nulls, ties and empty tables as in ``search``."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = rf"""
with read as (select doc_id, row_number() over () as place, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') as terms from documents),
sized as (select doc_id, place, terms, cast(len(terms) as bigint) as n from read where len(terms) > 0),
totals as (select cast(count(*) as bigint) as all_docs, cast(sum(n) as bigint) as all_terms from sized),
asked as (select item_id, term, count(*) as repeats from
    (select item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from benchmark) group by all),
counted as (select place, term, count(*) as tf from (select place, unnest(terms) as term from sized) where term in (select term from asked) group by all),
weights as (select term, cast(floor(1000 * ln(cast(2 * all_docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from counted, totals group by term, all_docs),
scored as (
    select a.item_id, c.place, cast(sum(a.repeats * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 75 + (75 * s.n * t.all_docs) // t.all_terms)))) as bigint) as score
    from asked a join counted c using (term) join weights w using (term) join sized s using (place), totals t group by all),
ranked as (
    select x.item_id, cast(row_number() over (partition by x.item_id order by x.score desc, s.doc_id nulls last) as integer) as rank, s.doc_id, x.score
    from scored x join sized s using (place) where x.score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
