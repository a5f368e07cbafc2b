"""Packing documents into fixed windows by non-negative least squares over a length histogram."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import materialize, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WINDOW = 2048
END_ID = 1
#: Lengths are rounded up to this many tokens when combinations are enumerated.
GRID = 8
#: Lengths up to this many tokens are planned as they are.
EXACT = 256
#: Most pieces of an enumerated combination.
DEPTH = 3
#: Residuals of lengths up to this share of the window weigh less, as the greedy pass can still place them.
SHORT, SHORT_WEIGHT = 0.125, 0.1
#: Pieces of one length are numbered in parts of about this size.
PART_PIECES = 100_000

#: The split pattern of the tokenizer file (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CACHE_ENTRIES = 300_000
_CACHED_CHARS = 48
_LONG = 1500


def _byte_alphabet() -> dict[str, int]:
    """Character to byte in byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PackedTokenizer:
    """Text to token ids as little-endian unsigned 32-bit bytes, the ids being those of ``tokenizers`` for ``path``.

    No token crosses a space that follows or precedes other characters, so a text is cut at its spaces and each
    distinct part is encoded once and kept. Texts where white space of several kinds meets around a space are
    encoded whole. The strings of added tokens become their ids, as ``tokenizers`` has it without further settings.
    """

    def __init__(self, path: str = TOKENIZER):
        self.exact = Tokenizer.from_file(path)
        alphabet = _byte_alphabet()
        ranks = {
            bytes(alphabet[c] for c in piece): k
            for piece, k in self.exact.get_vocab(with_added_tokens=False).items()
            if all(c in alphabet for c in piece)
        }
        added = self.exact.get_added_tokens_decoder()
        ranks = {piece: k for piece, k in ranks.items() if k not in added}
        self.added = {t.content: array("I", [k]).tobytes() for k, t in added.items()}
        plain = not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if plain else None
        self.quick = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.mixed = re.compile(r"\s \s").search
        self.parts = _Parts(self._encode)

    def _encode(self, text: str) -> bytes:
        if len(text) > _LONG and max(map(len, text.split())) > _LONG:  # the quick merge is quadratic in a word's length
            return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.quick.encode_ordinary(text)).tobytes()

    def _encode_added(self, text: str) -> bytes:
        if self.split is None:  # tokens that take in white space or need word bounds
            return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(self.added[x] if k % 2 else self.encode(x) for k, x in enumerate(self.split(text)) if x)

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return self._encode_added(text)
        if self.mixed(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        return self._encode(first) + b"".join(map(self.parts.__getitem__, rest))


class _Parts(dict):
    """Encoded parts by their text without the space in front; emptied when it is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        packed = self.encode(" " + part)
        if len(part) <= _CACHED_CHARS:
            if len(self) >= _CACHE_ENTRIES:
                self.clear()
            self[part] = packed
        return packed


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def token_pieces(df: DataFrame, id_col="doc_id", text_col="text", tokenizer=TOKENIZER, window=WINDOW, end_id=END_ID, with_ids=False) -> DataFrame:
    """Each document's ids and ``end_id``, cut every ``window`` ids: PIECES, and ``ids`` if asked for."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = PackedTokenizer(tokenizer).encode
        tail = array("I", [end_id]).tobytes()
        for batch in batches:
            rows, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = encode(text.as_py() or "") + tail
                total = len(packed) // 4
                for start in range(0, total, window):
                    part = packed[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], type=pa.int64())] * 5
            if with_ids:
                columns.append(pa.array(ids, type=pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    source = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Every multiset of at most ``depth`` lengths from 1 to ``bins`` that sums to ``bins``."""
    found: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            fewest = -(-left // (depth - len(chosen)))
            for k in range(min(left, most), fewest - 1, -1):
                grow((*chosen, k), left - k, k)

    grow((), bins, bins)
    return found


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-8) -> np.ndarray:
    """x >= 0 that minimises the norm of a x - b, by the active-set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= tol * max(1.0, float(np.abs(b).max(initial=0))):
            break
        passive[k] = True
        while True:
            own = np.flatnonzero(passive)
            part = a[:, own]
            best = np.linalg.solve(part.T @ part + 1e-9 * np.eye(own.size), part.T @ b) if own.size else np.empty(0)
            if best.size == 0 or best.min() > 0:
                x[:] = 0
                x[own] = best
                break
            falling = best <= 0
            step = np.min(x[own][falling] / (x[own][falling] - best[falling] + 1e-300))
            x[own] += step * (best - x[own])
            gone = own[x[own] <= 1e-12]
            passive[gone if gone.size else own[falling][:1]] = False
            x[~passive] = 0
    return x


def packing_plan(histogram: dict[int, int], bins: int, depth: int = DEPTH, grid: int = 1) -> list[tuple[dict[int, int], int]]:
    """Patterns (length in bins to how many of it) with the times each is used; together they use up ``histogram``.

    The combinations' repeat counts solve the least squares problem and are rounded; what is left over is packed
    greedily, longest first, a pattern being repeated as often as its lengths last. Combinations are of multiples of
    ``grid``; other lengths are packed greedily. Depends on ``bins`` only, not on the number of documents.
    """
    left = {k: int(v) for k, v in histogram.items() if v > 0}
    plan: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], times: int) -> None:
        plan.append((pattern, times))
        for k, m in pattern.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]

    if left.get(bins):
        use({bins: 1}, left[bins])
    scaled = ((tuple(grid * k for k in w)) for w in combinations(bins // grid, depth)) if left else ()
    ways = [w for w in scaled if all(k in left for k in w)]
    if ways:
        lengths = sorted(left)
        row = {k: i for i, k in enumerate(lengths)}
        weight = np.where(np.array(lengths) <= SHORT * bins, SHORT_WEIGHT, 1.0)
        a = np.zeros((len(lengths), len(ways)))
        for j, way in enumerate(ways):
            for k in way:
                a[row[k], j] += 1
        counts = np.array([left[k] for k in lengths], dtype=float)
        scale = max(1.0, counts.max())
        x = nnls(a * weight[:, None], counts * weight / scale) * scale
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            pattern = dict(Counter(ways[j]))
            times = min(round(float(x[j])), *(left.get(k, 0) // m for k, m in pattern.items()))
            if times > 0:
                use(pattern, times)
    while left:
        pattern: dict[int, int] = {}
        room = bins
        for k in sorted(left, reverse=True):
            m = min(left[k], room // k)
            if m:
                pattern[k] = m
                room -= m * k
            if not room:
                break
        use(pattern, min(left[k] // m for k, m in pattern.items()))
    return plan


def pack(df: DataFrame, id_col="doc_id", text_col="text", tokenizer=TOKENIZER, window=WINDOW, end_id=END_ID, grid=GRID, depth=DEPTH, with_ids=False) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    Returns PIECES with sequence_id and offset (and ``ids`` if asked for). A document longer than the window is cut
    at its multiples; each rest is placed whole. Null and empty texts are documents of the end id alone; repeated
    rows are packed each for itself; an empty table gives no rows; other columns are ignored. Lengths up to EXACT
    count as they are, longer ones on the grid. Only the histogram of these lengths comes to the driver, and the plan, whose
    size follows from the window, goes to every task. Equally long pieces are numbered in parts whose number grows with the
    table, so a length that a third of all rows share is no hot key.
    """
    spark = df.sparkSession
    rounded = (F.ceil(F.col("length") / grid) * grid).cast("int")
    pieces = (
        token_pieces(df, id_col, text_col, tokenizer, window, end_id, with_ids)
        .withColumn("bin", F.when(F.col("length") <= EXACT, F.col("length").cast("int")).otherwise(rounded))
    )
    pieces = materialize(pieces, "pieces")
    parts = max(8, -(-pieces.count() // PART_PIECES))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = pieces.groupBy("bin", "salt").agg(F.count("*").alias("n"))
    counts = materialize(counts, "lengths")
    histogram = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    rows, used, sequences = [], Counter(), 0
    for pattern, times in packing_plan(histogram, window // grid * grid, depth, grid):
        for k, m in pattern.items():
            rows.append((k, used[k], used[k] + m * times, m, sequences))
            used[k] += m * times
        sequences += times
    plan = spark.createDataFrame(rows, "bin int, first_rank bigint, past_rank bigint, each bigint, first_sequence bigint")
    before = Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bin", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(inside).cast("bigint") - 1)
        .join(offsets, ["bin", "salt"])  # dealt alike, so pieces aren't shuffled again
        .withColumn("rank", F.col("rank") + F.col("earlier"))
    )
    placed = ranked.join(
        F.broadcast(plan.withColumnRenamed("bin", "plan_bin")),
        (F.col("bin") == F.col("plan_bin")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("past_rank")),
    ).withColumn("sequence_id", F.col("first_sequence") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("each")))
    in_sequence = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.col("sequence_id").cast("bigint").alias("sequence_id"),
        F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).cast("bigint").alias("offset"),
        *["ids"] * with_ids,
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack`` of all documents; null, empty, repeated and very long texts as stated there."""
    return pack(table(spark, sf_dir, "documents"))
