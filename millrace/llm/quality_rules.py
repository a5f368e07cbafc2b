"""Quality rules: zstandard compression bands over whole documents and fixed chunks."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import free_name, replace_column, table

#: (bytes up to, lowest ratio, highest ratio). Short texts hardly compress, long ones well, so both limits fall
#: with length. Written prose of 1 kB has about 0.5, of 100 kB about 0.36; one line said again and again falls
#: under 0.2, and base64 or ciphered bytes stay above 0.75.
BANDS: tuple[tuple[int, float, float], ...] = (
    (128, 0.40, 1.50),
    (256, 0.38, 1.05),
    (512, 0.36, 0.90),
    (1024, 0.33, 0.82),
    (4096, 0.30, 0.74),
    (16384, 0.27, 0.70),
    (65536, 0.24, 0.68),
    (1 << 62, 0.18, 0.66),
)
CHUNK_BYTES = 2048
CHUNK_BAND = (0.24, 0.74)
#: A document whose bytes lie in failing chunks by more than this share is rejected.
CHUNK_SHARE = 0.5
LEVEL = 3

#: Fitted limits: bands of half an octave; a ratio is low from this many robust deviations under its band's median on.
FIT_EDGES = tuple(round(2 ** (k / 2)) for k in range(14, 35))
FIT_DISTANCE = 3.5
#: A band of n different texts (or chunks) has a limit that lies n / (n + FIT_WEIGHT) of the way from the fixed to its own.
FIT_WEIGHT = 100
#: Deviations count as this share of the median at least, so that a band full of near copies doesn't reject the rest.
FIT_FLOOR = 0.015
#: Cells of a ratio's histogram in one unit of ratio.
FIT_CELLS = 2000

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))

RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, ratio double, low_chunks double, high_chunks double, reason string, kept boolean"
)
_FIELDS = pa.struct(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_())]
    + [(n, pa.float64()) for n in ("ratio", "low_chunks", "high_chunks")]
    + [("reason", pa.string()), ("kept", pa.bool_())]
)


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that lie in a window of three which the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n - 2:
        return 0
    seen = Counter(windows)
    twice = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=n - 2)
    inside = np.zeros(n, dtype=bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= twice
    return int(inside.sum())


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows) of UTF-8 bytes.

    All separators are ASCII, so the counts can be taken from bytes; code points are the bytes
    that don't continue a character.
    """
    words = raw.split()
    inked = raw.translate(None, _SPACE + _CONTINUATION)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(inked),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def passes_base(counts: Sequence[int]) -> bool:
    return not (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


def chunks_of(raw: bytes, chunk_bytes: int) -> list[bytes]:
    """Chunks of a text that is longer than one; a last one of less than half the size reaches back to a whole one."""
    if len(raw) <= chunk_bytes:
        return []
    cut = [raw[at : at + chunk_bytes] for at in range(0, len(raw), chunk_bytes)]
    return [*cut[:-1], cut[-1] if 2 * len(cut[-1]) >= chunk_bytes else raw[-chunk_bytes:]]


def measure(raw: bytes, press, bands=BANDS, chunk_bytes=CHUNK_BYTES, chunk_band=CHUNK_BAND, share=CHUNK_SHARE) -> tuple:
    """One row of RESULT for one text."""
    counts = base_counts(raw)
    base_failed = not passes_base(counts)
    if not raw:
        return (*counts, base_failed, None, 0.0, 0.0, "empty", False)
    ratio = len(press(raw)) / len(raw)
    lowest, highest = next((lo, hi) for most, lo, hi in bands if len(raw) <= most)
    low = high = checked = 0
    for chunk in chunks_of(raw, chunk_bytes):
        checked += len(chunk)
        r = len(press(chunk)) / len(chunk)
        low += len(chunk) * (r < chunk_band[0])
        high += len(chunk) * (r > chunk_band[1])
    low_share, high_share = (low / checked, high / checked) if checked else (0.0, 0.0)
    reason = (
        "base"
        if base_failed
        else "repetitive"
        if ratio < lowest
        else "incompressible"
        if ratio > highest
        else "repetitive chunks"
        if low_share > share
        else "incompressible chunks"
        if high_share > share
        else None
    )
    return (*counts, base_failed, ratio, low_share, high_share, reason, reason is None)


def compression_rules(text: Column, bands=BANDS, chunk_bytes=CHUNK_BYTES, chunk_band=CHUNK_BAND, share=CHUNK_SHARE) -> Column:
    """Struct column RESULT for a string column. Null counts as the empty text, which is rejected."""

    @arrow_udf(RESULT)
    def rules(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        for texts in batches:
            raw = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
            rows = [measure(x.as_py() or b"", press, bands, chunk_bytes, chunk_band, share) for x in raw]
            columns = zip(*rows, strict=True) if rows else [()] * len(_FIELDS)
            yield pa.StructArray.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, _FIELDS, strict=True)], fields=list(_FIELDS)
            )

    return rules.asNondeterministic()(text)


def ratio_cells(raw: bytes, press, chunk_bytes: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """(band, cell) of a text's ratio and, as band -1, of its chunks' ratios; none if the base rule rejects it."""
    if not passes_base(base_counts(raw)):
        return []
    cells = [(bisect_left(FIT_EDGES, len(raw)), raw)] + [(-1, c) for c in chunks_of(raw, chunk_bytes)]
    return [(band, round(FIT_CELLS * len(press(x)) / len(x))) for band, x in cells]


def lowest_usual(cells: dict[int, int], fixed: float) -> float:
    """A lower limit between ``fixed`` and the ratio FIT_DISTANCE robust deviations under the median of a histogram.

    The more entries it has, the nearer to the latter; it is never under ``fixed``.
    """
    if not cells:
        return fixed
    at = np.array(sorted(cells))
    n = np.array([cells[x] for x in at])
    middle = at[np.searchsorted(np.cumsum(n), n.sum() / 2)]
    away = np.abs(at - middle)
    order = np.argsort(away, kind="stable")
    deviation = 1.4826 * away[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]
    own = float(middle - FIT_DISTANCE * max(deviation, FIT_FLOOR * middle)) / FIT_CELLS
    return max(fixed, fixed + (own - fixed) * int(n.sum()) / (int(n.sum()) + FIT_WEIGHT))


def fit_limits(df: DataFrame, text_col: str = "text") -> dict:
    """``bands`` and ``chunk_band`` for the functions here, from the ratios of all texts of ``df``.

    Lower limits rise towards a robust distance under the median of the length band's own distribution, the further
    the more texts it has (FIT_WEIGHT), and none falls under the fixed one. Upper limits stay fixed. Equal texts
    count once. One grouped count, whose rows the grid bounds, goes to the driver.
    """

    @arrow_udf("array<struct<band int, cell int>>")
    def cells_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        kind = pa.list_(pa.struct([("band", pa.int32()), ("cell", pa.int32())]))
        for texts in batches:
            raw = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
            yield pa.array([[{"band": b, "cell": c} for b, c in ratio_cells(x.as_py() or b"", press)] for x in raw], type=kind)

    text = F.col(f"`{text_col}`")
    once = df.select(F.xxhash64(text).alias("digest"), cells_of.asNondeterministic()(text).alias("cells")).groupBy("digest").agg(F.any_value("cells").alias("cells"))
    found: dict[int, dict[int, int]] = {}
    for r in once.select(F.inline("cells")).groupBy("band", "cell").count().collect():
        found.setdefault(r["band"], {})[r["cell"]] = r["count"]
    bands = []
    for k, most in enumerate((*FIT_EDGES, BANDS[-1][0])):
        lowest, highest = next((lo, hi) for size, lo, hi in BANDS if most <= size)
        bands.append((most, lowest_usual(found.get(k, {}), lowest), highest))
    return {"bands": tuple(bands), "chunk_band": (lowest_usual(found.get(-1, {}), CHUNK_BAND[0]), CHUNK_BAND[1])}


def quality_rules(df: DataFrame, text_col: str = "text", out: str = "quality_rules", **limits) -> DataFrame:
    """``df`` with one struct column ``out`` that holds the counts, ratios, reason and verdict.

    Every row is kept and judged by its whole text; a null text counts as empty and is rejected;
    equal texts get equal verdicts; an empty table gives an empty table; a column that already has
    the name ``out`` is replaced and all others pass through. The plan is one map without a shuffle.
    """
    return replace_column(df, out, compression_rules(F.col(f"`{text_col}`"), **limits))


def keep_documents(df: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``df`` that the rules keep, with its own columns only.

    Null and empty texts go; equal texts share a verdict; an empty table stays empty; columns of whatever names pass
    through; no row is shuffled.
    """
    names, held = df.columns, free_name(df, "__quality_rules__")
    judged = df.select("*", compression_rules(F.col(f"`{text_col}`"), **limits).alias(held))
    return judged.where(F.col(held)["kept"]).select(*[F.col(f"`{c}`") for c in names])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents, the limits being fitted to them (``fit_limits``, which see for small tables); nulls,
    empty and equal texts as stated at ``quality_rules``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, **fit_limits(docs)).select("doc_id", "quality_rules.*")
