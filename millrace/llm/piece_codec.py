"""SentencePiece encoding and decoding: pieces are found in a suffix array of the batch's text."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import replace_column, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: What an id without a piece stands for.
NO_PIECE = "\ufffd".encode()
#: Characters of text that are indexed together.
SLICE_CHARS = 4_000_000
#: Texts that show rules which change a text or choose pieces other than by merging (fixed values).
TELLING = ("a  b", " a", "a ", "\uff48\u00e9\u00a0\ufb01", "E\u0301", "the cat and the hat sat there", "\t\n1,234.5<s></s><unk>")
#: Units from this many characters on are relaxed one by one, others together; the ids are the same.
LONG_UNIT = 64


def unit_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Cuts text where no piece goes on, so that units can be encoded one by one.

    No piece goes on into the white space after other characters. If none joins letters and other characters either,
    units end there too, and far fewer of them differ. Which it is, the pieces say.
    """
    pieces = list(pieces)
    coarse = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    word = re.compile(r"[^\W\d_]")
    numerals = re.escape("".join(sorted({c for p in pieces for c in p if word.match(c) and not c.isalpha()})))
    letter = f"[^\\W\\d_{numerals}]"
    fine = re.compile(f"{SPACE}*(?:{letter}+|(?:(?!{letter})[^{SPACE}])+)|{SPACE}+")
    return fine if all(len(fine.findall(p)) == 1 for p in pieces) else coarse


class PieceVocabulary:
    """The pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str = MODEL):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        self.ids = {model.id_to_piece(k): k for k in plain}
        scores = [model.get_score(k) for k in range(size)]
        place = {x: k for k, x in enumerate(sorted(set(scores), reverse=True))}
        #: Equal scores have equal ranks, the best has 0.
        self.ranks = [place[x] for x in scores]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        self.falls_back = all(model.is_byte(k) for k in self.byte_ids)
        self.longest = max(map(len, self.ids))
        self.cut = unit_pattern(self.ids).findall
        #: Bytes that an id stands for; control ids stand for none.
        self.bytes = [b""] * size
        for piece, k in self.ids.items():
            self.bytes[k] = piece.replace(SPACE, " ").encode()
        for b, k in enumerate(self.byte_ids):
            if model.is_byte(k):
                self.bytes[k] = bytes([b])
        #: Pieces of two characters or more, whose occurrences the suffix array is asked for: lengths, ids, and spelling by letter.
        long = [(p, k) for p, k in self.ids.items() if len(p) > 1]
        self.letters = {c: n for n, c in enumerate(sorted({c for p, _ in long for c in p}), 1)}
        self.lengths = np.array([len(p) for p, _ in long], dtype=np.int64)
        self.long_ids = np.array([k for _, k in long], dtype=np.int64)
        self.spelled = np.zeros((len(long), self.longest), dtype=np.int64)
        for row, (p, _) in enumerate(long):
            self.spelled[row, : len(p)] = [self.letters[c] for c in p]
        self.rank_of = np.array(self.ranks, dtype=np.int64)

    def of_char(self, c: str) -> list[int]:
        k = self.ids.get(c)
        if k is not None:
            return [k]
        return [self.byte_ids[b] for b in c.encode()] if self.falls_back else [self.unknown]


def suffix_keys(codes: np.ndarray, bits: int, longest: int) -> list[np.ndarray]:
    """The first ``longest`` codes of every suffix, packed into 64-bit keys; codes past the end count as 0."""
    per = 63 // bits
    padded = np.r_[codes, np.zeros(longest + per, dtype=np.uint64)]
    keys = []
    for level in range(-(-longest // per)):
        key = np.zeros(len(codes), dtype=np.uint64)
        for j in range(per):
            key = (key << np.uint64(bits)) | (padded[level * per + j : level * per + j + len(codes)] if level * per + j < longest else np.uint64(0))
        keys.append(key)
    return keys


def sorted_places(keys: list[np.ndarray]) -> np.ndarray:
    """Places in the order of ``keys``, most significant first; only those alike in the first are compared by the others."""
    order = np.argsort(keys[0])
    if len(keys) == 1 or len(order) < 2:
        return order
    first = keys[0][order]
    equal = first[1:] == first[:-1]
    tied = np.flatnonzero(np.r_[equal, False] | np.r_[False, equal])
    own = order[tied]
    order[tied] = own[np.lexsort([*(k[own] for k in keys[:0:-1]), first[tied]])]
    return order


def bounds(keys: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """First place in the sorted ``keys`` (most significant first) that isn't before each of ``wanted``: binary search."""
    n, m = len(keys[0]), len(wanted[0])
    low, high = np.zeros(m, dtype=np.int64), np.full(m, n, dtype=np.int64)
    while (low < high).any():
        mid = (low + high) >> 1
        at = np.minimum(mid, n - 1)
        before, same = np.zeros(m, dtype=bool), np.ones(m, dtype=bool)
        for key, want in zip(keys, wanted, strict=True):
            held = key[at]
            before |= same & (held < want)
            same &= held == want
        active = low < high
        low = np.where(active & before, mid + 1, low)
        high = np.where(active & ~before, mid, high)
    return low


def occurrences(text: str, vocabulary: PieceVocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and id of every occurrence of a piece of two characters or more, sorted by start and length."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    alphabet, codes = np.unique(points, return_inverse=True)
    codes = codes.astype(np.uint64) + np.uint64(1)
    code = {chr(c): k + 1 for k, c in enumerate(alphabet.tolist())}
    bits = max(1, len(alphabet).bit_length())
    longest = vocabulary.longest
    keys = suffix_keys(codes, bits, longest)
    order = sorted_places(keys)
    keys = [k[order] for k in keys]
    empty = np.empty(0, dtype=np.int64)
    letters = np.zeros(len(vocabulary.letters) + 1, dtype=np.uint64)
    for c, n in code.items():
        if c in vocabulary.letters:
            letters[vocabulary.letters[c]] = n
    spelled = letters[vocabulary.spelled]
    there = np.flatnonzero((spelled > 0).sum(axis=1) == vocabulary.lengths)
    if not len(there):
        return empty, empty, empty
    lengths, spelled = vocabulary.lengths[there], spelled[there]
    per = 63 // bits
    top = np.uint64((1 << bits) - 1)
    low, high = [], []
    for level in range(len(keys)):
        a = np.zeros(len(there), dtype=np.uint64)
        b = np.zeros(len(there), dtype=np.uint64)
        for j in range(per):
            at = level * per + j
            column = spelled[:, at] if at < longest else np.zeros(len(there), dtype=np.uint64)
            a = (a << np.uint64(bits)) | column
            b = (b << np.uint64(bits)) | np.where(at < lengths, column, top)  # above every suffix with this beginning
        low.append(a)
        high.append(b)
    first, past = bounds(keys, low), bounds(keys, high)
    found = past - first
    pieces = np.repeat(np.arange(len(there)), found)
    offset = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
    starts = order[np.repeat(first, found) + offset]
    order = np.argsort(starts * (longest + 1) + lengths[pieces])  # no two are equal
    pieces = pieces[order]
    return starts[order], lengths[pieces], vocabulary.long_ids[there[pieces]]


class Edges:
    """Occurrences of pieces, looked up by start and length."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, vocabulary: PieceVocabulary):
        self.width = vocabulary.longest + 1
        self.keys, self.ids = starts * self.width + lengths, ids
        self.ranks = vocabulary.rank_of[ids] if len(ids) else ids
        self.none = len(vocabulary.ranks)

    def _place(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = start * self.width + (end - start)
        at = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
        return at, (end - start < self.width) & (self.keys[at] == wanted) if len(self.keys) else np.zeros(len(start), dtype=bool)

    def rank(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        at, there = self._place(start, end)
        return np.where(there, self.ranks[at], self.none) if len(self.keys) else np.full(len(start), self.none)

    def id(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.ids[self._place(start, end)[0]]


def relax(begins: np.ndarray, sizes: np.ndarray, edges: Edges) -> np.ndarray:
    """Starts, sorted, of the pieces of all units: neighbours join into the best-scored piece, the leftmost of equals, until none is left.

    Unit k has the characters from ``begins[k]`` on. All units take one step at a time together; those that are done go.
    """
    units = np.repeat(np.arange(len(sizes)), sizes)
    offsets = np.cumsum(sizes) - sizes
    starts = np.arange(len(units)) - offsets[units] + begins[units]
    ends = begins + sizes

    def ranks(at: np.ndarray) -> np.ndarray:
        """Rank of the piece that each piece at ``at`` would make with its right neighbour."""
        n = len(starts)
        one, two = np.minimum(at + 1, n - 1), np.minimum(at + 2, n - 1)
        paired = (at + 1 < n) & (units[one] == units[at])
        end = np.where((at + 2 < n) & (units[two] == units[at]), starts[two], ends[units[at]])
        return np.where(paired, edges.rank(starts[at], end), edges.none)

    joined = ranks(np.arange(len(starts)))
    done = []
    while len(starts):
        first = np.flatnonzero(np.r_[True, units[1:] != units[:-1]])
        counts = np.diff(np.r_[first, len(starts)])
        best = np.minimum.reduceat(joined, first)
        live = best < edges.none
        if not live.all():
            kept = np.repeat(live, counts)
            done.append(starts[~kept])
            starts, units, joined = starts[kept], units[kept], joined[kept]
            best, counts = best[live], counts[live]
            if not len(starts):
                break
        hits = np.flatnonzero(joined == np.repeat(best, counts))
        left = hits[np.r_[True, units[hits[1:]] != units[hits[:-1]]]]
        kept = np.ones(len(starts), dtype=bool)
        kept[left + 1] = False
        starts, units, joined = starts[kept], units[kept], joined[kept]
        left = left - np.arange(len(left))
        before = left[(left > 0) & (units[left - 1] == units[left])] - 1
        changed = np.r_[left, before]
        joined[changed] = ranks(changed)
    return np.sort(np.concatenate(done)) if done else np.empty(0, dtype=np.int64)


def relax_long(begin: int, n: int, edges: Edges) -> np.ndarray:
    """The same for one unit, with a heap, so that time stays near linear in its length."""
    low, high = np.searchsorted(edges.keys, [begin * edges.width, (begin + n) * edges.width])
    known = dict(zip(edges.keys[low:high].tolist(), edges.ranks[low:high].tolist(), strict=True))
    following, preceding = list(range(1, n + 2)), list(range(-1, n))
    alive = [True] * (n + 1)
    heap: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        middle = following[start]
        if middle < n and following[middle] - start < edges.width:
            rank = known.get((begin + start) * edges.width + following[middle] - start)
            if rank is not None:
                heapq.heappush(heap, (rank, start, following[middle]))

    for k in range(n - 1):
        offer(k)
    while heap:
        _, start, end = heapq.heappop(heap)
        if not (alive[start] and alive[end]) or following[start] >= end or following[following[start]] != end:
            continue
        alive[following[start]] = False
        following[start], preceding[end] = end, start
        if preceding[start] >= 0:
            offer(preceding[start])
        offer(start)
    return begin + np.flatnonzero(alive[:n])


class PieceCodec:
    """Texts to ids and back; ids come as little-endian unsigned 32-bit bytes.

    Each batch is indexed for itself: its units, between which no piece can lie, are laid end to end, each distinct
    one once, and the suffix array of that text is asked for every piece.

    Only models are taken whose ids follow from merging by score: BPE without rules that change the text and without
    pieces of the user's. Others raise a ValueError, as they would get other ids than their own library gives.
    """

    def __init__(self, path: str = MODEL):
        self.vocabulary = PieceVocabulary(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [*TELLING, "".join(list(self.vocabulary.ids)[:: max(1, len(self.vocabulary.ids) // 500)]).replace(SPACE, " ")]
        for text, ids in zip(texts, self.encode_batch(texts), strict=True):
            if np.frombuffer(ids, dtype="<u4").tolist() != model.encode(text) or self.decode(model.encode(text)) != text.replace(SPACE, " "):
                raise ValueError(f"{path}: not a plain BPE model ({text[:40]!r} is encoded by other rules)")

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit."""
        vocabulary = self.vocabulary
        text = "\x00".join(units)
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        begins = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        edges = Edges(*occurrences(text, vocabulary), vocabulary)
        short = sizes < LONG_UNIT
        found = [relax(begins[short], sizes[short], edges), *(relax_long(int(b), int(n), edges) for b, n in zip(begins[~short], sizes[~short], strict=True))]
        starts = np.sort(np.concatenate(found))
        owner = np.searchsorted(begins, starts, side="right") - 1
        last = np.r_[owner[1:] != owner[:-1], True]
        ends = np.where(last, (begins + sizes)[owner], np.r_[starts[1:], 0])
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)[starts]
        single = ends - starts == 1
        chars, which = np.unique(points[single], return_inverse=True)
        spelled = [vocabulary.of_char(chr(c)) for c in chars.tolist()]
        many = np.array([len(x) for x in spelled], dtype=np.int64)
        base = np.cumsum(many) - many
        width = np.ones(len(starts), dtype=np.int64)
        width[single] = many[which]
        at = np.cumsum(width) - width
        ids = np.empty(int(width.sum()), dtype="<u4")
        ids[at[~single]] = edges.id(starts[~single], ends[~single]) if (~single).any() else []
        n = width[single]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flat = np.array([x for own in spelled for x in own], dtype=np.int64)
        ids[np.repeat(at[single], n) + inner] = flat[np.repeat(base[which], n) + inner]
        raw = ids.tobytes()
        cuts = np.r_[at, len(ids)][np.searchsorted(owner, np.arange(len(units) + 1))]
        cuts = (4 * cuts).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; an empty text has none."""
        cut = self.vocabulary.cut
        split = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        units = list({u: None for parts in split for u in parts})
        known = dict(zip(units, self._encode_units(units), strict=True)) if units else {}
        return [b"".join(map(known.__getitem__, parts)) for parts in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids`` of pieces, without the space that encoding puts in front; broken bytes become U+FFFD."""
        return self._text(map(self.vocabulary.bytes.__getitem__, ids))

    def decode_any(self, ids: Iterable[int | None]) -> str:
        """As ``decode``, with U+FFFD for null and for numbers that are no piece's."""
        pieces = self.vocabulary.bytes
        return self._text(pieces[k] if k is not None and 0 <= k < len(pieces) else NO_PIECE for k in ids)

    @staticmethod
    def _text(parts: Iterable[bytes]) -> str:
        raw = b"".join(parts)
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", errors="replace")


def _slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_pieces(df: DataFrame, text_col: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """``df`` with ``out``, the ids (array<int>) of each whole text.

    Null and empty texts have no ids; equal texts equal ids; a column named ``out`` is replaced; rows aren't shuffled; an
    empty table stays empty. ``model`` is a file with a BPE model; see ``PieceCodec`` for those that are refused.
    """

    @arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = PieceCodec(model)
        for texts in batches:
            found = [x for part in _slices([t or "" for t in texts.to_pylist()]) for x in codec.encode_batch(part)]
            yield pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in found], pa.list_(pa.int32()))

    return replace_column(df, out, encoded.asNondeterministic()(F.col(f"`{text_col}`")))


def decode_pieces(df: DataFrame, ids_col: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with ``out``, the text of each row's ids; a null row gives a null text, one without ids an empty one.

    An id that is null, negative or past the vocabulary becomes U+FFFD, as bytes do that make no character. A column named
    ``out`` is replaced; rows aren't shuffled; an empty table stays empty.
    """

    @arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = PieceCodec(model)
        for rows in batches:
            yield pa.array([None if r is None else codec.decode_any(r) for r in rows.to_pylist()], pa.string())

    return replace_column(df, out, decoded.asNondeterministic()(F.col(f"`{ids_col}`")))


def codec_digest(text: Column, model: str = MODEL) -> Column:
    """Struct (n_ids, ids_crc32, round_trip) of a text's ids, which are decoded again and compared."""

    @arrow_udf("n_ids bigint, ids_crc32 bigint, round_trip boolean")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = PieceCodec(model)
        for texts in batches:
            rows = []
            for part in _slices([t or "" for t in texts.to_pylist()]):
                for text_, ids in zip(part, codec.encode_batch(part), strict=True):
                    back = codec.decode(memoryview(ids).cast("I"))
                    rows.append((len(ids) // 4, zlib.crc32(ids), back == text_.replace(SPACE, " ")))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.StructArray.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], names=["n_ids", "ids_crc32", "round_trip"]
            )

    return digest.asNondeterministic()(text)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of each document's ids, and whether they decode to its text; null and empty texts have none and come back empty."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", codec_digest(F.col("text")).alias("codec")).select("doc_id", "codec.*")
