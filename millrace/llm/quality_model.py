"""Quality classifier: attention over passages, learned from document labels only."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import replace_column, table

#: Bytes of a passage; each ends at the white space that follows.
PASSAGE_BYTES = 400
#: Labelled documents used for training at most, those whose ids' hashes are smallest, and passages of each at most,
#: spread over its text. Scores read every passage.
TRAIN_DOCS = 5000
TRAIN_PASSAGES = 64
#: Buckets of hashed words, whose shares tell what a passage is about.
WORD_BUCKETS = 32
ENCODED, GATED = 24, 12
EPOCHS, RATE, DECAY = 150, 0.02, 1e-4

_GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\r", b".,;:", b"!?", b"|", b"#*$%&", b"<>{}[]=/\\", b"\"'()-_+@~^`", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)))
_CLASS = np.full(256, len(_GROUPS), dtype=np.int64)
for _k, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _k
FEATURES = len(_GROUPS) + 1 + 9 + WORD_BUCKETS


def passages(raw: bytes, size: int = PASSAGE_BYTES) -> list[bytes]:
    """The text in parts of about ``size`` bytes; one empty passage if there is no text."""
    parts, at = [], 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            cut = raw.find(b" ", end, end + size)
            end = cut + 1 if cut >= 0 else end + size
        parts.append(raw[at:end])
        at = end
    return parts or [b""]


def encode_passage(part: bytes) -> list[float]:
    """Shares of character classes, how varied, long and compressible the words are, and which words they are by hash."""
    n = max(1, len(part))
    shares = np.bincount(_CLASS[np.frombuffer(part, dtype=np.uint8)], minlength=len(_GROUPS) + 1) / n
    words = part.split()
    m = max(1, len(words))
    pairs = list(zip(words, words[1:], strict=False))
    return [
        *shares.tolist(),
        len(set(words)) / m,
        len(set(pairs)) / max(1, len(pairs)),
        sum(a == b for a, b in pairs) / max(1, len(pairs)),
        min(20, sum(map(len, words)) / m) / 20,
        sum(len(w) == 1 for w in words) / m,
        sum(w.isupper() for w in words) / m,
        min(2.0, len(zlib.compress(part, 1)) / n),
        min(1.0, len(part) / PASSAGE_BYTES),
        min(1.0, part.count(b"\n") / 20),
        *(np.bincount([zlib.crc32(w) % WORD_BUCKETS for w in words], minlength=WORD_BUCKETS) / m).tolist(),
    ]


def encode(text: str | None) -> np.ndarray:
    return np.array([encode_passage(p) for p in passages((text or "").encode())], dtype=np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Score = sigmoid of a linear form of the passages' encodings, averaged with gated attention weights."""

    def __init__(self, mean, scale, weights: dict[str, np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    @classmethod
    def start(cls, x: np.ndarray) -> AttentionModel:
        draw = np.random.default_rng(7)
        d = x.shape[1]

        def normal(*shape):
            return draw.normal(0, 1 / np.sqrt(shape[0]), shape)

        weights = {
            "encode": normal(d, ENCODED), "encode_bias": np.zeros(ENCODED), "value": normal(ENCODED, GATED), "gate": normal(ENCODED, GATED),
            "attend": normal(GATED, 1)[:, 0], "out": np.zeros(ENCODED), "out_bias": np.zeros(1),
        }
        return cls(x.mean(axis=0), x.std(axis=0) + 1e-3, weights)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Of passages ``x`` whose documents begin at ``starts``."""
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        sizes = np.diff(np.r_[starts, len(x)])
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        value, gate = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
        raw = (value * gate) @ w["attend"]
        raised = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        share = raised / np.repeat(np.add.reduceat(raised, starts), sizes)
        bag = np.add.reduceat(share[:, None] * h, starts)
        return {"x": x, "sizes": sizes, "h": h, "value": value, "gate": gate, "share": share, "bag": bag, "score": _sigmoid(bag @ w["out"] + w["out_bias"][0])}

    def slopes(self, f: dict[str, np.ndarray], starts: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the weighted log loss."""
        w = self.weights
        wrong = weight * (f["score"] - target)
        to_bag = wrong[:, None] * w["out"]
        to_bag_each = np.repeat(to_bag, f["sizes"], axis=0)
        along = (to_bag_each * f["h"]).sum(axis=1)
        to_raw = f["share"] * (along - np.repeat(np.add.reduceat(f["share"] * along, starts), f["sizes"]))
        to_value = to_raw[:, None] * w["attend"] * f["gate"] * (1 - f["value"] ** 2)
        to_gate = to_raw[:, None] * w["attend"] * f["value"] * f["gate"] * (1 - f["gate"])
        to_h = f["share"][:, None] * to_bag_each + to_value @ w["value"].T + to_gate @ w["gate"].T
        to_h *= 1 - f["h"] ** 2
        return {
            "encode": f["x"].T @ to_h, "encode_bias": to_h.sum(axis=0), "value": f["h"].T @ to_value, "gate": f["h"].T @ to_gate,
            "attend": (f["value"] * f["gate"]).T @ to_raw, "out": f["bag"].T @ wrong, "out_bias": np.array([wrong.sum()]),
        }

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: list[int]) -> AttentionModel:
        """Adam over all bags at once, both labels weighing alike; the same data give the same model."""
        x = np.concatenate(bags).astype(np.float64)
        starts = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]]
        target = np.array(labels, dtype=np.float64)
        positive = target.mean()
        weight = np.where(target == 1, 0.5 / max(positive, 1e-9), 0.5 / max(1 - positive, 1e-9)) / len(target) if 0 < positive < 1 else np.full(len(target), 1 / len(target))
        model = cls.start(x)
        first = {k: np.zeros_like(v) for k, v in model.weights.items()}
        second = {k: np.zeros_like(v) for k, v in model.weights.items()}
        for t in range(1, EPOCHS + 1):
            slopes = model.slopes(model.forward(x, starts), starts, target, weight)
            for k, g in slopes.items():
                g = g + DECAY * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] = model.weights[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        return model

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.empty(0)
        starts = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]]
        return self.forward(np.concatenate(bags).astype(np.float64), starts)["score"]


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def spread_passages(bag: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` passages, evenly spread."""
    return bag if len(bag) <= most else bag[np.linspace(0, len(bag) - 1, most).round().astype(int)]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, passages_each: int = TRAIN_PASSAGES) -> list[tuple[np.ndarray, int]]:
    """Encoded passages and labels of a sample of the labelled documents that aren't held out.

    The ``most`` ids with the smallest hashes go to the executors, which encode the texts; at most most *
    passages_each passages come back. Labels of a repeated id are averaged, of its texts the smallest is taken. Null ids
    and labels count for nothing.
    """
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [spread_passages(encode(t.as_py()), passages_each).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], names=["doc_id", "quality", "bag"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = joined.mapInArrow(encoded, "doc_id bigint, quality int, bag binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [(np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, FEATURES), r["quality"]) for r in rows]


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> AttentionModel | None:
    """The fitted model, or none if no labelled document is there."""
    rows = training_rows(docs, labels, most)
    return AttentionModel.fit([r[0] for r in rows], [r[1] for r in rows]) if rows else None


def quality_score(df: DataFrame, model: AttentionModel | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out``, from 0 to 1: the probability that the whole text is of quality.

    Null and empty texts have one empty passage; equal texts score alike; without a model every score is 0.5; a
    column named ``out`` is replaced and others pass through. One map without a shuffle.
    """

    @arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            if model is None:
                yield pa.array([0.5] * len(texts), pa.float64())
                continue
            found = [model.score([encode(t.as_py()) for t in texts[at : at + 256]]) for at in range(0, len(texts), 256)]
            yield pa.array(np.concatenate(found) if found else [], pa.float64())

    return replace_column(df, out, scores.asNondeterministic()(F.col(f"`{text_col}`")))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model learned from the labels that aren't held out; a row without an id isn't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = quality_score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
