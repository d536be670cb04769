"""Quality classifier: supervised subword embeddings (operator 6).

A document is the average of learned vectors of its words and their character n-grams, each hashed
into a fixed number of rows (and of one pseudo-word for how often its words recur); a softmax layer gives the label. Rows and layer are trained by numpy
stochastic gradient descent on the driver, on at most ``Settings.sample`` labelled documents (the
sample is the rows of least hash, so it spreads over the table). With two labels the score needs of
each word only one number (the sum of its vectors along the layer's direction) and its count of
features, so executors score whole texts by look-up.

Defined cases: null and empty texts have the zero vector, so the score of the layer's bias; labels
that are null are left out, a doc_id with several labels takes the largest; rows may repeat (a row
each); without any label every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import workers


@dataclass(frozen=True)
class Settings:
    sample: int = 4000
    rows: int = 1 << 17
    width: int = 16
    grams: tuple[int, ...] = (3, 4)
    variety: int = 4
    epochs: int = 8
    rate: float = 0.5
    seed: int = 7


def word_features(word: str, s: Settings) -> list[int]:
    """Row numbers of a word and of its n-grams."""
    mask = s.rows - 1
    crc = zlib.crc32
    marked = f"<{word}>".encode()
    out = [crc(marked, 1) & mask]
    text = f"<{word}>"
    for n in s.grams:
        out += [crc(text[i : i + n].encode()) & mask for i in range(len(text) - n + 1)]
    return out


def variety_feature(distinct: int, words: int, s: Settings) -> int:
    """Row of a pseudo-word for how often words recur, which an average of words cannot show."""
    return zlib.crc32(b"\0variety%d" % math.floor(math.log2(words / distinct)), 2) & (s.rows - 1)


def text_features(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a text and how often each occurs."""
    counts: dict[str, int] = {}
    for w in (text or "").split():
        counts[w] = counts.get(w, 0) + 1
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    rows, weight = [], []
    for w, n in counts.items():
        f = word_features(w, s)
        rows += f
        weight += [n] * len(f)
    words = sum(counts.values())
    rows.append(variety_feature(len(counts), words, s))
    weight.append(s.variety * words)
    found, inverse = np.unique(np.array(rows, np.int32), return_inverse=True)
    return found, np.bincount(inverse, weights=weight).astype(np.float32)


@dataclass
class Model:
    settings: Settings
    direction: np.ndarray  # of each row, its vector along the layer's difference
    bias: float


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> Model:
    if not len(labels):
        return Model(s, np.zeros(s.rows), 0.0)
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.width, 1 / s.width, (s.rows, s.width))
    layer, bias = np.zeros((s.width, 2)), np.zeros(2)
    steps, done = s.epochs * len(labels), 0
    shares = [w / w.sum() if len(w) else w for _, w in examples]
    for _ in range(s.epochs):
        for i in rng.permutation(len(labels)):
            rate = s.rate * (1 - done / steps)
            done += 1
            rows, share = examples[i][0], shares[i]
            mean = share @ vectors[rows] if len(rows) else np.zeros(s.width)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1  # the gradient by the logits
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            if len(rows):
                # fastText gives every row the whole gradient; by share it would be too small to learn.
                vectors[rows] -= rate * np.minimum(1.0, share * len(rows))[:, None] * back
    return Model(s, vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Train on labelled rows that are not held out."""
    known = labels.filter(labels[key].isNotNull() & labels[label].isNotNull() & ~held_out(labels[key])).groupBy(labels[key].alias("k")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(s.sample)
    # One text of each id, so that what reaches the driver is bounded by the sample whatever the ids are.
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).join(F.broadcast(chosen), "k").groupBy("k").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.first("y").alias("y"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t, s) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([b.astype("<f4").tobytes() for _, b in found], pa.binary())], ["k", "y", "f", "w"])

    got = rows.select(F.col("k").cast("long").alias("k"), "t", "y").mapInArrow(work, "k long, y int, f binary, w binary").collect()
    got.sort(key=lambda r: (r.k, bytes(r.f), bytes(r.w)))
    return train([(np.frombuffer(r.f, np.int32), np.frombuffer(r.w, "<f4").astype(np.float64)) for r in got], np.array([r.y for r in got], np.int64), s)


class Scorer:
    #: Words kept before the table starts anew.
    MOST = 1_000_000

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, complex] = {}

    def __call__(self, text: str | None) -> float:
        known, model = self.known, self.model
        words = (text or "").split()
        distinct = set(words)
        for w in distinct.difference(known):
            f = word_features(w, model.settings)
            known[w] = complex(model.direction[f].sum(), len(f))
        total = sum(map(known.__getitem__, words))
        if words:
            weight = model.settings.variety * len(words)
            total += complex(weight * model.direction[variety_feature(len(distinct), len(words), model.settings)], weight)
        if len(known) > self.MOST:
            known.clear()
        z = model.bias + (total.real / total.imag if words else 0.0)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    scored = docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(work, f"doc_id {docs.schema[key].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
