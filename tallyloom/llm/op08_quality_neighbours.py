"""Quality by nearest-neighbour voting in a latent semantic space of style terms.

A text's terms are runs of character classes (capitals, small letters, digits, signs as they are), repeats of words and the
share of distinct words, so they describe how a text is made in any language.  Weighted term vectors of a bounded labelled
sample are reduced by a truncated singular value decomposition; the labelled latent vectors, a table of fixed size, go to
every task, and each document's cosine to all of them comes from blocked matrix products.  The nearest labelled rows vote
with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, samples

FOLDS, HELD_OUT, CUTOFF = 4, 2, 0.7
#: Bounds of the labelled sample, a class; with them the broadcast vectors are at most 2 * SAMPLE_ROWS * DIM numbers.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 6 << 20
BUCKET_BITS, GRAMS, DIM, NEIGHBOURS, SHARPNESS, BLOCK, SEED = 12, (1, 2, 3, 4), 48, 25, 8.0, 256, 11

_CLASSES: np.ndarray | None = None
_MARKS = {"word": 1, "same": 2, "skip": 3, "distinct": 4, "length": 5, "line": 6}


def class_table() -> np.ndarray:
    """Code point to class: A for capitals, a for other letters, 0 for digits, space, line break, and signs as they are."""
    global _CLASSES
    if _CLASSES is None:
        table = np.arange(0x110000, dtype=np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                table[k] = 65 if c.isupper() else 97
            elif c.isdigit():
                table[k] = 48
            elif c.isspace():
                table[k] = 10 if c in "\n\r" else 32
        _CLASSES = table
    return _CLASSES


def _bucket(kind: str, value: int) -> int:
    return int(samples.gram_hashes(np.array([0x7FFFFFFF, _MARKS[kind], value], np.uint64), 3, BUCKET_BITS)[0])


def _level(share: float) -> int:
    return int(round(10 * share))


def terms(text: str) -> np.ndarray:
    """Weights of the hashed style terms of a whole text, each n-gram order and kind of its own unit length."""
    size = 1 << BUCKET_BITS
    out = np.zeros(size)
    codes = class_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    if not len(codes):
        return out
    runs = codes[np.concatenate([[True], (codes[1:] != codes[:-1]) | (codes[1:] != 97)])].astype(np.uint64)  # runs of small letters are one sign
    for n in GRAMS:
        h = samples.gram_hashes(runs, n, BUCKET_BITS)
        if len(h):
            c = np.sqrt(np.bincount(h, minlength=size))
            out += c / np.linalg.norm(c)
    words = text.lower().split()
    if words:
        n = len(words)
        same = sum(map(str.__eq__, words, words[1:])) / max(1, n - 1)
        skip = sum(map(str.__eq__, words, words[2:])) / max(1, n - 2)
        sign = {"same": _level(same), "skip": _level(skip), "distinct": _level(len(set(words)) / min(n, 2000)) if n > 20 else 11, "length": min(20, len(text) // n)}
        lines = text.split("\n")
        sign["line"] = _level(len(set(lines)) / len(lines))
        for kind, value in sign.items():
            out[_bucket(kind, value)] += 1.0
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, texts: list[str]) -> np.ndarray:
        x = np.stack([terms(t) for t in texts]) * self.idf
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def vote(self, texts: list[str]) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled rows, blocked over the texts."""
        out = np.full(len(texts), self.prior)
        if not len(self.labels) or not self.axes.size:
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            z = self.latent(texts[at:at + BLOCK])
            cos = z @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            weight = np.exp(SHARPNESS * (np.take_along_axis(cos, near, 1) - 1)) + 1e-9
            share = (weight * self.labels[near]).sum(1) / weight.sum(1)
            out[at:at + BLOCK] = np.where(np.abs(z).sum(1) > 0, share, self.prior)
        return out


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Inverse document frequencies, latent axes and the labelled latent vectors; the prior is the share of label 1."""
    y = np.asarray(labels, float)
    if not len(y):
        return Model(np.ones(1 << BUCKET_BITS), np.zeros((1 << BUCKET_BITS, 0)), np.zeros((0, 0)), y, 0.5)
    x = np.stack([terms(t) for t in texts]).astype(np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.3).astype(np.float32)
    x *= idf
    rng = np.random.default_rng(SEED)
    dim = min(DIM, *x.shape)
    q = np.linalg.qr(x @ (x.T @ (x @ rng.normal(size=(x.shape[1], dim + 8)).astype(np.float32))))[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:dim].T
    model = Model(idf, axes, np.zeros((0, dim)), y, float(y.mean()))
    z = x @ axes
    model.vectors = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    rows = samples.labelled(docs, labels, label, FOLDS, HELD_OUT, SAMPLE_ROWS, SAMPLE_BYTES, key, text)
    return fit(rows["text"].tolist(), rows["label"].to_numpy())


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row; a null or empty text, or one without terms, gets the share of label 1 in the sample."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches, "text"):
            got = handle.value.vote([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.clip(got, 0.0, 1.0), pa.float64())], ["key", "score"])

    kind = docs.select(key).dtypes[0][1]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of every row; labels, lang, source and the key are never inputs of a score."""
    got = score(docs, train(docs, labels, key=key, text=text), key, text)
    return got.select(key, (common.fold(F.col(key), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
