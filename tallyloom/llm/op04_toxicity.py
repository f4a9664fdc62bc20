"""Toxicity by subword bags: character n-gram vectors averaged into a linear softmax, all trained jointly in numpy.

A word's vector is the mean of its n-grams' vectors, so a misspelling never seen shares most of its vector with the word it
comes from.  A window of words is the mean of its words; the softmax scores every window of the whole text and the mean of these
logits, each weighted by the exponential of itself, pools them, in training as in scoring, because labels are given for whole texts: a
few words count in a text of any length, and a text said many times over scores as said once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, samples

FOLDS, HELD_OUT, CUTOFF = 3, 1, 0.7
#: Bounds of the labelled sample that the model is fitted on, a class.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 4 << 20
NGRAMS, BUCKET_BITS, DIM, WINDOW = (3, 4, 5, 6), 17, 12, 2
EPOCHS, RATE, DECAY, SHARPNESS, SEED = 40, 0.3, 1e-5, 3.0, 7


def words_of(text: str) -> list[str]:
    return text.lower().split()


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of each word between its two borders, and the words they belong to."""
    marked = ["<" + (w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w) + ">" for w in words]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = samples.code_points("".join(marked))
    owner = np.repeat(np.arange(len(words), dtype=np.int32), length)
    room = np.repeat(np.cumsum(length).astype(np.int32), length) - np.arange(len(codes), dtype=np.int32)  # code points up to the word's end
    ids, of = [], []
    for n in NGRAMS:
        h = samples.gram_hashes(codes, n, BUCKET_BITS)
        ok = room[:len(h)] >= n
        ids.append(h[ok])
        of.append(owner[:len(h)][ok])
    return np.concatenate(ids), np.concatenate(of)


def window_means(s: np.ndarray, window: int) -> np.ndarray:
    """Mean over each run of ``window`` values; over all values if there are fewer."""
    if len(s) <= window:
        return np.array([s.mean()]) if len(s) else np.zeros(0)
    c = np.concatenate([[0.0], np.cumsum(s)])
    return (c[window:] - c[:-window]) / window


def pool(z: np.ndarray) -> float:
    """Self-weighted mean of the windows' logits: near the largest, and no larger for more windows of the same kind."""
    e = np.exp(SHARPNESS * (z - z.max()))
    return float(e @ z / e.sum())


@dataclass
class Model:
    """What scoring needs: the softmax applied to each bucket's vector, and its offset."""

    pull: np.ndarray
    offset: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        ids, of = word_buckets(words)
        return np.bincount(of, self.pull[ids], len(words)) / np.maximum(np.bincount(of, minlength=len(words)), 1)


def fit(texts: list[str], labels: np.ndarray, seed: int = SEED) -> Model:
    """Full-batch Adam over the n-gram vectors and the softmax; without both classes the model is the class share, one half at most."""
    y = np.asarray(labels, float)
    bags = [words_of(t) for t in texts]
    some = np.array([len(b) > 0 for b in bags], bool)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.0
    flat = np.zeros(1 << BUCKET_BITS)
    if not len(y) or y.min() == y.max() or not some.any():
        return Model(flat, min(0.0, np.log(share / (1 - share))) if share else -50.0)
    y, bags = y[some], [b for b in bags if b]
    names: dict[str, int] = {}
    tokens = np.fromiter((names.setdefault(w, len(names)) for b in bags for w in b), np.int32)
    size = np.array([len(b) for b in bags])
    del bags
    starts = np.concatenate([[0], np.cumsum(size)])
    # every run of WINDOW words inside one text; one shorter window for a shorter text
    count = np.maximum(size - WINDOW + 1, 1)
    doc = np.repeat(np.arange(len(size), dtype=np.int32), count)
    lo = (starts[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
    width = np.minimum(size, WINDOW)[doc]
    first = np.cumsum(count) - count
    ids, word = word_buckets(list(names))
    inv = 1.0 / np.maximum(np.bincount(word, minlength=len(names)), 1)
    rng = np.random.default_rng(seed)
    vec, out, off = rng.normal(0, 0.3, (1 << BUCKET_BITS, DIM)).astype(np.float32), rng.normal(0, 0.3, DIM), -1.0
    state = [[np.zeros_like(vec), np.zeros_like(vec)], [np.zeros(DIM), np.zeros(DIM)], [np.zeros(1), np.zeros(1)]]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for epoch in range(1, EPOCHS + 1):
        pull = vec @ out
        s = np.bincount(word, pull[ids], len(names)) * inv
        c = np.concatenate([[0.0], np.cumsum(s[tokens])])
        z = (c[lo + width] - c[lo]) / width
        top = np.maximum.reduceat(z, first)
        e = np.exp(SHARPNESS * (z - top[doc]))
        e /= np.add.reduceat(e, first)[doc]
        pooled = np.add.reduceat(e * z, first)
        p = 1 / (1 + np.exp(-np.clip(pooled + off, -40, 40)))
        g = (p - y) * weight / len(y)
        gz = g[doc] * e * (1 + SHARPNESS * (z - pooled[doc])) / width
        edge = np.zeros(len(tokens) + 1)
        edge[lo] += gz  # each place begins and ends one window at most
        edge[lo + width] -= gz
        gs = np.bincount(tokens, np.cumsum(edge[:-1]), len(names)) * inv
        gb = np.bincount(ids, gs[word], 1 << BUCKET_BITS)
        grads = [gb[:, None].astype(np.float32) * out.astype(np.float32) + DECAY * vec, gb @ vec + DECAY * out, np.array([g.sum()])]
        params = [vec, out, None]
        for k, grad in enumerate(grads):
            m, v = state[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            step = RATE * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.999 ** epoch)) + 1e-8)
            if k == 2:
                off -= float(step[0])
            else:
                params[k] -= step
    return Model(vec @ out, off)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """Fit on the bounded sample, in one task: no array of it reaches the driver.  An empty sample gives a model that calls nothing toxic."""
    rows = samples.labelled_rows(docs, labels, label, FOLDS, HELD_OUT, SAMPLE_ROWS, SAMPLE_BYTES, key, text)

    def packed(texts: list[str], marks: np.ndarray) -> bytes:
        model = fit(texts, marks)
        return np.append(model.pull, model.offset).astype(np.float32).tobytes()

    flat = np.frombuffer(samples.fitted(rows, packed), np.float32).astype(float)
    return Model(flat[:-1], float(flat[-1]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's key, ``keep`` columns and score: the pooled softmax of all windows of the whole text.

    A null or wordless text gets the softmax of an empty window, the offset alone, never more than one half.  Rows are
    independent: no shuffle, any order, repeated keys row by row; an empty table gives an empty one.  Only the key, the text and
    ``keep`` are read, so no other column's name can clash.
    """
    pull, offset = model.pull.astype(np.float64), float(model.offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        inner = Model(pull, offset)
        for b in common.steps(batches, "__text"):
            bags = [words_of(t or "") for t in b.column("__text").to_pylist()]
            if len(known) >= common.CACHE_ENTRIES:
                known.clear()
            new = [w for w in set().union(*bags) if w not in known]
            if new:
                known.update(zip(new, inner.word_scores(new).tolist()))
            z = np.array([pool(window_means(np.fromiter(map(known.__getitem__, w), float, len(w)), WINDOW)) if w else min(0.0, -offset) for w in bags]) + offset
            got = pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            out = [*b.columns, got] if text in keep else [*b.columns[:-1], got]
            yield pa.RecordBatch.from_arrays(out, [*b.schema.names, "__score"] if text in keep else [*b.schema.names[:-1], "__score"])

    source = docs.select(F.col(key), *[c for c in keep if c != text], F.col(text).cast("string").alias("__text"))
    given = source.dtypes if text in keep else source.dtypes[:-1]
    scored = source.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in given) + ", __score double")
    return scored.withColumnRenamed("__score", "score").withColumnRenamed("__text", text)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of every row; labels, lang, source and the key are never inputs of a score."""
    got = score(docs, train(docs, labels, key=key, text=text), key, text)
    return got.select(key, (common.fold(F.col(key), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
