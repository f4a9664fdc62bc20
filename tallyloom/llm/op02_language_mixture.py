"""Language proportions of a document by expectation-maximisation over n-gram likelihoods.

Per language an n-gram model over hashed letter trigrams is counted from all learnable documents.  A document's trigrams are
a mixture of the languages' models; expectation-maximisation finds the proportions.  The language set grows from the best
single language, one language at a time, as long as twice the gain in log-likelihood exceeds the penalty of one more
proportion (Bayes' criterion).  The log-likelihood is concave in the proportions, so a language whose gradient at zero is
not positive cannot gain and is not tried.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, samples

FOLDS, HELD_OUT = 4, 2
ORDER, BUCKET_BITS, SMOOTH = 3, 16, 0.5
ROUNDS, TOLERANCE = 60, 1e-6
UNDETERMINED = "und"

_LETTER: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point the lower-case letter, or a space for whatever is not a letter."""
    global _LETTER
    if _LETTER is None:
        table = np.full(0x110000, 32, np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                table[k] = ord(low) if len(low) == 1 else k
        _LETTER = table
    return _LETTER


def grams(text: str) -> np.ndarray:
    """Hash buckets of the trigrams of letters; words are set apart by one space.  Empty if there is no letter."""
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    space = codes == 32
    if space.all():
        return np.zeros(0, np.uint32)
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first space of a run stays
    codes = np.concatenate([[32], codes[keep], [32, 32]]).astype(np.uint64)
    h = samples.gram_hashes(codes, ORDER, BUCKET_BITS)
    return h[codes[1:len(h) + 1] != 32]  # the middle is a letter


def counts(docs: DataFrame, language: str = "lang", text: str = "text") -> DataFrame:
    """(lang, bucket, n) over every given document: a task adds up its rows, Spark adds up the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BUCKET_BITS, np.int64))
        for b in common.steps(batches, "text"):
            held: dict[str, list[np.ndarray]] = defaultdict(list)
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                held[lang].append(grams(t))
            for lang, ids in held.items():
                total[lang] += np.bincount(np.concatenate(ids), minlength=1 << BUCKET_BITS)
        for lang, n in total.items():
            ids = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(n[ids], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.select(F.col(language).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, language: str = "lang", key: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Language names and their log-probabilities over the buckets: languages x 65,536 numbers, whatever the corpus."""
    learn = docs.where(common.fold(F.col(key), FOLDS) != HELD_OUT)
    rows = counts(learn, language, text).toPandas()
    names = sorted(rows["lang"].unique().tolist())
    n = np.zeros((len(names), 1 << BUCKET_BITS))
    n[[names.index(x) for x in rows["lang"]] if len(rows) else [], rows["bucket"].to_numpy(int)] = rows["n"]
    return names, np.log((n + SMOOTH) / (n.sum(1, keepdims=True) + SMOOTH * (1 << BUCKET_BITS)))


def proportions(n: np.ndarray, p: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture weights of the columns of ``p`` for counts ``n``, and the log-likelihood."""
    pi, total = start, n.sum()
    last = -np.inf
    for _ in range(ROUNDS):
        joint = p * pi
        mix = joint.sum(1)
        now = float(n @ np.log(mix))
        if now - last < TOLERANCE * total:
            break
        last = now
        pi = (n / mix) @ joint / total
    return pi, now


def mixture(ids: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Proportion of each language in a bag of trigrams; zeros for languages that are not selected."""
    places, n = np.unique(ids, return_counts=True)
    n = n.astype(float)
    lp = logp[:, places]
    single = lp @ n
    chosen = [int(single.argmax())]
    p = np.exp(lp - lp.max(0)).T  # scaled per trigram: the scale cancels
    best, pi = float(n @ np.log(p[:, chosen[0]])), np.ones(1)
    penalty = np.log(max(n.sum(), 2.0))
    while len(chosen) < len(logp):
        mix = p[:, chosen] @ pi
        slope = (n / mix) @ p - n.sum()
        slope[chosen] = 0
        nxt = int(slope.argmax())
        if slope[nxt] <= 0:
            break
        start = np.append(pi * 0.9, 0.1)
        new_pi, new = proportions(n, p[:, [*chosen, nxt]], start)
        if 2 * (new - best) <= penalty:
            break
        chosen, pi, best = [*chosen, nxt], new_pi, new
    out = np.zeros(len(logp))
    out[chosen] = pi
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred, score (the proportion of that language), languages and proportions of the selected set.

    A null text, a text without a letter, or a model without languages gives ``und`` with score 0 and an empty set.  Ties
    go to the first language by name.  Rows are independent; repeated keys are kept row by row.
    """
    names, logp = model[0], model[1].astype(np.float32).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches, "text"):
            pred, score, langs, shares = [], [], [], []
            for t in b.column("text").to_pylist():
                ids = grams(t or "") if names else np.zeros(0)
                if not len(ids):
                    pred.append(UNDETERMINED), score.append(0.0), langs.append([]), shares.append([])
                    continue
                pi = mixture(ids, logp)
                order = np.argsort(-pi, kind="stable")
                order = order[pi[order] > 0]
                pred.append(names[order[0]]), score.append(min(1.0, float(pi[order[0]])))
                langs.append([names[k] for k in order]), shares.append([float(pi[k]) for k in order])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], ["key", "lang_pred", "score", "languages", "proportions"])

    kind = docs.select(key).dtypes[0][1]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, languages array<string>, proportions array<double>").withColumnRenamed("key", key)


def languages(docs: DataFrame, language: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Predictions for every row from models learnt on the rows outside the held-out fold; lang, source and key are no inputs."""
    got = identify(docs, train(docs, language, key, text), key, text)
    return got.select(key, (common.fold(F.col(key), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "languages", "proportions")
