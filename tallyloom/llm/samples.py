"""Bounded samples of labelled documents and hashed character n-grams, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common

#: A text of more than a class's bytes / SMALL waits until all shorter ones of its class are taken.
SMALL = 64


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, class_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table of key, text and label of at most ``per_class`` learnable keys a class and ``class_bytes`` bytes of whole texts.

    Keys are taken in the order of a hash, which tells nothing of their content; those with more text than ``class_bytes`` /
    ``SMALL`` come after all others, the shortest first, so a long text takes no other's place, and a class that has a text
    has one in the sample, however long.  Rows of the held-out fold, null labels and labels other than 0 and 1 are never
    taken.  A key with both labels counts as 1.  These bounds are all that limits the work of fitting; scoring covers every row.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (common.fold(F.col(key), folds) != held_out))
    marks = marks.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label)).cast("int").alias("label"))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sizes = texts.groupBy("key").agg(F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))
    late = F.when(F.col("bytes") > class_bytes // SMALL, F.col("bytes")).otherwise(F.lit(0))
    sized = common.stored(marks.join(sizes, "key").withColumn("late", late), "labelled-sizes")
    turn = ["late", F.xxhash64("key"), "key"]
    chosen = [sized.where(F.col("label") == v).orderBy(*turn).limit(per_class) for v in (0, 1)]
    # only keys and sizes meet in the running sum: per_class rows a class
    order = Window.partitionBy("label").orderBy(*turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ids = chosen[0].union(chosen[1]).withColumn("upto", F.sum("bytes").over(order))
    fits = ids.where((F.col("upto") <= class_bytes) | (F.col("upto") == F.col("bytes"))).select("key", "label")
    return common.stored(texts.join(F.broadcast(fits), "key"), "labelled")  # at most 2 * per_class keys: a proven bound


def labelled(*args, **kwargs) -> pd.DataFrame:
    """Columns text and label of ``labelled_rows`` in a fixed order, on the driver."""
    return labelled_rows(*args, **kwargs).orderBy("label", F.xxhash64("key"), "key", "text").select("text", "label").toPandas()


def fitted(rows: DataFrame, fit: Callable[[list[str], np.ndarray], bytes]) -> bytes:
    """What ``fit`` makes of a bounded sample's texts and labels, in the same order, in one task: the driver gets the model only."""
    ordered = rows.select(F.lit(0).alias("one"), "label", F.xxhash64("key").alias("turn"), "key", "text").repartition(1).sortWithinPartitions("label", "turn", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            marks += b.column("label").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, np.array(marks, np.int64))], pa.binary())], ["model"])

    found = ordered.mapInArrow(run, "model binary").first()
    return bytes(found["model"]) if found else fit([], np.zeros(0, np.int64))  # an empty sample may have no task


_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], np.uint64)


def gram_hashes(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of the n codes that begin at each place, to ``bits`` bits."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = (h ^ codes[k:k + size]) * _PRIMES[k]
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
