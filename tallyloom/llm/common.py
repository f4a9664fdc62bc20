"""What several operators of this subpackage share: tables, stored intermediates and text pieces."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path  # noqa: F401

#: Bytes of text that one inner step of an operator holds at once; a longer single text is held alone.
STEP_BYTES = 4 << 20
#: Entries of a per-process cache before it is emptied; workers live on, so what is cached stays in their memory.
CACHE_ENTRIES = 200_000

_UNSAFE = re.compile(r" (?:(?=\s)|(?<=\s ))")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it; on a cluster it is installed or sent with --py-files."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [env.get("PYTHONPATH")])])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it again: later steps start from reliable files."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text modulo the number of folds; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of the text column."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def chunks(text: str) -> list[str]:
    """Cut a text at single spaces between two characters that are not white space; each later chunk misses its leading space.

    The pretokenizer pattern always begins a match at such a space, so chunks can be tokenized one by one.
    """
    return text.split(" ") if splits_at_spaces(text) else _SAFE_CUT.split(text)


def splits_at_spaces(text: str) -> bool:
    """Every space stands between two characters that are not white space."""
    return not (text[:1].isspace() or text[-1:].isspace()) and _UNSAFE.search(text) is None


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
