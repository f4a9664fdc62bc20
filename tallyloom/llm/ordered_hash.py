"""SHA-256 of strings joined in order per group, where a group may be larger than any task's memory.

A hash reads its text from front to back, so one task ends up reading a group's text; it holds no more than a piece of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common

#: Bytes of a piece.
PIECE = 1 << 20


def _fields(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {k}, " for n, k in df.select(*names).dtypes)


def _rows(batches: Iterator[pa.RecordBatch], keys: list[str], text: str) -> Iterator[tuple[tuple, str]]:
    for b in batches:
        yield from zip(zip(*(b.column(k).to_pylist() for k in keys)), b.column(text).to_pylist())


def _batch(names: list[str], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*rows))], names)


def _arrow(df: DataFrame, keys: list[str], more: list[tuple[str, pa.DataType]]) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([*((n, kinds[k]) for n, k in df.select(*keys).dtypes), *more])


def pieces(rows: DataFrame, keys: list[str], order: list[str], text: str, sep: str, size: int = PIECE) -> DataFrame:
    """Sort all rows by range, so that a large group lies in several tasks; keys, part, seq and joined pieces, or the hash of a group.

    A group that begins and ends inside a task and fits a piece comes as one row with ``sha256``; the pieces of others have none.
    """
    names, schema = [*keys, "part", "seq", "piece", "sha256"], _arrow(rows, keys, [("part", pa.int32()), ("seq", pa.int32()), ("piece", pa.string()), ("sha256", pa.string())])
    ranged = rows.select(*keys, *order, text).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        now, held, length, seq, opening = None, [], 0, 0, True

        def close(last: bool) -> None:
            nonlocal held, length, seq, opening
            if now is not None:
                piece = sep.join(held)
                whole = not (opening or last or seq)
                out.append((*now, part, seq, None if whole else piece, hashlib.sha256(piece.encode()).hexdigest() if whole else None))
                opening = False
            held, length, seq = [], 0, 0

        for key, value in _rows(batches, keys, text):
            if key != now:
                close(False)
                now = key
            elif length >= size:
                out.append((*now, part, seq, sep.join(held), None))
                held, length, seq = [], 0, seq + 1
            held.append(value)
            length += len(value) + len(sep)
            if len(out) >= 4096:
                yield _batch(names, out, schema)
                out.clear()
        close(True)
        if out:
            yield _batch(names, out, schema)

    return ranged.mapInArrow(run, _fields(rows, keys) + "part int, seq int, piece string, sha256 string")


def hash_pieces(parts: DataFrame, keys: list[str], order: list[str], text: str, sep: str) -> DataFrame:
    """Keys and sha256 of each group's pieces joined in order, read one by one."""
    schema = _arrow(parts, keys, [("sha256", pa.string())])
    sorted_parts = parts.select(*keys, *order, text).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for key, piece in _rows(batches, keys, text):
            if key != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(piece.encode())
            else:
                state.update((sep + piece).encode())
            if len(out) >= 4096:
                yield _batch(schema.names, out, schema)
                out = []
        if now is not None:
            yield _batch(schema.names, [*out, (*now, state.hexdigest())], schema)

    return sorted_parts.mapInArrow(run, _fields(parts, keys) + "sha256 string")


def joined_sha256(rows: DataFrame, keys: list[str], order: list[str], text: str, sep: str = ",", size: int = PIECE) -> DataFrame:
    """Keys and sha256 (lowercase hex) of each group's texts, joined by ``sep`` in ``order``; texts are not null."""
    parts = common.stored(pieces(rows, keys, order, text, sep, size), "pieces")
    done = parts.where(F.col("sha256").isNotNull()).select(*keys, "sha256")
    return done.unionByName(hash_pieces(parts.where(F.col("sha256").isNull()), keys, ["part", "seq"], "piece", sep))
