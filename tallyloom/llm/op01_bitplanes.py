"""Token ids as bit- or byte-plane blocks: encode documents in key order, write plane-compressed chunks, read them back.

File format (a folder, written and read by Spark): ``chunks`` is a Parquet table with one row per block of ``block`` ids
(the last block of a shard is shorter).  A row holds the shard, its number in the shard, the position of its first id in
the shard, the id count and width, the planes (each zstandard-compressed, with their sizes), a crc32 of the raw block, and
the documents that begin in it (key, first position, length); ``carry`` says how many ids at its head belong to a document
that began before, and ``carry_first`` where.  ``index`` is the chunk index: one row per chunk with its global start and the
same counts, without payload.  A shard is one range of the key order, so its files are rebuilt alike after a loss.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from ..session import scratch_path
from . import common

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Ids of a block; parts of texts whose ids a process remembers.
BLOCK, CACHE_ENTRIES = 1 << 16, 500_000
#: Signs of the last match of a line, if a letter or digit stands before them.
_SIGNS = ".,!?;:#$%*"

_CHUNK_SCHEMA = (
    "shard int, chunk int, first bigint, n_ids int, width int, planes string, sizes array<int>, payload binary, crc32 bigint, "
    "carry int, carry_first bigint, doc_keys array<{key}>, doc_first array<bigint>, doc_ids array<bigint>")


# --- planes -------------------------------------------------------------------------------------------------------

def to_planes(ids: np.ndarray, width: int, planes: str = "byte", level: int = 1) -> tuple[bytes, list[int]]:
    """Transpose a block of ids into bit or byte planes and compress each; the payload and the planes' sizes."""
    raw = np.ascontiguousarray(ids, f"<u{width}").view(np.uint8).reshape(-1, width)
    if planes == "byte":
        parts = [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(width)]
    elif planes == "bit":
        parts = [np.packbits((raw[:, k // 8] >> (k % 8)) & 1).tobytes() for k in range(8 * width)]
    else:
        raise ValueError("planes are 'bit' or 'byte'")
    press = zstandard.ZstdCompressor(level=level)
    done = [press.compress(p) for p in parts]
    return b"".join(done), [len(d) for d in done]


def from_planes(payload: bytes, sizes: list[int], n: int, width: int, planes: str) -> np.ndarray:
    """The ids of a block as unsigned 32-bit integers."""
    press, at, raw = zstandard.ZstdDecompressor(), 0, np.zeros((n, width), np.uint8)
    for k, size in enumerate(sizes):
        plane = np.frombuffer(press.decompress(payload[at:at + size]), np.uint8)
        at += size
        if planes == "byte":
            raw[:, k] = plane
        else:
            raw[:, k // 8] |= np.unpackbits(plane, count=n) << (k % 8)
    return raw.view(f"<u{width}").reshape(-1).astype("<u4")


# --- tokenizer ----------------------------------------------------------------------------------------------------

def _solid(char: str) -> bool:
    """Not white space to any library: a letter, a digit or a printable ASCII sign."""
    return char.isalnum() or "!" <= char <= "~"


class ChunkTokenizer:
    """The tokenizers library over safe chunks of texts: the distinct chunks of a step are looked up once, and each distinct part
    of a chunk is encoded once while it is cached.

    Parts are what the pretokenizer pattern always tells apart: the lines of a chunk that a single newline divides, and the
    signs that end a line after a letter or digit.  Parts are kept in two generations, so those in use stay.
    """

    def __init__(self, path: str, limit: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.model = Tokenizer.from_file(path)
        # the library finds these in a text before all else; they hold no space, so the cuts stay safe
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        # they may lie within words and closing signs
        self.wordy = any(all(c.isalnum() or c in _SIGNS for c in t) for t in self.added)
        size = self.model.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.opens = np.zeros(size, bool)  # tokens that begin with a space; a part has no other space
        for token, k in self.model.get_vocab().items():
            self.opens[k] = token.startswith("Ġ")
        self.limit, self._young, self._old = limit, {}, {}
        self.newline, = self._ids(["\n"])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str], spaced: bool, words: bool) -> None:
        """Encode parts, those of one kind by one call: as they are with a space before each, or as lines of one text; odd ones
        each alone."""
        young = self._young
        plain = parts if words and not self.wordy else [p for p in parts if self._plain(p[spaced:])]
        if len(self.newline) != 1 and not spaced:
            plain = []
        if plain:
            ids, = self._ids(["".join(plain) if spaced else "\n" + "\n".join(plain)])
            cuts = np.flatnonzero(self.opens[ids] if spaced else ids == self.newline[0])
            raw, ends = ids.tobytes(), [*(cuts[1:] * self.width).tolist(), ids.nbytes]
            starts = ((cuts if spaced else cuts + 1) * self.width).tolist()
            young.update((p, raw[a:b]) for p, a, b in zip(plain, starts, ends, strict=True))
        if len(plain) < len(parts):
            odd = list({*parts}.difference(plain))
            young.update((p, ids.tobytes()) for p, ids in zip(odd, self._ids(odd)))

    def _plain(self, part: str) -> bool:
        return bool(part) and not (part[0].isspace() or part[-1].isspace() or " " in part or "\n" in part or any(t in part for t in self.added))

    def _parts(self, chunk: str) -> list[str]:
        """A chunk that is no word, its opening space included, cut where the pattern always begins a match."""
        lines, out = [chunk], []
        if "\n" in chunk:
            bare = chunk.removeprefix(" ")
            lines = bare.split("\n")
            if " " in bare or not all(_solid(x[:1]) and _solid(x[-1:]) for x in lines):
                return [chunk]
            lines[0] = chunk[:len(chunk) - len(bare)] + lines[0]
        for line in lines:
            stem = line.rstrip(_SIGNS)
            # a letter or digit before the last signs ends a match, so the signs are a match of their own
            if len(stem) < len(line) and stem[-1:].isalnum() and not any(t in line for t in self.added):
                out += stem, line[len(stem):], "\n"
            else:
                out += line, "\n"
        return out[:-1]

    def _found(self, names: list[str]) -> tuple[list[bytes | None], list[int]]:
        """What is known of the names, and the places of the others."""
        young, old = self._young, self._old
        out = list(map(young.get, names))
        new = []
        for k in [k for k, v in enumerate(out) if v is None]:
            v = old.get(names[k])
            if v is None:
                new.append(k)
            else:
                out[k] = young[names[k]] = v
        return out, new

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; what was not seen for long is forgotten."""
        if len(self._young) >= self.limit // 2:
            self._young, self._old = {}, self._young
        out, new = self._found(chunks)
        words, cut, parts = [], [], []
        for k in new:
            c = chunks[k]
            if c[1:].isalnum():
                words.append(c)
                continue
            stem = c.rstrip(_SIGNS)
            if stem[1:].isalnum() and not self.wordy:
                cut.append((k, stem, c[len(stem):]))
            else:
                cut.append((k, *self._parts(c)))
        names = list(set(chain.from_iterable(ps for _, *ps in cut)))
        for p in map(names.__getitem__, self._found(names)[1]):
            (words if p[1:].isalnum() else parts).append(p)
        behind = {w for w in words if w[0] == " "}
        self._learn(list(behind), True, True)
        parts += set(words).difference(behind)
        for spaced in (True, False):
            self._learn(list({p for p in parts if p.startswith(" ") == spaced}), spaced, False)
        young = self._young
        for k, *ps in cut:
            if len(ps) > 1:
                young[chunks[k]] = b"".join(map(young.__getitem__, ps))
        for k in new:
            out[k] = young[chunks[k]]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Raw little-endian ids of each whole text."""
        texts = [t or "" for t in texts]
        easy = [common.splits_at_spaces(t) for t in texts]
        order = [k for k, e in enumerate(easy) if e] + [k for k, e in enumerate(easy) if not e]
        split = pc.split_pattern(pa.array([t for t, e in zip(texts, easy) if e], pa.large_string()), " ")
        rest = [common.chunks(t) for t, e in zip(texts, easy) if not e]
        flat = pa.concat_arrays([split.flatten(), pa.array([c for cs in rest for c in cs], pa.large_string())])
        ends = np.cumsum([*pc.list_value_length(split).to_pylist(), *map(len, rest)], dtype=np.int64)
        begins = np.concatenate([[0], ends])[:-1].astype(np.int64)
        heads = flat.take(pa.array(begins)).to_pylist()  # a text's first chunk has no space before it
        coded = flat.dictionary_encode()
        names = pc.utf8_replace_slice(coded.dictionary, 0, 0, " ").to_numpy(zero_copy_only=False).tolist()
        pick = coded.indices.to_numpy().astype(np.int64)
        pick[begins] = np.arange(len(names), len(names) + len(heads))
        names += heads
        raw = self._known(names)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // self.width
        table, starts = np.frombuffer(b"".join(raw), self.kind), np.cumsum(size) - size
        counts = size[pick]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = table[np.repeat(starts[pick] - upto[:-1], counts) + np.arange(upto[-1])]
        out: list[bytes] = [b""] * len(texts)
        for k, a, b in zip(order, upto[begins].tolist(), upto[ends].tolist()):
            out[k] = ids[a:b].tobytes()
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


# --- writer -------------------------------------------------------------------------------------------------------

def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, block: int = BLOCK, planes: str = "byte") -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the ids in ascending key order.

    Null keys come first; equal keys follow their text's order, so repeated rows give the same file.  An empty table gives
    a folder with empty tables.  The key order is a range partitioning: one task holds one range, never a whole key order.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    kind = docs.select(key).dtypes[0][1]
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, shard = tokenizer(path), TaskContext.get().partitionId()
        end = np.array([end_id], tok.kind).tobytes()
        schema = None
        state = {"chunk": 0, "first": 0, "at": 0, "carry": None, "left": 0}
        held: list[bytes] = []  # raw ids of the block being filled
        filled, keys, firsts, lengths = 0, [], [], []

        def emit():
            nonlocal held, filled, keys, firsts, lengths
            raw = b"".join(held)
            ids = np.frombuffer(raw, tok.kind)
            payload, sizes = to_planes(ids, tok.width, planes)
            carry = min(state["left"], len(ids))
            row = {"shard": [shard], "chunk": [state["chunk"]], "first": [state["first"]], "n_ids": [len(ids)], "width": [tok.width], "planes": [planes],
                   "sizes": [sizes], "payload": [payload], "crc32": [zlib.crc32(raw)], "carry": [carry], "carry_first": [state["carry"] if carry else None],
                   "doc_keys": [keys], "doc_first": [firsts], "doc_ids": [lengths]}
            state["left"] -= carry
            if firsts and firsts[-1] + lengths[-1] > state["first"] + len(ids):
                state["carry"], state["left"] = firsts[-1], firsts[-1] + lengths[-1] - state["first"] - len(ids)
            state["chunk"] += 1
            state["first"] += len(ids)
            held, filled, keys, firsts, lengths = [], 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in schema], schema=schema)

        for b in common.steps(batches, "text"):
            if schema is None:
                wide = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
                schema = pa.schema([(n, pa.list_(b.schema.field("key").type if "{key}" in t else wide[t[6:-1]]) if t.startswith("array") else wide[t]) for n, t in (x.rsplit(" ", 1) for x in _CHUNK_SCHEMA.split(", "))])
            for k, raw in zip(b.column("key").to_pylist(), tok.encode(b.column("text").to_pylist())):
                raw += end
                keys.append(k)
                firsts.append(state["at"])
                lengths.append(len(raw) // tok.width)
                state["at"] += lengths[-1]
                at = 0
                while at < len(raw):
                    take = min(len(raw) - at, (block - filled) * tok.width)
                    held.append(raw[at:at + take])
                    at += take
                    filled += take // tok.width
                    if filled == block:
                        yield emit()
        if filled:
            yield emit()

    ordered.mapInArrow(run, _CHUNK_SCHEMA.replace("{key}", kind)).write.option("compression", "none").parquet(f"{folder}/chunks")
    spark = docs.sparkSession
    light = spark.read.parquet(f"{folder}/chunks").drop("payload", "sizes", "doc_keys", "doc_first", "doc_ids")
    starts = shard_starts(spark.read.parquet(f"{folder}/chunks"))
    index = light.join(starts, "shard").withColumn("start", F.col("shard_start") + F.col("first")).drop("shard_start")
    index.write.option("compression", "zstd").parquet(f"{folder}/index")


def shard_starts(chunks: DataFrame) -> DataFrame:
    """Ids before each shard: one row per shard meets in the running sum, no more."""
    per = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


# --- reader -------------------------------------------------------------------------------------------------------

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the crc polynomial, lowest power in the highest bit."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


@lru_cache(maxsize=1 << 12)
def _shift(n: int) -> int:
    """x to the power 8 n."""
    out, square = 1 << 31, 1 << 30
    n *= 8
    while n:
        if n & 1:
            out = _times(out, square)
        square = _times(square, square)
        n >>= 1
    return out


def crc32_concat(parts: list[tuple[int, int]]) -> int:
    """crc32 of a concatenation, from each part's crc32 and length in bytes."""
    out = 0
    for crc, n in parts:
        out = _times(_shift(n), out) ^ crc
    return out


def blocks(folder: str, spark: SparkSession) -> DataFrame:
    """The blocks read back: shard, chunk, first, ids array<bigint>."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = from_planes(r["payload"], r["sizes"], r["n_ids"], r["width"], r["planes"])
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]], pa.int32()), pa.array([r["chunk"]], pa.int32()), pa.array([r["first"]], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["shard", "chunk", "first", "ids"])

    return spark.read.parquet(f"{folder}/chunks").mapInArrow(run, "shard int, chunk int, first bigint, ids array<bigint>")


def documents(folder: str, spark: SparkSession, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32.

    Each block is decoded once; a document that spans blocks is put together from the crc32 of its parts, a few numbers
    per block, so no ids move.
    """
    chunks = spark.read.parquet(f"{folder}/chunks")
    kind = chunks.select(F.explode("doc_keys").alias("k")).dtypes[0][1]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = from_planes(r["payload"], r["sizes"], r["n_ids"], r["width"], r["planes"])
                if zlib.crc32(ids.astype(f"<u{r['width']}")) != r["crc32"]:
                    raise ValueError(f"shard {r['shard']}, chunk {r['chunk']}: the block does not match its crc32")
                cut = [(r["carry_first"], None, None, 0, r["carry"])] if r["carry"] else []
                for k, at, n in zip(r["doc_keys"], r["doc_first"], r["doc_ids"]):
                    lo = at - r["first"]
                    cut.append((at, k, n, lo, min(lo + n, r["n_ids"])))
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["shard"]] * len(cut), pa.int32()), pa.array([c[0] for c in cut], pa.int64()), pa.array([c[1] for c in cut], b.schema.field("doc_keys").type.value_type),
                    pa.array([c[2] for c in cut], pa.int64()), pa.array([r["chunk"]] * len(cut), pa.int32()),
                    pa.array([zlib.crc32(ids[c[3]:c[4]]) for c in cut], pa.int64()), pa.array([4 * (c[4] - c[3]) for c in cut], pa.int64())], ["shard", "first", "key", "n_tokens", "chunk", "crc", "bytes"])

    found = chunks.mapInArrow(parts, f"shard int, first bigint, key {kind}, n_tokens bigint, chunk int, crc bigint, bytes bigint")
    whole = found.groupBy("shard", "first").agg(
        F.max("key").alias("key"), F.max("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("chunk", "crc", "bytes"))).alias("parts"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [p[0]["crc"] if len(p) == 1 else crc32_concat([(x["crc"], x["bytes"]) for x in p]) for p in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("shard", "first", "key", "n_tokens")], pa.array(crc, pa.int64())], ["shard", "first", "key", "n_tokens", "ids_crc32"])

    done = whole.mapInArrow(put_together, f"shard int, first bigint, key {kind}, n_tokens bigint, ids_crc32 bigint")
    return done.join(shard_starts(chunks), "shard").select(F.col("key").alias(key), (F.col("shard_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def encode_write_read(docs: DataFrame, **options) -> DataFrame:
    """Write the documents' ids to a fresh folder of the shared place and return what the files say."""
    folder = scratch_path(docs.sparkSession, "token-planes")
    write(docs, folder, **options)
    return documents(folder, docs.sparkSession, options.get("key", "doc_id"))
