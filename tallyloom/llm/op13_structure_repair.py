"""Conversation structure repair by the auction algorithm for shortest paths.

The lattice of a conversation has a node per place between its rows and state of the grammar ``(s?(ua)+)?``: nothing yet, after a
system turn, after a user turn, after an assistant turn.  Edits are its arcs, with whole-number costs.  Every node has a price, and no
arc's price drop ever exceeds its cost.  A path grows from its origin: at its last node, if the price equals the least of
arc cost plus price behind it, the path extends along that arc, else the price rises to that least and the path gives up the node.
When it arrives, the origin's price is the cost of the cheapest repair.  The lattice is auctioned off in segments from the end,
each starting from the prices of the places behind it, so the work is linear in the rows.

The prices are an optimal dual: every cheapest repair uses only tight arcs, those whose cost equals the drop in price.  Among the
tight arcs that lead on to the end, the trace takes the least initial each time.  The state after a row of edits follows from
their initials, so the trace is one path and its edits the least in ASCII order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import common
from .ordered_hash import hash_pieces

#: Rows of a segment of the lattice; rows and bytes of a part of a conversation that a task holds at once.
SEGMENT, PART_ROWS, PART_BYTES = 16, 4096, 4 << 20
# Costs of the edits, and what an undeleted truncated row adds.
RENAME, DELETE, INSERT, KEPT_TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Edits inside the operator: K keep, D delete, U and A rename to user and assistant, u and a insert them.
INITIALS = str.maketrans("UAua", "RRII")
_ROLES = {"U": "user", "A": "assistant", "u": "user", "a": "assistant"}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


# --- the auction --------------------------------------------------------------------------------------------------

def _row_arcs(code: str) -> list[list[tuple[str, int, int]]]:
    """Arcs (edit, cost, next state) of each state over a row: ``!`` must go, else its initial, in capitals if truncated."""
    out = []
    for q in range(4):
        arcs = [("D", DELETE, q)]
        if code != "!":
            extra, initial, follow = KEPT_TRUNCATED * code.isupper(), code.lower(), _NEXT[q]
            kept = {"s": SYSTEM if q == START else None, "u": USER if follow == USER else None, "a": ASSISTANT if follow == ASSISTANT else None}.get(initial)
            if kept is not None:
                arcs.append(("K", extra, kept))
            if kept != follow:
                arcs.append(("U" if follow == USER else "A", RENAME + extra, follow))
        out.append(arcs)
    return out


_ARCS = {c: _row_arcs(c) for c in "!suaxSUAX"}
_INSERT = [("u" if _NEXT[q] == USER else "a", INSERT, _NEXT[q]) for q in range(4)]


def _arcs(codes: str, node: int) -> list[tuple[str, int, int]]:
    """Arcs (edit, cost, node) of a node; the last node is the end, which a finished grammar reaches free of cost."""
    i, q = divmod(node, 4)
    edit, cost, to = _INSERT[q]
    out = [(edit, cost, 4 * i + to)]
    if i < len(codes):
        out += [(e, c, 4 * i + 4 + t) for e, c, t in _ARCS[codes[i]][q]]
    elif q in (START, ASSISTANT):
        out.append(("", 0, 4 * i + 4))
    return out


def auction(codes: str, segment: int = SEGMENT) -> np.ndarray:
    """Prices of all nodes; exact on every cheapest path, and nowhere above the cost of going on."""
    n = len(codes)
    price = np.zeros(4 * n + 5, np.int64)
    cuts = [n + 1, n, *range(n - segment, 0, -segment), 0] if n else [1, 0]
    for hi, lo in zip(cuts, cuts[1:]):
        base, size = 4 * lo, 4 * (hi - lo)
        p = price[base:base + size + 4].tolist() if hi <= n else [0] * (size + 1)
        p[:size] = [min(p[size:])] * size  # no cheaper way on can exist
        arcs = [[(c, t - base) for _, c, t in _arcs(codes, base + k)] for k in range(size)]
        for origin in range(4):
            path = [origin]
            while path[-1] < size:
                k = path[-1]
                least, to = min((c + p[t], t) for c, t in arcs[k])
                if p[k] < least:
                    p[k] = least
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(to)
        price[base:base + size] = p[:size]
    return price


def trace(codes: str, price: np.ndarray) -> str:
    """The edits of the cheapest repair with the least initials, along tight arcs that lead on to the end."""
    n, p = len(codes), price.tolist()
    end = 4 * n + 4
    leads = bytearray(end + 1)
    leads[end] = 1
    for i in range(n, -1, -1):
        for _ in range(3):  # at most two insertions in a row are ever tight
            for k in range(4 * i, 4 * i + 4):
                if not leads[k]:
                    leads[k] = any(leads[t] and p[k] == c + p[t] for _, c, t in _arcs(codes, k))
    out, node = [], START
    while node != end:
        edit, node = min(((e, t) for e, c, t in _arcs(codes, node) if leads[t] and p[node] == c + p[t]), key=lambda a: a[0].translate(INITIALS))
        out.append(edit)
    return "".join(out)


def solve(codes: str) -> tuple[int, str]:
    """Cost and edits of a conversation; nothing to do for one without rows."""
    price = auction(codes)
    return int(price[START]), trace(codes, price)


#: Most conversations are short and look alike.
_solve_short = lru_cache(maxsize=1 << 15)(solve)


def lines(edits: str, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired turns as ``role:text``."""
    out, rows = [], zip(roles, texts)
    for e in edits:
        if e in "ua":
            out.append(_ROLES[e] + ":")
            continue
        role, text = next(rows)
        if e != "D":
            out.append(f"{_ROLES.get(e, role)}:{text}")
    return out


# --- rows to conversations ------------------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of ``conv_id:turn``; a dropped row stays without role and text, to name its conversation."""
    blank = F.lit(" ")
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn", "role", "text"))
    k = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    kept = F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.when(k != 0, F.when(k == 4, "user").otherwise(role)).alias("role"),
        F.when(k != 0, kept).alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(k == 3, 2).otherwise(1))).alias("copy")).drop("copy")
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    return rows.select(
        "conv_id", "turn", "role", "text", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("digest"),
        F.when(end == "", "b").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise("k").alias("mark"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"))


_RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_PART = "part int, seq int, marks string, initials string, roles array<string>, texts array<string>, at array<int>, digests array<string>, first_turn bigint, last_turn bigint, n_turns bigint"


def _arrow(spec: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (f.strip().split(" ") for f in spec.split(","))])


def _codes(marks: str, initials: str) -> str:
    return "".join("!" if m in "bd" else i.upper() if m == "t" else i for m, i in zip(marks, initials))


def _illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


class _Part:
    """Rows of one conversation that a task holds; a row seen earlier in the part is a duplicate."""

    def __init__(self):
        self.marks, self.initials, self.roles, self.texts, self.turns, self.seen, self.bytes = [], [], [], [], [], {}, 0

    def add(self, turn, role, text, digest, mark, initial) -> None:
        if role is None:
            return
        if mark != "b":
            if digest in self.seen:
                mark = "d"
            else:
                self.seen[digest] = len(self.marks)
        for held, value in zip((self.marks, self.initials, self.roles, self.texts), (mark, initial, role, text)):
            held.append(value)
        self.bytes += len(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def full(self) -> bool:
        return len(self.marks) >= PART_ROWS or self.bytes >= PART_BYTES

    def solved(self, conv) -> tuple:
        marks, initials, t = "".join(self.marks), "".join(self.initials), self.turns
        codes = _codes(marks, initials)
        cost, edits = (_solve_short if len(codes) <= 64 else solve)(codes)
        repaired = hashlib.sha256("\n".join(lines(edits, self.roles, self.texts)).encode()).hexdigest()
        return (conv, t[-1] - t[0] + 1 - len(t) if t else 0, *(marks.count(m) for m in "bdt"), _illegal(initials), cost, edits.translate(INITIALS), repaired, *[None] * 11)

    def row(self, conv, part: int, seq: int) -> tuple:
        t = self.turns
        return (conv, *[None] * 8, part, seq, "".join(self.marks), "".join(self.initials), self.roles, self.texts, list(self.seen.values()), list(self.seen),
                t[0] if t else None, t[-1] if t else None, len(t))


def _sorted_parts(rows: DataFrame) -> DataFrame:
    """All rows sorted by range: conversations that lie inside one task are solved there, others come as parts."""
    order = ["conv_id", "turn", "role", "digest"]
    schema = _arrow(f"{_RESULT}, {_PART}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, held = TaskContext.get().partitionId(), [], 0
        now, part, seq, opening = (), _Part(), 0, True

        def close(last: bool) -> None:
            nonlocal part, seq, opening, held
            if now:
                inside = not (opening or last or seq)
                out.append(part.solved(*now) if inside else part.row(*now, task, seq))
                held += 0 if inside else part.bytes
                opening = False
            part, seq = _Part(), 0

        def batch() -> pa.RecordBatch:
            nonlocal held
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, zip(*out))], schema=schema)
            out.clear()
            held = 0
            return done

        for b in batches:
            for conv, *row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "digest", "mark", "initial"))):
                if (conv,) != now:
                    close(False)
                    now = (conv,)
                elif part.full():
                    out.append(part.row(conv, task, seq))
                    held += part.bytes
                    part, seq = _Part(), seq + 1
                part.add(*row)
                if len(out) >= 4096 or held >= PART_BYTES:
                    yield batch()
        close(True)
        if out:
            yield batch()

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, f"{_RESULT}, {_PART}")


# --- conversations that lie in several parts --------------------------------------------------------------------------

_PLACE = ["key", "part", "seq"]


def _solve_parts(slim: DataFrame) -> DataFrame:
    """Marks, initials and later duplicates of the parts, gathered per conversation: a few bytes a row, as its audit needs, too.

    One row per part with its edits, and one per conversation (part null) with its counts, cost and audit.
    """
    spec = "key string, part int, seq int, edits string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    schema = _arrow(spec)

    def finish(key: str, held: list[tuple]) -> pa.RecordBatch:
        marks, initials = "".join(m for *_, m, _ in held), "".join(i for *_, i in held)
        cost, edits = solve(_codes(marks, initials))
        out, at = [], 0
        for k, (part, seq, own, _) in enumerate(held):
            to, left = at, len(own)
            while to < len(edits) and (left or k == len(held) - 1):  # insertions go with the row behind them, the last with the last part
                left -= edits[to] not in "ua"
                to += 1
            out.append((key, part, seq, edits[at:to], *[None] * 6))
            at = to
        out.append((key, None, None, None, *(marks.count(m) for m in "bdt"), _illegal(initials), cost, edits.translate(INITIALS)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, zip(*out))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for key, part, seq, marks, initials, later in zip(*(b.column(c).to_pylist() for c in (*_PLACE, "marks", "initials", "later"))):
                if key != now and held:
                    yield finish(now, held)
                    held = []
                now = key
                if later:
                    seen = np.array(list(marks))
                    seen[later] = "d"
                    marks = "".join(seen)
                held.append((part, seq, marks, initials))
        if held:
            yield finish(now, held)

    return slim.repartition("key").sortWithinPartitions(*_PLACE).mapInArrow(run, spec)


def _repaired_pieces(rows: DataFrame) -> DataFrame:
    spec = "key string, part int, seq int, piece string"
    schema = _arrow(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                key, part, seq, edits, roles, texts = (b.column(c)[row].as_py() for c in (*_PLACE, "edits", "roles", "texts"))
                found = lines(edits, roles, texts)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for f, v in zip(schema, (key, part, seq, "\n".join(found)))], schema=schema)

    return rows.select(*_PLACE, "edits", "roles", "texts").mapInArrow(run, spec)


def _long(parts: DataFrame) -> DataFrame:
    parts = parts.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    place = F.struct("part", "seq", "i")
    rows = parts.select(*_PLACE, F.explode(F.arrays_zip(F.col("at").alias("i"), F.col("digests").alias("digest"))).alias("z")).select(*_PLACE, "z.i", "z.digest")
    first = rows.groupBy("key", "digest").agg(F.min(place).alias("first"))  # a digest comes once a part
    later = rows.join(first, ["key", "digest"]).where(place > F.col("first")).groupBy(*_PLACE).agg(F.collect_list("i").alias("later"))
    solved = common.stored(_solve_parts(parts.select(*_PLACE, "marks", "initials").join(later, _PLACE, "left")), "repairs")
    texts = parts.select(*_PLACE, "roles", "texts").join(solved.where(F.col("part").isNotNull()).select(*_PLACE, "edits"), _PLACE)
    hashes = hash_pieces(_repaired_pieces(texts), ["key"], ["part", "seq"], "piece", "\n")
    before = Window.partitionBy("key").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    turns = parts.select("key", "conv_id", "first_turn", "last_turn", "n_turns", F.last("last_turn", ignorenulls=True).over(before).alias("before"))
    again = F.sum(F.when(F.col("first_turn") == F.col("before"), 1).otherwise(0))
    gaps = turns.groupBy("key").agg(F.max("conv_id").alias("conv_id"), F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("n_turns") + again, F.lit(0)).alias("gaps"))
    out = solved.where(F.col("part").isNull()).join(gaps, "key").join(hashes, "key", "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair(conversations: DataFrame) -> DataFrame:
    """Damage every conversation, then its faults, the cheapest repair and a digest of the repaired turns, one row a conversation.

    A null anywhere is one space, also in the name that decides the damage; rows without conv_id are one conversation, with
    a null id.  Rows of one turn follow role and md5 of role and text; repeated rows stay and count as duplicates.  A role
    without a letter s, u or a in front fits nowhere unless renamed; the empty role has no initial.  Very long texts are held
    one part of a conversation at a time.  An empty table gives an empty one.  Only conv_id, turn, role and text are read, so no
    other column's name can clash.
    """
    found = common.stored(_sorted_parts(damaged(conversations)), "repair")
    whole = found.where(F.col("part").isNull()).select(*(f.split()[0] for f in _RESULT.split(", ")))
    return whole.unionByName(_long(found.where(F.col("part").isNotNull())))
