"""Token counts by a compiled tokenizer: a deterministic transducer whose transitions carry the tokens they emit.

The machine reads one byte at a time, each lead byte marked with the class of its character.  It is the composition of two:

* the splitter walks the pretokenizer pattern.  Its state is a mode: at a cut, inside a run of letters, digits or other
  signs, after an apostrophe that may open a contraction, or in white space, whose last character is held back because it
  belongs to what follows it;
* the counter walks the merges inside one match.  Its state lists the places before the read position at which a token may
  still begin: the trie node of what was read since, the token that ends there, and how many tokens the match has up to
  there against all that was read.  The tokens of a prefix end in the one token whose left neighbour keeps apart from it,
  so reading a byte is a deterministic step, and its annotation is the change in the number of tokens of what was read
  (below zero where one token swallows several).

States are numbered as they are met, and a transition is worked out once; the table is emptied when it is full, which costs
time and changes no count.  A text is cut into chunks that are read side by side, one lane each.  A chunk's state map sends an
entry state to its exit state and its count.  After a lone space only one state is possible, so the pieces between lone spaces
have a map with one entry, which is kept for the next time the piece comes.  A piece longer than a chunk goes on in chunks whose
maps start with a guessed entry and are closed under the exits of the chunk before; a parallel prefix scan composes them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Transitions and pieces kept per process; symbols of the longest chunk; symbols a guess looks back; bytes of text read at once.
TRANSITIONS, PIECES, LONGEST, LOOK, STEP_BYTES = 1 << 20, 500_000, 512, 64, 2 << 20

# Classes of characters, and the symbols that end a text or stand for a special string.
SPACE, LETTER, DIGIT, OTHER = range(4)
SYMBOLS, END, SPECIAL = 2048, 2046, 2047
# Modes of the splitter; in APOSTROPHE_x the letter x is held back.
CUT, RUN_LETTER, RUN_DIGIT, RUN_OTHER, BLANK, APOSTROPHE, APOSTROPHE_R, APOSTROPHE_V, APOSTROPHE_L = range(9)
_RUN = {LETTER: RUN_LETTER, DIGIT: RUN_DIGIT, OTHER: RUN_OTHER}
_HELD = {APOSTROPHE_R: ord("r"), APOSTROPHE_V: ord("v"), APOSTROPHE_L: ord("l")}
_ENDS = {APOSTROPHE_R: ord("e"), APOSTROPHE_V: ord("e"), APOSTROPHE_L: ord("l")}  # 're 've 'll
_ONE = frozenset(b"stmd")  # 's 't 'm 'd
_OPENS = {ord("r"): APOSTROPHE_R, ord("v"): APOSTROPHE_V, ord("l"): APOSTROPHE_L}


# --- compilation --------------------------------------------------------------------------------------------------

def _printable_bytes() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, as the pattern's \\s, \\p{L} and \\p{N} see it."""
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        found = "".join(regex.findall(pattern, text))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


class Merges:
    """The counter: a trie of tokens and the test whether two neighbouring tokens keep apart."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[int, int, int]]):
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for word, k in vocab.items():
            node = 0
            for b in word:
                at = node << 8 | b
                node, before = self.child.get(at, len(self.token)), node
                if node == len(self.token):
                    self.child[at] = node
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[before] = True
            self.token[node] = k
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.parts = {c: (a, b, r) for r, (a, b, c) in enumerate(merges)}
        self._apart: dict[tuple[int, int], bool] = {}
        self._spines: dict[tuple[int, int], list] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one end of a token while it is merged, each with the rank of the merge that ends it."""
        out = self._spines.get((token, side))
        if out is None:
            part = self.parts.get(token)
            inner = [] if part is None else self._spine(part[side], side)
            out = self._spines[token, side] = [(token, float("inf")), *((t, min(until, part[2])) for t, until in inner)]
        return out

    def apart(self, x: int, y: int) -> bool:
        """Whether no merge joins x and y: merges go by rank, equal ones from the left."""
        found = self._apart.get((x, y))
        if found is None:
            found = True
            left = self._spine(y, 0)
            for a, until_a in self._spine(x, 1):
                for b, until_b in left:
                    r = self.rank.get((a, b))
                    if r is not None and r < until_a and r <= until_b:
                        found = False
            if len(self._apart) >= 1 << 20:
                self._apart.clear()
            self._apart[x, y] = found
        return found

    def push(self, places: tuple, b: int) -> tuple[tuple, int]:
        """Read a byte inside a match: the places at which a token may still begin, and the change in the number of tokens."""
        live, last, gain = [], None, 0
        for node, before, tokens in places:
            node = self.child.get(node << 8 | b)
            if node is None:
                continue
            t = self.token[node]
            if last is None and t >= 0 and (before < 0 or self.apart(before, t)):
                last, gain = t, tokens + 1
            if self.inner[node]:
                live.append((node, before, tokens))
        return (*[(n, p, c - gain) for n, p, c in live], (0, last, 0)), gain


#: Places at the begin of a match.
_FRESH = ((0, -1, 0),)


class Transducer:
    """Splitter and counter composed, with numbered states and a hash table of the transitions met so far."""

    def __init__(self, path: str, limit: int = TRANSITIONS):
        spec = json.load(open(path, encoding="utf-8"))
        byte, model = _printable_bytes(), spec["model"]
        vocab = {w: k for w, k in model["vocab"].items() if all(c in byte for c in w)}
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges({bytes(byte[c] for c in w): k for w, k in vocab.items()}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.limit = limit
        self.empty()

    def empty(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        size = 1 << 16
        self.keys, self.to, self.gain, self.used = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16), 0
        self.cut, self.lone = self.number((CUT, b"", _FRESH)), self.number((BLANK, b" ", _FRESH))

    def number(self, state: tuple) -> int:
        k = self.numbers.get(state)
        if k is None:
            k = self.numbers[state] = len(self.states)
            self.states.append(state)
        return k

    # -- one step of the composed machine

    def _read(self, mode: int, places: tuple, data: bytes) -> tuple[tuple, int]:
        total = 0
        for b in data:
            places, gain = self.merges.push(places, b)
            total += gain
        return (mode, b"", places), total

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The next state, and the tokens the transition emits."""
        mode, held, places = state
        if symbol >= END:
            gain = self._read(mode, places, held)[1] if mode == BLANK else 0
            if mode in _HELD:  # the apostrophe is a match, so is the letter
                gain += self._read(mode, _FRESH, bytes([_HELD[mode]]))[1]
            return (CUT, b"", _FRESH), gain + (symbol == SPECIAL)
        kind, b = divmod(symbol, 256)
        if kind == 4:  # inside a character
            return ((BLANK, held + bytes([b]), places), 0) if mode == BLANK else self._read(mode, places, bytes([b]))
        if mode in _HELD:
            if kind == LETTER and b == _ENDS[mode]:
                return (CUT, b"", _FRESH), self._read(mode, places, bytes([_HELD[mode], b]))[1]
            run, gain = self._read(RUN_LETTER, _FRESH, bytes([_HELD[mode]]))
            after, more = self.step(run, symbol)
            return after, gain + more
        if kind == SPACE:
            if mode == BLANK:  # the character held back is inside the run
                (_, _, places), gain = self._read(mode, places, held)
                return (BLANK, bytes([b]), places), gain
            return (BLANK, bytes([b]), _FRESH), 0
        if mode == BLANK:
            # what was held back opens the match if it is a space, else it is one; the run before it is a match already
            if held == b" ":
                (_, _, places), gain = self._read(mode, _FRESH, held)
                after, more = self._read(_RUN[kind], places, bytes([b]))
            else:
                gain = self._read(mode, _FRESH, held)[1]
                after, more = self.step((CUT, b"", _FRESH), symbol)
            return after, gain + more
        if mode == APOSTROPHE and kind == LETTER:
            if b in _ONE:
                return (CUT, b"", _FRESH), self._read(mode, places, bytes([b]))[1]
            if b in _OPENS:
                return (_OPENS[b], b"", places), 0
        if _RUN[kind] == mode or (mode == APOSTROPHE and kind == OTHER):
            return self._read(_RUN[kind], places, bytes([b]))
        return self._read(APOSTROPHE if b == 0x27 else _RUN[kind], _FRESH, bytes([b]))

    # -- transitions of many lanes

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(-7046029254386353131)) >> np.int64(20)) & np.int64(len(self.keys) - 1)

    def _put(self, keys: np.ndarray, to: np.ndarray, gain: np.ndarray) -> None:
        """Enter new keys, each once."""
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            old = np.flatnonzero(self.keys >= 0)
            keys, to, gain = (np.concatenate(x) for x in ((self.keys[old], keys), (self.to[old], to), (self.gain[old], gain)))
            size = 4 * len(self.keys)
            self.keys, self.to, self.gain = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)
        mask, at, todo = len(self.keys) - 1, self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            self.keys[at[todo[free]]] = keys[todo[free]]  # of several for one slot the last stays
            done = self.keys[at[todo]] == keys[todo]
            self.to[at[todo[done]]], self.gain[at[todo[done]]] = to[todo[done]], gain[todo[done]]
            todo = todo[~done]
            at[todo] = (at[todo] + 1) & mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, or of a free place."""
        at = self._slots(keys)
        met = self.keys[at]
        off = np.flatnonzero((met != keys) & (met >= 0))
        while len(off):
            at[off] = (at[off] + 1) & (len(self.keys) - 1)
            met = self.keys[at[off]]
            off = off[(met != keys[off]) & (met >= 0)]
        return at

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read every lane side by side: exit states and counts."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, state = starts[order], lengths[order], entries[order].astype(np.int64)
        total = np.zeros(len(starts), np.int64)
        busy = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
        for t, n in enumerate(busy.tolist()):
            keys = state[:n] * SYMBOLS + symbols[starts[:n] + t]
            at = self._find(keys)
            new = np.flatnonzero(self.keys[at] < 0)
            if len(new):
                ask = np.unique(keys[new])
                done = [self.step(self.states[k // SYMBOLS], k % SYMBOLS) for k in ask.tolist()]
                self._put(ask, np.array([self.number(s) for s, _ in done], np.int32), np.array([g for _, g in done], np.int16))
                at = self._find(keys)
            state[:n] = self.to[at]
            total[:n] += self.gain[at]
        exits, counts = np.empty_like(state), np.empty_like(total)
        exits[order], counts[order] = state, total
        return exits, counts


# --- texts to symbols, chunks and state maps -----------------------------------------------------------------------

def symbols_of(pieces: list[str], special: list[str]) -> np.ndarray:
    """Symbols of whole pieces, each followed by END; a special string is one symbol, found before all else, from the left."""
    joined = "".join(pieces)
    if any(s in joined for s in special):
        cutter = regex.compile("|".join(map(regex.escape, special)))
        parts = [cutter.split(p) for p in pieces]
        joined = "".join(q for p in parts for q in p)
        sizes = [len(q) for p in parts for q in p]
        marks = [m for p in parts for m in (*[SPECIAL] * (len(p) - 1), END)]
    else:
        sizes, marks = list(map(len, pieces)), [END] * len(pieces)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    wide = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    raw = np.frombuffer(joined.encode(), np.uint8)
    lead = np.append(0, np.cumsum(wide))
    out = np.full(len(raw), 4 << 8, np.uint16)
    out[lead[:-1]] = classes()[codes].astype(np.uint16) << 8
    out |= raw
    return np.insert(out, lead[np.cumsum(sizes)], np.array(marks, np.uint16))


def chunk_starts(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks of at most ``longest`` symbols begin, and whether a piece of text begins there, so that the state is sure."""
    keep = np.append(0, np.flatnonzero(symbols == END)[:-1] + 1)
    ends = np.append(keep[1:], len(symbols))
    far = np.flatnonzero(ends - keep > longest)
    starts = np.concatenate([keep, *(np.arange(keep[k] + longest, ends[k], longest) for k in far.tolist())])
    order = np.argsort(starts, kind="stable")
    return starts[order], (np.arange(len(starts)) < len(keep))[order]


def compose(f: dict, g: dict) -> dict:
    """The state map of two neighbouring chunks."""
    return {s: (g[x][0], n + g[x][1]) for s, (x, n) in f.items() if x in g}


def prefix_scan(maps: list[dict]) -> list[dict]:
    """Maps of all prefixes, in a logarithmic number of rounds of independent compositions."""
    step = 1
    while step < len(maps):
        maps = [compose(maps[k - step], m) if k >= step else m for k, m in enumerate(maps)]
        step *= 2
    return maps


def state_maps(machine: Transducer, symbols: np.ndarray, starts: np.ndarray, sure: np.ndarray, opening: int) -> list[dict]:
    """Each chunk's map, on a domain that holds every state in which the chunk can be entered from a sure place."""
    lengths = np.diff(np.append(starts, len(symbols)))
    entries = np.full(len(starts), opening)
    blind = np.flatnonzero(~sure)
    if len(blind):
        back = np.minimum(LOOK, lengths[blind - 1])
        entries[blind] = machine.run(symbols, starts[blind] - back, back, np.full(len(blind), machine.cut))[0]
    maps = [{s: (x, n)} for s, x, n in zip(entries.tolist(), *(r.tolist() for r in machine.run(symbols, starts, lengths, entries)))]
    while len(blind):
        ask = [(k, x) for k in blind.tolist() for x in {x for x, _ in maps[k - 1].values()} if x not in maps[k]]
        if not ask:
            break
        at, entry = np.array([k for k, _ in ask]), np.array([x for _, x in ask])
        for (k, s), x, n in zip(ask, *(r.tolist() for r in machine.run(symbols, starts[at], lengths[at], entry))):
            maps[k][s] = (x, n)
    return maps


def piece_counts(machine: Transducer, pieces: list[str], opening: int, longest: int = LONGEST) -> list[int]:
    """Tokens of each piece, entered in the state ``opening`` and read to its end."""
    if not pieces:
        return []
    symbols = symbols_of(pieces, machine.special)
    starts, sure = chunk_starts(symbols, longest)
    maps = state_maps(machine, symbols, starts, sure, opening)
    heads = np.flatnonzero(sure).tolist()
    return [(maps[h] if e == h + 1 else prefix_scan(maps[h:e])[-1])[opening][1] for h, e in zip(heads, [*heads[1:], len(starts)])]


class Counter:
    """Counts of whole texts: pieces between lone spaces begin in one known state, so the map of a piece is kept as one number."""

    def __init__(self, machine: Transducer, limit: int = PIECES, longest: int = LONGEST):
        self.machine, self.limit, self.longest = machine, limit, longest
        self.inner: dict[str, int] = {}

    def __call__(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text; a null counts as empty."""
        machine = self.machine
        if machine.used > machine.limit:
            machine.empty()
        cut = [common.chunks(t or "") for t in texts]
        heads = piece_counts(machine, [c.pop(0) for c in cut], machine.cut, self.longest)
        used = set().union(*cut)
        if len(self.inner) + len(used) > self.limit:  # what these texts use stays
            self.inner = {w: self.inner[w] for w in used if w in self.inner}
        new = list(used.difference(self.inner))
        self.inner.update(zip(new, piece_counts(machine, new, machine.lone, self.longest)))
        known = self.inner.__getitem__
        return [h + sum(map(known, c)) for h, c in zip(heads, cut)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(Transducer(path))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Key, n_bytes, n_tokens and over_limit of every row, as the tokenizers library counts them.

    A null text counts as empty and has no tokens; null and repeated keys keep one row each; the special strings of the
    vocabulary count one token wherever they stand; texts of any length are read whole, a step at a time; an empty table gives an
    empty one.  Only the key and the text are read, so no other column's name can clash.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    kind = docs.select(key).dtypes[0][1]
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in common.steps(batches, "text", STEP_BYTES):
            texts = b.column("text")
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(count(texts.to_pylist()), pa.int64())], ["key", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
