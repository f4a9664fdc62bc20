"""Prefix trie and structure repair against plain Python over whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import op12_prefix_trie as op12, op13_structure_repair as op13, ordered_hash

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- joined hashes --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("size", [1, 30, 1 << 20])
def test_joined_sha256(spark, size):
    rows = [(k % 7 if k % 3 else 3, k) for k in range(500)] + [(None, 5)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(5).withColumn("t", F.col("v").cast("string"))
    got = {r.k: r.sha256 for r in ordered_hash.joined_sha256(df, ["k"], ["v"], "t", ",", size).collect()}
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    assert got == {k: sha(",".join(map(str, sorted(v)))) for k, v in want.items()}


# --- prefix trie ----------------------------------------------------------------------------------------------------

def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", md5(x or ""), x or ""))
    own = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        ends[tuple(s)].append(c)
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
    return {(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(map(str, sorted(ends.get(k, []))))))
            for k, m in members.items()}


def check_trie(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("depth", F.lit(1)).withColumn("conv", F.lit("x"))
    got = [tuple(r) for r in op12.digests(op12.trie(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def chat(rng, n, words=3):
    return [(rng.choice(["user", "assistant"]), rng.choice(["a", "b é", ""][:words])) for _ in range(n)]


@pytest.mark.parametrize("block", [1024, 2])
def test_trie_equals_plain(spark, monkeypatch, block):
    monkeypatch.setattr(op12, "BLOCK", block)
    rng, rows = random.Random(block), []
    for c in rng.sample(range(200), 90):
        rows += [(c, t, *x) for t, x in enumerate(chat(rng, rng.choice([1, 2, 3, 8, 12]), 2))]
    same = [(t, *x) for t, x in enumerate(chat(rng, 10))]  # a large group of copies, and prefixes of them
    for c in range(300, 400, 5):
        for k in range(5):
            rows += [(c + k, *x) for x in same[:10 if k else rng.choice([9, 10])]]
    check_trie(spark, rows)


def test_trie_edges(spark):
    rows = [(5, None, "user", "null turn first"), (5, 0, None, None), (5, 0, "user", "x"), (5, 0, "user", "x"), (6, 1, "", ""), (None, 1, "user", "no one's"),
            (7, 3, "user", "long " * 400_000), (8, 2, "user", "ß"), (13, 1, "user", "its base is absent"), (25, None, None, None), (26, None, None, None)]
    check_trie(spark, rows, 3)
    assert op12.digests(op12.trie(spark.createDataFrame([], SCHEMA))).collect() == []


def test_trie_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(op12, "BLOCK", 16)
    rng = random.Random(4)
    rows = [(1, t, "user", str(rng.randrange(3))) for t in range(300)] + [(0, t, "user", "0") for t in range(3)]
    check_trie(spark, rows)


# --- structure repair -----------------------------------------------------------------------------------------------

def plain_repair(codes, roles=None, texts=None):
    """Least (cost, audit, lines) by dynamic programming from the end; codes as in the operator."""
    inf = (10 ** 9, "", ())

    def step(cost, edit, line, rest):
        return (rest[0] + cost, edit + rest[1], (*line, *rest[2]))

    def inserted(v):
        u, a = (("user:",), ("assistant:",))
        second = min(v[2], step(2, "I", a, v[3]))
        return [min(v[0], step(2, "I", u, second)), min(v[1], step(2, "I", u, second)), second, min(v[3], step(2, "I", u, second))]

    now = inserted([(0, "", ()), inf, inf, (0, "", ())])
    for k in range(len(codes) - 1, -1, -1):
        c, role, text = codes[k], roles[k] if roles else "", texts[k] if texts else ""
        out = []
        for q in range(4):
            ways = [step(3, "D", (), now[q])]
            if c != "!":
                extra, to = int(c.isupper()), 3 if q == 2 else 2
                if c.lower() == "s" and q == 0:
                    ways.append(step(extra, "K", (f"{role}:{text}",), now[1]))
                if c.lower() == ("a" if q == 2 else "u"):
                    ways.append(step(extra, "K", (f"{role}:{text}",), now[to]))
                ways.append(step(2 + extra, "R", (f"{'assistant' if q == 2 else 'user'}:{text}",), now[to]))
            out.append(min(ways))
        now = inserted(out)
    return now[0]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="!suaxSUAX", max_size=24), st.sampled_from([1, 2, 5, 16]))
def test_auction_equals_dynamic_programming(codes, segment):
    price = op13.auction(codes, segment)
    cost, audit, repaired = plain_repair(codes)
    edits = op13.trace(codes, price)
    assert (int(price[0]), edits.translate(op13.INITIALS)) == (cost, audit)
    assert tuple(op13.lines(edits, [""] * len(codes), [""] * len(codes))) == repaired


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="!suaxSUAX", max_size=40))
def test_prices_are_a_dual_solution(codes):
    price = op13.auction(codes, 4).tolist()
    for node in range(4 * len(codes) + 4):
        assert all(price[node] <= c + price[t] for _, c, t in op13._arcs(codes, node))
    assert price[-1] == 0


def test_a_long_lattice_takes_linear_work():
    codes = "".join(random.Random(2).choices("!suaxSUA", k=20_000))
    cost, edits = op13.solve(codes)
    short = sum(op13.solve(codes[k:k + 100])[0] for k in range(0, 20_000, 100))
    assert 0 < cost <= short and len(edits) >= len(codes)


def test_known_repairs():
    assert op13.solve("")[1] == "" and op13.solve("sua") == (0, "KKK") and op13.solve("sU") == (3, "DD"[:0] + "KKa")
    assert op13.solve("u") == (2, "Ka") and op13.solve("!") == (3, "D") and op13.solve("s") == (3, "D") and op13.solve("a") == (2, "uK")


def plain_result(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        null = [" " if v is None else str(v) for v in (c, t, r, x)]
        k = zlib.crc32(f"{null[0]}:{null[1]}".encode()) % 20
        role, text = null[2], null[3]
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        convs[c] += [] if k == 0 else [(t is not None, t or 0, role, md5(f"{len(role.encode())}:{role}{text}"), text, t)] * (2 if k == 3 else 1)
    out = set()
    for c, found in convs.items():
        found.sort(key=lambda r: r[:4])
        seen, codes, counts = set(), "", [0, 0, 0]
        for _, _, role, _, text, _ in found:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            initial = role[:1] if role[:1] in tuple("sua") else "x"
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            codes += "!" if fault in (0, 1) else initial.upper() if fault == 2 else initial
        turns = {r[5] for r in found} - {None}
        cost, audit, repaired = plain_repair(codes, [r[2] for r in found], [r[4] for r in found])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        out.add((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, sha("\n".join(repaired))))
    return out


def check_repair(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("cost", F.lit(1)).withColumn("key", F.lit("x"))
    got = [tuple(r) for r in op13.repair(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_result(rows)


def talk(rng, c, n):
    texts = ["Fine.", "Really?", "no end", "  ", "Yes!\n", "", "ends. \t", "x" * 50, "a.b"]
    return [(c, t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool"]), rng.choice(texts)) for t in range(n) if rng.random() < 0.95]


@pytest.mark.parametrize("part_rows", [4096, 3])
def test_repair_equals_plain(spark, monkeypatch, part_rows):
    monkeypatch.setattr(op13, "PART_ROWS", part_rows)
    rng, rows = random.Random(part_rows), []
    for c in range(120):
        rows += talk(rng, c, rng.choice([0, 1, 2, 5, 9, 30]))
    check_repair(spark, rows)


def test_repair_of_a_conversation_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(op13, "PART_ROWS", 50)
    rng = random.Random(9)
    check_repair(spark, talk(rng, 7, 2_000) + [(7, 10, "user", "again.")] * 70 + talk(rng, 8, 5) + talk(rng, None, 200))


def test_repair_edges(spark, monkeypatch):
    monkeypatch.setattr(op13, "PART_BYTES", 1 << 16)
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (1, 3, "", "Empty role."), (2, 1, "user", None), (None, None, None, None), (None, 4, "assistant", "Who?"),
            (3, 1, "user", "long " * 200_000), (3, 2, "assistant", "long " * 200_000 + "."), (4, 5, "User", "Capital."), (4, 5, "User", "Capital."), (4, -5, "ß", "漢。"),
            *[(9, t, "user", "Gone?") for t in range(3)]]
    dropped = next(c for c in range(10 ** 6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check_repair(spark, [*rows, (dropped, 0, "user", "All rows go.")], 3)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", sha("")) in plain_result([(dropped, 0, "user", "x")])
    assert op13.repair(spark.createDataFrame([], SCHEMA)).collect() == []
