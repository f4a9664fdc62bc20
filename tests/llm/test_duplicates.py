"""SimHash, radix sort, positional index and pruned graph against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tallyloom.llm import op05_positional_index as index, op06_pruned_graph as graph, op07_radix_dedup as radix, op09_simhash_trie as simhash
from tallyloom.llm.components import components

WORDS = ["ton", "Reh", "lo", "ant", "é", "wem", "sa", "ZU", "ki", "or"]


def some_texts(seed, n, words=80):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, words))) for _ in range(n // 4)]
    out = []
    for k in range(n):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        out.append((k, rng.choice([" ", "  ", "\n"]).join(t)))
    return out + [(n, None), (n + 1, ""), (n + 2, "\t \n"), (n + 3, out[0][1]), (n + 4, "lone")]


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


# --- components ---------------------------------------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(701, 760)] + [(900, 900)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.root(x) for e in edges for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- simhash ------------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("split", [2, 2048])
def test_simhash(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    rows = some_texts(3, 160)
    prints = {k: plain_fingerprint(t) for k, t in rows}
    sets = Sets()
    for a in prints:
        sets.root(a)
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                sets.join(a, b)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, fp string, node int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{v:016x}", sets.root(k)) for k, v in prints.items()}


def test_trie_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flips = [b ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for b in base]
    v = np.unique(np.concatenate([base, *flips]))
    got = {(int(a), int(b)) for i, j in simhash.trie_pairs(v, np.array([0, len(v)])) for a, b in zip(i, j)}
    assert got == {(i, int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i] ^ v) <= 3) if i < j}


def test_simhash_edges(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b"), (7, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got == [("5", 5), ("5", 5), ("7", 7), ("None", 5)]


# --- radix sort ---------------------------------------------------------------------------------------------------

def plain_removal(rows, width):
    seen, out = set(), {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if raw[i:i + width] in seen:
                gone[i:i + width] = True
            seen.add(raw[i:i + width])
        turns = np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)
        out[k] = (len(raw), int(gone.sum()), turns, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("width", [100, 40, 12])
@pytest.mark.parametrize("hot", [1, 1024])
def test_radix_removal(spark, monkeypatch, width, hot):
    monkeypatch.setattr(radix, "BATCH_BYTES", 3000)
    monkeypatch.setattr(radix, "STEP_WINDOWS", 50 if hot == 1 else 1 << 20)
    rows = some_texts(4, 120) + [(900, "z" * 900), (901, "ab" * 300)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(k, t, "x", 3) for k, t in rows], "doc_id long, text string, kept string, batch int").repartition(6)
    got = radix.digests(radix.remove_repeats(docs, width=width, hot=hot))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == plain_removal(rows, width)


def test_radix_edges(spark):
    assert radix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(2, "é" * 60), (2, "é" * 60), (None, "é" * 60), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), len(r.kept)) for r in radix.remove_repeats(odd, as_text=True).collect())
    assert got[2:] == [("3", 0), ("None", 0)]
    assert sorted(n for _, n in got) == [0, 0, 0, 60] or sorted(n for _, n in got)[:3] == [0, 0, 0]


def test_radix_texts_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(radix, "BATCH_BYTES", 3000)
    rows = some_texts(8, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    done = radix.remove_repeats(docs, width=40)
    plan = done._jdf.queryExecution().executedPlan().toString()
    texts = [line for line in plan.splitlines() if "blob" in line and "FileScan" in line]
    assert texts and all("Bucketed: true" in line for line in texts)
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(batch" in line and "blob" in line] and "SortMergeJoin" not in plan
    assert {r.doc_id: r.n_removed for r in radix.digests(done).collect()} == {k: v[1] for k, v in plain_removal(rows, 40).items()}


def test_radix_batch_numbers(spark):
    ids = np.array([0, 1, -1, 1 << 33, (5 << 33) + 77, 2 ** 62, -2 ** 40])
    want = [r.h for r in spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "i int, x long").selectExpr("i", "pmod(hash(x), 24) AS h").orderBy("i").collect()]
    assert radix.home(ids, 24).tolist() == want
    for part, buckets in ((0, 1), (3, 24), (700, 211)):
        found = np.array([n for n, _ in zip(radix.numbers(part, buckets), range(3 * radix.BUCKET_BATCHES))])
        assert (np.diff(found) > 0).all() and found[0] >= part << 33 and found[-1] < part + 1 << 33
        assert radix.home(found, buckets).tolist() == np.repeat([(part + k) % buckets for k in range(3)], radix.BUCKET_BATCHES).tolist()


# --- positional index ---------------------------------------------------------------------------------------------

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(docs, items):
    out = {}
    for k, t in docs:
        ws, hit, ids = plain_words(t), set(), set()
        for item, it in items:
            iw = plain_words(it)
            n = min(13, len(iw))
            for s in range(len(iw) - n + 1 if n else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p:p + n] == iw[s:s + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(item))
        out[k] = (len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws))
    return out


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(index, "SHARD_BYTES", 2000)
    monkeypatch.setattr(index, "BLOCK_BYTES", block)
    docs = some_texts(6, 60)
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice(docs)[1].split()[:rng.choice([3, 13, 30])]) if rng.random() < 0.8 else "never seen words") for k in rng.sample(range(50), 8) if (docs[k][1])] + [(99, None), (98, ""), (97, "...")]
    docs = [(k, t if t is None else t.replace("ki", "KI-")) for k, t in docs] + [(500, " ".join(["or"] * 40 + ["ton"]))]
    items = [(k, t) for k, t in items if t is None or t == "" or len(t) < 3 or True] + [(96, "or or or")]
    got = index.contamination(spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, items int"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()} == plain_contamination(docs, items)


def test_phrases_and_proximity(spark, tmp_path):
    docs = [(1, "the red fox saw a red hen"), (2, "red hen, red fox"), (3, None), (4, "fox")]
    folder = str(tmp_path / "index")
    index.build(spark.createDataFrame(docs, "doc_id long, text string"), folder)
    assert sorted((r.key, r.at) for r in index.matches(folder, spark, ["Red Fox"]).collect()) == [(1, 1), (2, 2)]
    assert sorted(r.key for r in index.matches(folder, spark, ["fox hen"], span=2).collect()) == [2]
    assert sorted({r.key for r in index.matches(folder, spark, ["fox hen"], span=4).collect()}) == [1, 2]


def test_contamination_edges(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    assert index.contamination(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a")], items)).count() == 0
    got = index.contamination(spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a")], docs), spark.createDataFrame([], items)).collect()
    assert [(r.n_hit, r.contaminated) for r in got] == [(0, False)] * 3


# --- pruned graph -------------------------------------------------------------------------------------------------

def vectors(seed, n, dim=16, labels=3):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        centre, label = rng.normal(size=dim), int(rng.integers(labels))
        for _ in range(int(rng.choice([1, 1, 2, 3, 25]))):
            out.append((centre + rng.normal(size=dim) * rng.choice([0, 0.02, 0.05, 0.2]), label))
    return [(k, [float(x) for x in v], label) for k, (v, label) in enumerate(out[:n])]


def plain_links(rows, threshold=0.98):
    links, sets = {r[0]: set() for r in rows}, Sets()
    good = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    for a in good:
        for b in good:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links[a[0]].add(b[0])
                    sets.join(a[0], b[0])
    return {k: (len(v), sets.root(k)) for k, v in links.items()}


ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [1.0, None] * 8, 1), (9004, [float("nan")] * 16, 1), (9005, [float("inf")] + [1.0] * 15, 1), (9006, [1.0] * 16, None), (9007, [], 1), (9008, [1.0, 2.0], 1), (9009, [2.0, 4.0], 1)]


@pytest.mark.parametrize("shard", [1536, 60])
def test_graph_finds_links(spark, monkeypatch, shard):
    monkeypatch.setattr(graph, "SHARD", shard)
    rows = vectors(1, 260) + ODD
    want = plain_links(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in graph.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, node int")).collect()}
    assert set(got) == set(want)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found <= there and found >= 0.95 * there
    if shard > 1000:
        assert got == want


def crowd(seed, near=1500, pairs=150, dim=64):
    """One large group of near copies, which most centroids are drawn from, and pairs at the edge of the threshold."""
    rng = np.random.default_rng(seed)
    own = lambda v: v / np.sqrt(v @ v)
    centre, out = own(rng.normal(size=dim)), []
    for _ in range(near):
        out.append(centre + rng.normal(size=dim) * 0.004)
    for _ in range(pairs):
        a, b = own(rng.normal(size=dim)), own(rng.normal(size=dim))
        b = own(b - (a @ b) * a)
        out += [a, 0.981 * a + np.sqrt(1 - 0.981 ** 2) * b]
    return [(k, [float(x) for x in v], 1) for k, v in enumerate(out)]


def numpy_links(rows, threshold=0.98):
    x, sets = graph.unit(np.array([v for _, v, _ in rows])), Sets()
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    for a, b in zip(*np.nonzero(near)):
        if a < b:
            sets.join(int(a), int(b))
    return {k: (int(near[k].sum()), sets.root(k)) for k in range(len(rows))}


@pytest.mark.parametrize("case", ["crowd", "clusters", "mixed"])
def test_no_link_is_lost_between_shards(spark, monkeypatch, case):
    if case == "crowd":  # two blocks of it are more than a shard
        monkeypatch.setattr(graph, "PAIR", 1200, raising=False)
        rows = crowd(2)
    else:
        monkeypatch.setattr(graph, "SHARD", 100)
        monkeypatch.setattr(graph, "PAIR", 300, raising=False)
    if case == "clusters":  # splits pay here
        rng = np.random.default_rng(4)
        centres = rng.normal(size=(12, 64))
        rows = [(k, [float(x) for x in centres[k % 12] + rng.normal(size=64) * 0.12], 1) for k in range(900)]
    elif case == "mixed":
        rows = [(k, v, 1) for k, v, _ in vectors(7, 600)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == numpy_links(rows)


@pytest.mark.parametrize("dim", [2, 16, 64])
def test_linked_vectors_share_a_cell(dim):
    rng = np.random.default_rng(dim)
    x = graph.unit(rng.normal(size=(2000, dim)))
    side = rng.normal(size=x.shape)
    side = graph.unit(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * side
    centre = graph.apart(graph.unit(rng.normal(size=(32, dim))))
    assert (graph.near_cells(x, centre, 0.98 - 1e-12) & graph.near_cells(y, centre, 0.98 - 1e-12)).any(1).all()


def test_search_recall():
    x = graph.unit(np.array([v for _, v, _ in vectors(5, 700)]))
    q, v = graph.search(x, graph.build(x, 1), 0.98)
    eq, ev = graph.exact(x, 0.98, np.arange(len(x)))
    found, there = set(zip(q.tolist(), v.tolist())), set(zip(eq.tolist(), ev.tolist()))
    assert found <= there and len(found) >= 0.95 * len(there)


def test_graph_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert graph.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    same = [(3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in graph.near_duplicates(spark.createDataFrame(same, schema)).collect())
    assert got == [("1", 0, 1, True), ("3", 2, 3, True), ("3", 2, 3, True), ("None", 2, 3, False)]
