"""Embedding near duplicates over a robust-pruned flat graph.

Equal vectors of a label are one node.  Nodes are dealt to overlapping cluster shards; a node goes to every shard whose
border is within the length of a link, so the two ends of a link always share a shard.  A cell that no such split makes
cheaper, because its vectors are alike or point everywhere, is cut into blocks, and every pair of blocks meets in exact
products.  Each small shard links every node to candidates by robust pruning, and a node's lists from all its shards are
united.  In each shard every node then searches greedily from the shard's medoid and from itself and widens from all nodes
in range until no new one is in range.  Every search is audited against all rows of the shard; a shard whose audit misses
a link takes the exact products.  A shard gives a spanning forest of its links, never all pairs.  Links join whole
components, so the last step verifies: blocks of a component's vectors meet, and exact products in double precision count
each node's links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common
from .components import components, unite

THRESHOLD = 0.98
#: Nodes of a shard at most; clusters that a larger shard is split into; splits; nodes of a pair of blocks at most.
SHARD, FAN, LEVELS, PAIR = 512, 32, 4, 4096
#: Nearest and random candidates, kept links, slack of pruning, beam.
NEAREST, RANDOM, DEGREE, ALPHA, BEAM = 24, 8, 12, 1.2, 8


def valid(vector: Column) -> Column:
    """No null, finite components only, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


# --- shards -------------------------------------------------------------------------------------------------------

def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow, no underflow of the squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def apart(centroids: np.ndarray, most: float = 0.9) -> np.ndarray:
    """Centroids in order without those close to an earlier one: a group of near copies keeps one cluster."""
    kept: list[int] = []
    for k in range(len(centroids)):
        if not kept or (centroids[kept] @ centroids[k]).max() < most:
            kept.append(k)
    return centroids[kept]


def near_cells(x: np.ndarray, centre: np.ndarray, threshold: float) -> np.ndarray:
    """Which centres each unit vector goes to: its nearest one and all whose border with that one a link can cross.

    If u and v link and c is nearest to u and d to v, then v.d - v.c <= (v - u).(d - c) <= |v - u| |d - c|: v goes to c too.
    """
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))
    sims = x @ centre.T
    home = sims.argmax(1)
    between = np.sqrt(np.maximum(0, 2 - 2 * (centre @ centre.T)))
    return sims.max(1, keepdims=True) - sims <= reach * between[home] + 1e-9


def _assign(cells: DataFrame, crowded: DataFrame, threshold: float) -> DataFrame:
    """Rows of crowded cells with the cells that a split sends them to; centroids are drawn from the cell by a hash of the node."""
    drawn = cells.join(crowded, "cell").where(F.pmod(F.xxhash64("cell", "node"), F.col("n")) < FAN)
    centroids = drawn.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("node", "vector"))).alias("centroids"))  # about FAN rows a cell
    met = cells.join(crowded.select("cell"), "cell", "left_semi").join(centroids, "cell", "left")

    def run(batches):
        for b in batches:
            names = [[] for _ in range(b.num_rows)]
            vectors, cents, cell = b.column("vector"), b.column("centroids"), b.column("cell").to_pylist()
            by_cell: dict[int, list[int]] = {}
            for k, c in enumerate(cell):
                by_cell.setdefault(c, []).append(k)
            for c, rows in by_cell.items():
                own = cents[rows[0]].as_py()
                if not own:
                    for k in rows:
                        names[k] = [c]
                    continue
                centre = apart(unit(np.array([x["vector"] for x in own], np.float64)))
                goes = near_cells(unit(_matrix(vectors.take(pa.array(rows)))), centre, threshold)
                for k, near in zip(rows, goes):
                    names[k] = [(c * 1000003 + x + 1) % (1 << 62) for x in np.flatnonzero(near).tolist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), vectors, b.column("cell"), pa.array(names, pa.list_(pa.int64()))], ["node", "vector", "cell", "to"])

    kind = cells.schema["vector"].dataType.simpleString()
    return met.select("node", "vector", "cell", "centroids").mapInArrow(run, f"node bigint, vector {kind}, cell bigint, to array<bigint>")


def shards(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, vector, cell, block, blocks): rows of tasks of bounded size; the two ends of a link share a task.

    A crowded cell is split if that at least halves its pairs, copies counted.  Else it is cut into blocks, and a task holds
    a pair of blocks.
    """
    cells, settled = nodes.select("node", "vector", F.pmod(F.xxhash64("label", F.size("vector")), F.lit(1 << 62)).alias("cell")), []
    for _ in range(LEVELS):
        sizes = common.stored(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD), "crowded-cells")
        if sizes.isEmpty():
            break
        moved = common.stored(_assign(cells, sizes, threshold), "split-cells")
        parts = moved.select("cell", F.explode("to").alias("part")).groupBy("cell", "part").agg(F.count(F.lit(1)).cast("double").alias("m"))
        work = parts.groupBy("cell").agg(F.sum(F.col("m") * F.col("m")).alias("work")).join(sizes, "cell")
        pays = common.stored(work.where(F.col("work") * 2 <= F.col("n").cast("double") * F.col("n")).select("cell"), "paying-cells")
        settled += [cells.join(sizes, "cell", "left_anti").select("node", "vector", "cell"), moved.join(pays, "cell", "left_anti").select("node", "vector", "cell")]
        cells = moved.join(pays, "cell", "left_semi").select("node", "vector", F.explode("to").alias("cell"))
    for more in settled:
        cells = cells.unionByName(more)
    return in_blocks(cells, "cell", PAIR)


def in_blocks(rows: DataFrame, group: str, most: int | None = None) -> DataFrame:
    """Add a row's block and the number of blocks of its group; two blocks together are ``most`` rows (a shard) at most."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    most = most or SHARD
    blocks = F.when(F.col("n") <= most, 1).otherwise(F.ceil(2 * F.col("n") / most)).cast("int")
    return rows.join(counts.select(group, blocks.alias("blocks")), group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def tasks(rows: DataFrame) -> DataFrame:
    """One copy of a row for each pair of blocks it takes part in; the single pair (0, 0) in an uncut group."""
    both = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


# --- graph --------------------------------------------------------------------------------------------------------

def prune(x: np.ndarray, rows: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Robust pruning for some rows at once: take the nearest candidate, drop those it covers, repeat; -1 fills up."""
    own = np.arange(len(rows))
    sim = np.einsum("nd,ncd->nc", x[rows], x[candidates])
    order = np.argsort(-sim, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), 1 - np.take_along_axis(sim, order, 1)
    alive = candidates != rows[:, None]
    out = np.full((len(rows), DEGREE), -1, np.int64)
    for k in range(DEGREE):
        first = alive.argmax(1)
        some = alive[own, first]
        if not some.any():
            break
        pick = candidates[own, first]
        out[some, k] = pick[some]
        covered = ALPHA * (1 - np.einsum("nd,ncd->nc", x[pick], x[candidates])) <= far
        alive &= ~(some[:, None] & (covered | (candidates == pick[:, None])))
    return out


def build(x: np.ndarray, seed: int) -> np.ndarray:
    """Pruned adjacency of a shard: candidates are the nearest nodes, by blocked products, and random ones."""
    n, parts = len(x), []
    rng, near = np.random.default_rng(seed), min(NEAREST, len(x))
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        nearest = np.argpartition(-(x[rows] @ x.T), near - 1, axis=1)[:, :near]
        parts.append(prune(x, rows, np.concatenate([nearest, rng.integers(0, n, (len(rows), RANDOM))], 1)))
    return np.concatenate(parts)


def search(x: np.ndarray, links: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """In-range pairs (query, node), by greedy search from the medoid and widening over everything in range."""
    n, rows = len(x), np.arange(len(x))
    links = np.where(links >= 0, links, rows[:, None])
    medoid = int((x @ x.mean(0)).argmax())
    seen = np.zeros((n, n), bool)
    hits = np.zeros((n, n), bool)
    beam = np.full((n, BEAM), -1, np.int64)
    score = np.full((n, BEAM), -np.inf)
    done = np.ones((n, BEAM), bool)
    beam[:, 0], score[:, 0], done[:, 0] = medoid, x @ x[medoid], False
    seen[:, medoid] = True
    hits[rows, rows] = True
    hits[:, medoid] |= score[:, 0] >= threshold
    active = rows
    while len(active):
        open_ = np.where(done[active], -np.inf, score[active])
        slot = open_.argmax(1)
        ok = open_[np.arange(len(active)), slot] > -np.inf
        active, slot = active[ok], slot[ok]
        if not len(active):
            break
        done[active, slot] = True
        near = links[beam[active, slot]]
        fresh = ~seen[active[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[active[:, None], near] = True
        sim = np.where(fresh, np.einsum("qd,qrd->qr", x[active], x[near]), -np.inf)
        q, r = np.nonzero(sim >= threshold)
        hits[active[q], near[q, r]] = True
        all_id, all_sim = np.concatenate([beam[active], near], 1), np.concatenate([score[active], sim], 1)
        all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], 1)
        keep = np.argpartition(-all_sim, BEAM - 1, axis=1)[:, :BEAM]
        beam[active], score[active] = np.take_along_axis(all_id, keep, 1), np.take_along_axis(all_sim, keep, 1)
        done[active] = np.take_along_axis(all_done, keep, 1) | (score[active] == -np.inf)
    widened = np.zeros((n, n), bool)
    while True:
        q, v = np.nonzero(hits & ~widened)
        if not len(q):
            break
        widened[q, v] = True
        for at in range(0, len(q), 1 << 14):
            a, near = q[at:at + (1 << 14)], links[v[at:at + (1 << 14)]]
            i, r = np.nonzero(~hits[a[:, None], near])
            a, b = a[i], near[i, r]
            ok = np.einsum("pd,pd->p", x[a], x[b]) >= threshold
            hits[a[ok], b[ok]] = True
    hits |= hits.T  # a link found from one end holds for both
    q, v = np.nonzero(hits)
    ok = q != v
    return q[ok], v[ok]


def forest(x: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest index that each vector's links lead to, by blocked exact products."""
    root = np.arange(len(x))
    for at in range(0, len(x), 256):
        q, v = np.nonzero(x[at:at + 256] @ x[at:].T >= threshold)
        unite(root, q + at, v + at)
    return root


def exact(x: np.ndarray, threshold: float, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for at in range(0, len(rows), 256):
        q, v = np.nonzero(x[rows[at:at + 256]] @ x.T >= threshold)
        q = rows[at:at + 256][q]
        out.append((q[q != v], v[q != v]))
    return tuple(np.concatenate(z) if out else np.zeros(0, np.int64) for z in zip(*out)) if out else (rows[:0], rows[:0])


# --- operator -----------------------------------------------------------------------------------------------------

def _adjacency(table: pa.Table) -> pa.Table:
    node = table.column("node").to_numpy()
    if len(node) > SHARD:  # a cell that could not be split: _find takes its exact products
        return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.list_(pa.int64()))})
    links = build(unit(_matrix(table.column("vector"))), int(node[0]) & 0xFFFFFFFF)
    ok = links >= 0
    return pa.table({"node": pa.array(node), "links": common.lists(node[links[ok]], ok.sum(1), pa.int64())})


def _find(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        x, n = unit(_matrix(table.column("vector"))), table.num_rows
        if n > SHARD:
            return pa.table({"node": pa.array(node), "to": pa.array(node[forest(x, threshold)]), "missed": pa.array(np.zeros(n, bool))})
        order = np.argsort(node)
        united = table.column("links").combine_chunks().fill_null([])
        flat, size = united.flatten().to_numpy(), np.diff(united.offsets.to_numpy())
        place = np.minimum(np.searchsorted(node[order], flat), n - 1)
        here = node[order][place] == flat
        owner, to = np.repeat(np.arange(n), size)[here], order[place][here]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        links = np.full((n, int(rank.max(initial=0)) + 1), -1, np.int64)
        links[owner, rank] = to
        q, v = search(x, links, threshold)
        aq, av = exact(x, threshold, np.arange(n))
        missed = len(np.setdiff1d(aq * n + av, q * n + v)) > 0
        if missed:
            q, v = aq, av
        root = np.arange(n)
        unite(root, q, v)
        return pa.table({"node": pa.array(node), "to": pa.array(node[root]), "missed": pa.array(np.full(n, missed))})

    return run


def links_inside(members: DataFrame, threshold: float) -> DataFrame:
    """(node, linked): weight of the nodes that each node links with, by exact products inside its component.

    ``members`` holds node, weight, vector, root.  A large component is cut into blocks and a task holds a pair of blocks.
    """
    placed = tasks(in_blocks(members, "root"))
    keyed = placed.withColumn("task", F.xxhash64("root", "i", "j")).repartition("task")

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("root", "ascending"), ("i", "ascending"), ("j", "ascending")])
        key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("root", "i", "j")])
        cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0), [True]]))
        block, weight = table.column("block").to_numpy(), table.column("weight").to_numpy().astype(np.float64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = table.slice(a, b - a)
            x, w = unit(_matrix(part.column("vector"))), weight[a:b]
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if key[1, a] != key[2, a]:  # two blocks: only links across
                near &= block[a:b, None] != block[None, a:b]
            yield pa.RecordBatch.from_arrays([part.column("node").combine_chunks(), pa.array((near @ w).astype(np.int64))], ["node", "linked"])

    counted = keyed.select("node", "weight", "vector", "root", "i", "j", "block").mapInArrow(run, "node bigint, linked bigint")
    return counted.groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, n_links, component_id, kept.

    Rows link if their labels are equal and not null, their vectors have the same length and the cosine is at least the
    threshold.  A null, zero or empty vector, or one with null or non-finite components, links with nothing.  Repeated rows
    are rows of their own that link with each other.  A null key is kept, names no component and is not kept as a
    representative.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    rows = rows.withColumn("ok", F.col("label").isNotNull() & valid(F.col("vector")))
    classes = rows.where("ok").groupBy("label", "vector").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("weight"))
    nodes = common.stored(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    placed = common.stored(tasks(shards(nodes, threshold)).drop("block"), "shards")
    adjacency = placed.groupBy("cell", "i", "j").applyInArrow(_adjacency, "node bigint, links array<bigint>")
    union = adjacency.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))
    found = placed.join(union, "node", "left").groupBy("cell", "i", "j").applyInArrow(_find(threshold), "node bigint, to bigint, missed boolean")
    found = common.stored(found.where("node != to"), "links")
    roots = common.stored(components(found.select(F.col("node").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "member"), "components")
    members = nodes.join(roots, nodes.node == roots.member).select("node", "weight", "vector", "root")
    linked = links_inside(members, threshold).join(roots.withColumnRenamed("member", "node"), "node")
    each = nodes.join(linked, "node", "left").select("label", "vector", "head", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = each.join(each.groupBy("root").agg(F.min("head").alias("component_id")), "root").select("label", "vector", "n_links", "component_id")
    good = rows.where("ok").join(named, ["label", "vector"]).select("key", "n_links", "component_id")
    alone = rows.where("not ok").select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    return good.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
