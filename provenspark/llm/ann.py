"""Approximate nearest neighbours by robust-pruned directed graphs, some per shard.

Vectors are dealt to shards of about ``SHARD`` rows by a hash of their id, and
in a shard to bands of nearly equal length (a factor of 2 to the ``BAND``).  In
a band, nodes join a graph in growing batches: a greedy beam search over the
graph so far proposes neighbours, and pruning keeps an edge to a candidate only
while no kept neighbour is nearer to it by the relaxed factor ``ALPHA``; reverse
edges are added and pruned alike, and nodes that no walk from the start reaches
get an edge from a near one that has room.  A query walks the graphs of every
shard with a wider beam, longest band first, and leaves out bands whose longest
vector cannot reach what it has found; per-shard results merge by exact inner
product in double precision.

Largest inner product becomes nearest point by one more coordinate that gives
all vectors of a band the same norm.  Lengths are handled as logarithms, so
vectors of any finite size take part, and no outlier sets the scale of others.
Equal vectors share one node.  Only (shard, block of queries) groups of bounded
size are gathered; what a graph holds is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenspark.llm.shared import cut, parts

#: Rows of a shard, queries of a block, out-edges of a node, beams of building and searching, relaxation, nodes expanded at a time.
SHARD, BLOCK, DEGREE, BUILD, SEARCH, ALPHA, WIDE = 8_192, 4_096, 32, 64, 192, 1.2, 4
#: Targets walked at a time; width of a band in powers of two; extra edges of a node that keep others reachable.
STEP, BAND, EXTRA = 256, 0.25, 4


def walk(x: np.ndarray, base: np.ndarray, edges: np.ndarray, start: int, targets: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances), nearest first, of a beam search for each target; -1 and inf fill up.

    The distance of a node is base less twice its product with the target.
    """
    b, n = len(targets), len(x)
    rows = np.arange(b)[:, None]
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, x.dtype)
    done = np.zeros((b, beam), bool)
    ids[:, 0] = start
    dist[:, 0] = base[start] - 2 * (targets @ x[start])
    seen = np.zeros((b, n + 1), bool)
    seen[:, start] = True
    while True:
        open_ = ~done & (ids >= 0)
        order = np.cumsum(open_, axis=1)
        pick = open_ & (order <= WIDE)
        live = np.flatnonzero(pick.any(axis=1))
        if not len(live):
            return ids, dist
        done |= pick
        # the picked nodes of each live row, padded with -1
        where = np.argsort(~pick[live], axis=1, kind="stable")[:, :WIDE]
        chosen = np.where(np.take_along_axis(pick[live], where, 1), np.take_along_axis(ids[live], where, 1), -1)
        near = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(len(live), -1)
        near = np.where(near >= 0, near, n)
        near.sort(axis=1)
        fresh = ~seen[live[:, None], near] & (near < n)
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]  # one node reached by two edges at once
        seen[live[:, None], near] = True
        near = np.where(fresh, near, 0)
        d = base[near] - 2 * np.einsum("bd,bkd->bk", targets[live], x[near], optimize=False)
        every_d = np.concatenate([dist[live], np.where(fresh, d, np.inf)], axis=1)
        every_i = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        every_f = np.concatenate([done[live], np.zeros(d.shape, bool)], axis=1)
        sort = np.argsort(every_d, axis=1, kind="stable")[:, :beam]
        dist[live], ids[live], done[live] = (np.take_along_axis(a, sort, 1) for a in (every_d, every_i, every_f))
        done[rows[live], np.arange(beam)] |= ids[live] < 0


def prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Up to DEGREE diverse neighbours of each node out of its candidates (-1: none)."""
    candidates = np.where(candidates == nodes[:, None], -1, candidates)
    points = x[np.maximum(candidates, 0)]
    d = ((points - x[nodes][:, None, :]) ** 2).sum(axis=2)
    d[candidates < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    d, candidates = np.take_along_axis(d, order, 1), np.take_along_axis(candidates, order, 1)
    points = np.take_along_axis(points, order[:, :, None], 1)
    norms = (points * points).sum(axis=2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    alive = np.isfinite(d)
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    out = np.full((len(nodes), DEGREE), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(DEGREE):
        best = alive.argmax(axis=1)
        some = alive[rows, best]
        if not some.any():
            break
        out[some, k] = candidates[some, best[some]]
        alive &= ALPHA * ALPHA * np.maximum(0, between[rows, best]) > d
        alive[rows, best] = False
    return out


def _reached(edges: np.ndarray, start: int, seen: np.ndarray) -> None:
    """Mark all nodes that walks from start reach over unmarked ones."""
    seen[start] = True
    front = np.array([start])
    while len(front):
        front = np.unique(edges[front])
        front = front[front >= 0]
        front = front[~seen[front]]
        seen[front] = True


def build(x: np.ndarray, seed: int = 5) -> tuple[np.ndarray, int]:
    """(edges, start): the graph over the rows of x, -1 where a node has fewer edges; every node can be reached."""
    n = len(x)
    edges = np.full((n + 1, DEGREE + EXTRA), -1, np.int64)  # one more row for "no node"
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]]) if n else order
    norms = (x * x).sum(axis=1)
    at = 1
    while at < n:
        batch = order[at : at + min(at, STEP)]
        found, _ = walk(x, norms, edges, start, x[batch], BUILD)
        edges[batch, :DEGREE] = prune(x, batch, np.concatenate([found, edges[batch]], axis=1))
        # reverse edges, gathered by the node that receives them
        to, source = edges[batch, :DEGREE].ravel(), np.repeat(batch, DEGREE)
        source, to = source[to >= 0], to[to >= 0]
        sort = np.argsort(to, kind="stable")
        to, source = to[sort], source[sort]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        new = np.full((len(nodes), int(count.max()) if len(nodes) else 0), -1, np.int64)
        new[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = source
        for lo in range(0, len(nodes), STEP):
            part, more = nodes[lo : lo + STEP], new[lo : lo + STEP]
            both = np.concatenate([edges[part, :DEGREE], more], axis=1)
            room = (both >= 0).sum(axis=1) <= DEGREE
            if room.any():
                packed = np.take_along_axis(both[room], np.argsort(both[room] < 0, axis=1, kind="stable"), 1)[:, :DEGREE]
                edges[part[room], :DEGREE] = packed
            if (~room).any():
                edges[part[~room], :DEGREE] = prune(x, part[~room], both[~room])
        at += len(batch)
    seen = np.zeros(n, bool)
    if n:
        _reached(edges, start, seen)
    free = np.full(n, EXTRA)
    for lost in np.flatnonzero(~seen).tolist():
        if seen[lost]:
            continue
        found, _ = walk(x, norms, edges, start, x[lost : lost + 1], BUILD)
        near = found[0][found[0] >= 0]
        spare = near[free[near] > 0]
        host = int(spare[0]) if len(spare) else int(np.flatnonzero(seen & (free > 0))[0])  # each new node brings more room than it takes
        edges[host, DEGREE + EXTRA - free[host]] = lost
        free[host] -= 1
        _reached(edges, lost, seen)
    return edges[:n], start


def usable(v: Column) -> Column:
    """Not null, not empty, every component finite, some component not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _distinct_ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, of rows that repeat an id the one with the smallest vector."""
    ids = table.column("vec_id").to_numpy()
    v = _matrix(table.column("v"), len(ids))
    order = np.lexsort((*v.T[::-1], ids)) if len(ids) else np.zeros(0, np.int64)
    ids, v = ids[order], v[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = ids[1:] != ids[:-1]
    return ids[keep], v[keep]


GRAPH = "dim int, shard int, band int, start boolean, vec_ids array<long>, v array<double>, node int, edges array<int>"


def _lengths(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log2 of the length, direction) of each row, for any finite size."""
    most = np.abs(v).max(axis=1, initial=0)
    power = np.where(most > 0, np.frexp(most)[1], 0)
    part = np.ldexp(v, -power[:, None])  # largest component between a half and one
    norm = np.sqrt((part * part).sum(axis=1))
    return power + np.log2(np.maximum(norm, 1e-300)), part / np.maximum(norm, 1e-300)[:, None]


def _shards(batches: Iterator[pa.RecordBatch]) -> dict[tuple, pa.Table]:
    """A partition's rows by (dim, shard, ...)."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return {}
    table = pa.Table.from_batches(found)
    shard = table.column("shard").to_numpy()
    return {int(k): table.filter(pa.array(shard == k)) for k in np.unique(shard)}


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _shards(batches).values():
        ids, v = _distinct_ids(table)
        points, at = np.unique(v, axis=0, return_inverse=True)
        order = np.argsort(at.ravel(), kind="stable")
        owners = np.split(ids[order], np.cumsum(np.bincount(at.ravel(), minlength=len(points)))[:-1])
        length, direction = _lengths(points)
        band = np.floor(length / BAND + 0.5).astype(np.int64)  # unit length in the middle of a band
        for k in np.unique(band):
            own = np.flatnonzero(band == k)
            scaled = direction[own] * np.exp2(length[own] - length[own].max())[:, None]
            lifted = np.concatenate([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))[:, None]], axis=1).astype(np.float32)
            edges, start = build(lifted)
            n = len(own)
            columns = {
                "dim": np.full(n, v.shape[1], np.int32),
                "shard": np.full(n, table.column("shard")[0].as_py(), np.int32),
                "band": np.full(n, k, np.int32),
                "start": np.arange(n) == start,
                "vec_ids": pa.array([np.sort(owners[i]) for i in own], pa.list_(pa.int64())),
                "v": pa.array(list(points[own]), pa.list_(pa.float64())),
                "node": np.arange(n, dtype=np.int32),
                "edges": pa.array([e[e >= 0].astype(np.int32) for e in edges], pa.list_(pa.int32())),
            }
            yield from pa.table(columns).to_batches()


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """The graphs as a table: one row per node, with its ids, vector and out-edges within its shard's band.

    Null, zero and non-finite vectors and rows with null ids get no node; of
    rows that repeat an id the smallest vector counts; equal vectors share a
    node; an empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("dim", F.size("v"))
    sizes = {r.dim: -(-r["count"] // shard_rows) for r in rows.groupBy("dim").count().collect()}  # one row a dimension
    if not sizes:
        return cut(vectors.sparkSession.createDataFrame([], GRAPH), "graph")
    first, total = {}, 0
    for dim in sorted(sizes):
        first[dim], total = total, total + sizes[dim]
    of = lambda d: F.element_at(F.create_map(*[F.lit(x) for pair in d.items() for x in pair]), F.col("dim"))
    dealt = rows.withColumn("shard", (of(first) + F.pmod(F.xxhash64("vec_id"), of(sizes))).cast("int"))
    return cut(dealt.select("shard", "vec_id", "v").repartitionById(total, "shard").mapInArrow(_graphs, GRAPH), "graph")


class _Band:
    """One band's graph, ready to be walked."""

    def __init__(self, table: pa.Table, first: int) -> None:
        table = table.sort_by("node")
        n = self.n = table.num_rows
        self.first = first
        self.v = _matrix(table.column("v"), n)
        self.length = float(_lengths(self.v)[0].max())
        self.x = np.ldexp(self.v, -int(np.ceil(self.length)))  # a power of two: products stay exactly as far apart
        lists = table.column("edges").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        self.edges = np.full((n + 1, max(1, int(sizes.max(initial=0)))), -1, np.int64)
        self.edges[np.repeat(np.arange(n), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        self.start = int(np.flatnonzero(table.column("start").to_numpy(zero_copy_only=False))[0])
        self.owners = table.column("vec_ids").to_pylist()

    def search(self, scaled: np.ndarray, beam: int) -> np.ndarray:
        return walk(self.x, np.zeros(self.n), self.edges, self.start, scaled, beam)[0]

    def plateau(self, q: np.ndarray, nodes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, scores): all nodes of that score at least that walks over such nodes reach."""
        seen = np.zeros(self.n, bool)
        seen[nodes] = True
        front, kept, scores = nodes, [], []
        while len(front):
            s = _products(q[None], self.v[front][None])[0]
            front, s = front[s >= least], s[s >= least]
            kept.append(front)
            scores.append(s)
            front = np.unique(self.edges[front])
            front = front[front >= 0]
            front = front[~seen[front]]
            seen[front] = True
        return np.concatenate([np.zeros(0, np.int64), *kept]), np.concatenate([np.zeros(0), *scores])


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        s = np.einsum("bd,bkd->bk", q, v, optimize=False)
    return np.where(np.isnan(s), -np.inf, s)


def _searcher(top: int, beam: int):
    def run(graph: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if graph.num_rows and queries.num_rows:
            which = graph.column("band").to_numpy()
            bands, n = [], 0
            for k in np.unique(which)[::-1]:  # longest vectors first
                bands.append(_Band(graph.filter(pa.array(which == k)), n))
                n += bands[-1].n
            owners = [o for b in bands for o in b.owners]
            count = np.array([len(o) for o in owners] + [0])
            ids, q = _distinct_ids(queries)
            width = max(beam, 2 * top)
            for lo in range(0, len(ids), STEP):
                part = q[lo : lo + STEP]
                length, direction = _lengths(part)
                pool = np.full((len(part), width), -1, np.int64)
                score = np.full((len(part), width), -np.inf)
                least = np.full(len(part), -np.inf)  # of the nodes that hold the best `top` rows besides the query's own
                for band in bands:
                    with np.errstate(over="ignore"):
                        active = np.flatnonzero(np.exp2(length + band.length) * (1 + 1e-9) >= least)
                    if not len(active):
                        continue
                    found = band.search(direction[active], width)
                    s = np.where(found >= 0, _products(part[active], band.v[np.maximum(found, 0)]), -np.inf)
                    every_s = np.concatenate([score[active], s], axis=1)
                    every_n = np.concatenate([pool[active], np.where(found >= 0, found + band.first, -1)], axis=1)
                    sort = np.argsort(-every_s, axis=1, kind="stable")[:, :width]
                    score[active], pool[active] = np.take_along_axis(every_s, sort, 1), np.take_along_axis(every_n, sort, 1)
                    full = np.cumsum(count[pool[active]], axis=1) > top
                    some = full.any(axis=1)
                    least[active[some]] = score[active[some], full.argmax(axis=1)[some]]
                for i, own in enumerate(ids[lo : lo + STEP].tolist()):
                    nodes, s = pool[i][pool[i] >= 0], score[i][pool[i] >= 0]
                    keep = s >= least[i]
                    if count[nodes[keep]].sum() > top + 1:  # others may tie with the last: follow them beyond the beam
                        pairs = []
                        for band in bands:
                            with np.errstate(over="ignore"):
                                if np.exp2(length[i] + band.length) * (1 + 1e-9) < least[i]:
                                    break
                            near = band.search(direction[i : i + 1], width)[0]  # the pool holds no more than `width` of all bands' ties
                            more, m = band.plateau(part[i], near[near >= 0], least[i])
                            pairs += zip(m.tolist(), (more + band.first).tolist(), strict=True)
                    else:
                        pairs = list(zip(s[keep].tolist(), nodes[keep].tolist(), strict=True))
                    best = sorted((-x, r) for x, node in pairs for r in owners[node][: top + 1] if r != own)[:top]
                    for c, value in zip(out, ([own] * len(best), [r for _, r in best], [-x for x, _ in best]), strict=True):
                        c += value
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def search(graph: DataFrame, queries: DataFrame, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest rows other than its own, nearest first, ties to smaller ids.

    Null, zero and non-finite vectors and rows with null ids take no part; a
    query meets vectors of its own dimension; of rows that repeat an id one
    counts.  A product that has no value in double precision (an overflow of
    both signs) counts as the least.  Empty tables give no rows; other columns
    are not read.
    """
    rows = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("dim", F.size("v"))
    blocks = rows.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    places = graph.select("dim", "shard").distinct().groupBy("dim").agg(F.collect_list("shard").alias("shards"))  # a few numbers a dimension
    asked = rows.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    asked = asked.join(places, "dim").withColumn("shard", F.explode("shards")).select("shard", "block", "vec_id", "v")
    held = graph.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("shard", "block", "band", "start", "vec_ids", "v", "node", "edges")
    cells = graph.select("dim", "shard").distinct().join(blocks, "dim").agg(F.sum("blocks")).first()[0] or 1  # one number
    deal = max(parts(graph.sparkSession), 2 * int(cells))
    keys = ["shard", "block"]
    found = held.repartition(deal, *keys).groupBy(*keys).cogroup(asked.repartition(deal, *keys).groupBy(*keys)).applyInArrow(_searcher(top, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
