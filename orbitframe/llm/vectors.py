"""Near-duplicate vectors by a robust-pruned flat graph (operator 3).

Vectors are compared where their labels (and lengths) are equal. Equal vectors are one point with a
weight. The points of a label are dealt to cells around centres (k-means of a bounded sample); a
point is at home in the cell of its nearest centre and a guest in up to ``guests`` others that are
nearly as close. Then
 1. each cell builds a graph of its points: candidates by similarity, robustly pruned, with
    reverse edges and a few far ones, so that no group is an island (build on overlapping shards);
 2. a point's lists from its cells are united;
 3. each point is searched in every cell that it is in, greedily from the cell's medoids over the
    united lists, with a beam that widens over everything within the range until nothing new is in it
    (a block of points takes its steps together);
 4. pairs found are verified by the cosine in double precision, and hold for both ends.
Two points that share cells are counted in the first of them, in either's own order, so nothing
counts twice and no pair leaves a task: a cell gives each point's number of links and a star of edges
to its local component. Components across cells are found by contraction. Points that no centre
parts (a large group of near copies) make a cell larger than ``most_points``: such a cell is compared
exactly, block against block, each pair of blocks in a task of its own.

Recall is audited against brute force: for a bounded number of points, drawn by hash whatever was
found, the share of a point's links that was found, averaged over the points that have any. Below
``least_recall`` the job runs again with twice the guests and beam, and fails rather than returns if
that is not enough.

Bounds: at most about ``most_cells`` centres and 8 sampled points a centre are broadcast; a cell
has about max(cell, points / most_cells) points.

Defined cases: null labels; vectors that are null, empty, zero or hold null or non-finite numbers
link with nothing and are their own component; rows that share a vec_id stay apart as points but
share it as name; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import graph, scratch, workers


@dataclass(frozen=True)
class Settings:
    least: float = 0.98
    cell: int = 1000
    most_points: int = 4000
    most_cells: int = 8192
    guests: int = 3
    margin: float = 0.12
    candidates: int = 48
    degree: int = 24
    far: int = 4
    medoids: int = 4
    alpha: float = 1.2
    beam: int = 24
    slack: float = 0.03
    audited: int = 1000
    least_recall: float = 0.95


def robust_prune(points: np.ndarray, near: np.ndarray, s: Settings) -> np.ndarray:
    """Of each point's candidates (by falling similarity), those no chosen one covers; -1 pads."""
    m, c = near.shape
    out = np.full((m, s.degree), -1, np.int32)
    for at in range(0, m, 256):
        rows = near[at : at + 256]
        cand = points[rows]
        own = np.maximum(0, 2 - 2 * np.einsum("bd,bcd->bc", points[at : at + 256], cand))
        among = np.maximum(0, 2 - 2 * np.einsum("bcd,bed->bce", cand, cand))
        alive = rows >= 0
        for k in range(s.degree):
            pick = alive.argmax(1)
            some = alive[np.arange(len(rows)), pick]
            if not some.any():
                break
            out[at : at + 256, k] = np.where(some, rows[np.arange(len(rows)), pick], -1)
            covered = s.alpha**2 * among[np.arange(len(rows)), pick] <= own
            alive &= ~(covered & some[:, None])
            alive[np.arange(len(rows)), pick] = False
    return out


def build_graph(points: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Lists of one cell, end to end, and where each starts: pruned candidates, a few far points, and the reverse of both."""
    m = len(points)
    if m == 1:
        return np.zeros(2, np.int64), np.zeros(0, np.int64)
    c = min(s.candidates, m - 1)
    near = np.empty((m, c), np.int32)
    for at in range(0, m, 512):
        sim = points[at : at + 512] @ points.T
        sim[np.arange(len(sim)), np.arange(at, at + len(sim))] = -np.inf
        part = np.argpartition(-sim, c - 1, axis=1)[:, :c]
        near[at : at + 512] = np.take_along_axis(part, np.argsort(-np.take_along_axis(sim, part, 1), axis=1, kind="stable"), 1)
    far = np.random.default_rng(m).integers(0, m, (m, s.far), np.int32)
    out = np.hstack([robust_prune(points, near, s), np.where(far == np.arange(m)[:, None], -1, far)])
    src, dst = np.repeat(np.arange(m), out.shape[1]), out.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    pairs = np.unique(np.concatenate([src * np.int64(m) + dst, dst * np.int64(m) + src]))
    return np.searchsorted(pairs // m, np.arange(m + 1)), pairs % m


def medoids(points: np.ndarray, number: int) -> np.ndarray:
    """The point nearest to the mean, then those farthest from the ones before."""
    out = [int((points @ points.mean(0)).argmax())]
    nearest = points @ points[out[0]]
    while len(out) < min(number, len(points)):
        out.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, points @ points[out[-1]])
    return np.unique(out)


def cosines(points: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of each pair of unit vectors."""
    out = np.empty(len(q), points.dtype)
    for at in range(0, len(q), 8192):
        out[at : at + 8192] = np.einsum("ij,ij->i", points.take(q[at : at + 8192], 0), points.take(p[at : at + 8192], 0))
    return out


class Beams:
    """Of each query of a block, the best points met outside the range, by falling similarity."""

    def __init__(self, queries: int, width: int):
        self.ids, self.sims = np.zeros((queries, width), np.int64), np.full((queries, width), -np.inf, np.float32)
        self.done, self.width = np.ones((queries, width), bool), width

    def add(self, r: np.ndarray, p: np.ndarray, sim: np.ndarray) -> None:
        keep = sim > self.sims[r, -1]
        r, p, sim = r[keep], p[keep], sim[keep]
        if not len(r):
            return
        order = np.argsort(r, kind="stable")
        some, count = np.unique(r, return_counts=True)
        row, place = np.repeat(np.arange(len(some)), count), self.width + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        shape = len(some), self.width + int(count.max())
        both = np.zeros(shape, np.int64), np.full(shape, -np.inf, np.float32), np.ones(shape, bool)
        for x, old, new in zip(both, (self.ids, self.sims, self.done), (p[order], sim[order], False)):
            x[:, : self.width] = old[some]
            x[row, place] = new
        best = np.argpartition(-both[1], self.width - 1, axis=1)[:, : self.width]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(both[1], best, 1), axis=1, kind="stable"), 1)
        self.ids[some], self.sims[some], self.done[some] = (np.take_along_axis(x, best, 1) for x in both)

    def next(self, room: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ones of each query's ``room`` best that were not given yet: query, point."""
        todo = ~self.done & (np.arange(self.width) < room[:, None])
        todo &= np.cumsum(todo, axis=1) <= number
        self.done |= todo
        return np.nonzero(todo)[0], self.ids[todo]


def range_search(points: np.ndarray, starts: np.ndarray, lists: np.ndarray, queries: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a query (a point's index) and a point met that is within the range or near it.

    Each query is searched for itself; a block of them takes its steps together, so a step costs a few
    array operations for all.
    """
    m, start, floor = len(points), medoids(points, s.medoids), s.least - s.slack
    block = max(1, min(256, (1 << 22) // m))
    for at in range(0, len(queries), block):
        q = queries[at : at + block]
        n = len(q)
        beams, inside = Beams(n, s.beam), np.zeros(n, np.int64)
        seen, last = np.zeros(n * m, bool), np.zeros(n * m, np.int32)
        new = (np.arange(n)[:, None] * m + start).ravel()
        seen[new] = True
        while True:
            r = new // m
            p = new - r * m
            sims = cosines(points, q[r], p)
            found = sims >= s.least - 1e-5
            yield q[r[found]], p[found]
            # The beam is everything that is within the range, and the best ones up to its width.
            close = sims >= floor
            came = np.bincount(r[close], minlength=n)
            inside += came
            beams.add(r[~close], p[~close], sims[~close])
            # What came within the range is followed at once, else the four best that are left.
            more, which = beams.next(np.where(came > 0, 0, s.beam - inside), 4)
            r, p = np.concatenate([r[close], more]), np.concatenate([p[close], which])
            if not len(r):
                break
            new = _unseen(r, p, starts, lists, m, seen, last)


def _unseen(r: np.ndarray, p: np.ndarray, starts: np.ndarray, lists: np.ndarray, m: int, seen: np.ndarray, last: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """Neighbours of p not yet seen by query r, once each, as r * m + neighbour; about ``most`` entries of lists at a time."""
    size = starts[p + 1] - starts[p]
    ends, out = np.cumsum(size), []
    cuts = [0, *np.searchsorted(ends, np.arange(most, ends[-1], most)).tolist(), len(r)]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        k, first = size[a:b], ends[a:b] - size[a:b]
        new = np.repeat(r[a:b] * m, k) + lists[np.arange(first[0], ends[b - 1]) + np.repeat(starts[p[a:b]] - first, k)]
        new = new[~seen[new]]
        number = np.arange(len(new), dtype=np.int32)
        last[new] = number  # of equal ones, one remains
        new = new[last[new] == number]
        seen[new] = True
        out.append(new)
    return np.concatenate(out)


def _groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """Rows that agree in the first columns, from a sorted partition."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and tuple(key[a]) != now:
                yield pa.Table.from_batches(held)
                held = []
            now = tuple(key[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, "<f8").reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(s: Settings):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        for t in _groups(batches):
            node = t.column(1).to_numpy()
            starts, lists = build_graph(_matrix(t.column(2)).astype(np.float32), s)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(node[lists]))], ["node", "list"])

    return work


MET = "node long, links long, root long"


class Members:
    """The points of a cell, or of two blocks of one: what counting and joining of found pairs needs."""

    def __init__(self, t: pa.Table, here: int):
        self.node, self.weight, cells = t.column("node").to_numpy(), t.column("weight").to_numpy(), t.column("cells").combine_chunks()
        m, size = len(self.node), cells.value_lengths().to_numpy()
        self.cells = np.full((m, int(size.max())), np.iinfo(np.int64).min)
        self.cells[np.arange(self.cells.shape[1]) < size[:, None]] = cells.flatten().to_numpy()
        self.rank = (self.cells == here).argmax(1)
        self.links, self.parent = np.zeros(m, np.int64), np.arange(m)

    def first_here(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether no cell that q lists before this one holds p too."""
        out = np.ones(len(q), bool)
        for a in range(int(self.rank.max())):
            for b in range(self.cells.shape[1]):
                out &= ~((a < self.rank[q]) & (self.cells[q, a] == self.cells[p, b]))
        return out

    def _find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, q: np.ndarray, p: np.ndarray) -> None:
        """Links from q to p, rows of one q together; the other direction is given likewise."""
        own = self.first_here(q, p)
        np.add.at(self.links, q[own], self.weight[p[own]])
        cuts = np.flatnonzero(q[1:] != q[:-1]) + 1
        for i, some in zip(q[np.r_[0, cuts]].tolist() if len(q) else [], np.split(p, cuts)):
            # A ball's points meet in few components: only one step for each.
            for r in np.unique(self.parent[some]).tolist():
                a, b = self._find(i), self._find(r)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)

    def met(self) -> pa.RecordBatch:
        root = np.array([self._find(i) for i in range(len(self.node))], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.node), pa.array(self.links), pa.array(self.node[root])], ["node", "links", "root"])


def _search(s: Settings):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            members = Members(t, t.column("cell")[0].as_py())
            node, m = members.node, len(members.node)
            exact = _matrix(t.column("x"))
            points = exact.astype(np.float32)
            order = np.argsort(node)
            column = t.column("list").combine_chunks()
            flat = column.flatten().to_numpy()
            at = np.minimum(np.searchsorted(node[order], flat), m - 1)
            here = node[order][at] == flat
            row = np.repeat(np.arange(m), column.value_lengths().to_numpy())[here]
            starts = np.searchsorted(row, np.arange(m + 1))
            hit = np.zeros((m, m), bool)  # at most most_points squared
            for q, p in range_search(points, starts, order[at][here], np.arange(m), s):
                good = cosines(exact, q, p) >= s.least  # verified in double precision
                hit[q[good], p[good]] = True
            hit |= hit.T
            np.fill_diagonal(hit, False)
            for first in range(0, m, 256):
                q, p = np.nonzero(hit[first : first + 256])
                members.add(q + first, p)
            yield members.met()

    return work


def _compare(s: Settings):
    """Sorted rows (cell, i, j, block, ...): all pairs of two blocks of a cell, exactly."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            members = Members(t, t.column("cell")[0].as_py())
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            block, exact = t.column("block").to_numpy(), _matrix(t.column("x"))
            for at in range(0, len(exact), 256):
                near = exact[at : at + 256] @ exact.T >= s.least
                near[np.arange(len(near)), np.arange(at, at + len(near))] = False
                if i != j:
                    near &= block[at : at + 256, None] != block[None]
                q, p = np.nonzero(near)
                members.add(q + at, p)
            yield members.met()

    return work


def centres(points: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means, a few rounds."""
    rng = np.random.default_rng(seed)
    c = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(6):
        near = np.concatenate([(points[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(points), 8192)])
        for j in range(k):
            own = points[near == j]
            if len(own):
                v = own.sum(0)
                c[j] = v / max(np.linalg.norm(v), 1e-12)
    return c


def _points(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, v, and whether the row can link at all."""
    v = F.col("v")
    good = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    named = rows.select(rows[key].cast("long").alias("vec_id"), rows[label].alias("label"), rows[vector].cast("array<double>").alias("v"))
    return named.withColumn("good", F.coalesce(good & F.col("label").isNotNull(), F.lit(False)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([(np.array(x, "<f8") / np.abs(x).max()).tobytes() for x in b.column(2).to_pylist()], pa.binary()), b.column(3)], ["node", "part", "x", "weight"])


PLACED = "cell long, node long, x binary, weight long, cells array<long>"


def _assign(shared, s: Settings):
    """Points -> a row for each cell they are in, with all their cells, home first; a small part is one cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column(1).to_numpy()
            rows, cells, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.ones(len(part), np.int64)
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                if p not in shared.value:
                    rows.append(at), cells.append(np.full(len(at), p))
                    continue
                x = _matrix(b.column(2).take(pa.array(at)))
                angle = np.arccos(np.clip(x @ shared.value[p].T, -1, 1))
                order = np.argsort(angle, axis=1, kind="stable")[:, : s.guests + 1]
                close = np.take_along_axis(angle, order, 1)
                i, j = np.nonzero(close <= close[:, :1] + s.margin)
                rows.append(at[i])
                cells.append(np.int64(p) ^ ((order[i, j].astype(np.int64) + 1) * np.int64(0x5DEECE66D)))
                counts[at] = np.bincount(i, minlength=len(at))
            take, cell = np.concatenate(rows), np.concatenate(cells)
            order = np.argsort(take, kind="stable")  # a point's rows together, in its own order of cells
            take, cell = take[order], cell[order]
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell))
            some = pa.array(take)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0).take(some), b.column(2).take(some), b.column(3).take(some), lists.take(some)], ["cell", "node", "x", "weight", "cells"])

    return work


def near_duplicates(rows: DataFrame, s: Settings = Settings(), key: str = "vec_id", vector: str = "embedding", label: str = "label", tries: int = 2) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall of every row."""
    spark = rows.sparkSession
    every = _points(rows, key, vector, label)
    good = every.filter("good").withColumn("node", F.xxhash64("label", "v"))
    classes = good.groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("weight"))
    packed = classes.select("node", F.xxhash64("label", F.size("v")).alias("part"), "v", "weight").mapInArrow(_pack, "node long, part long, x binary, weight long")
    points, points_at = scratch.written(packed, "points")
    n = points.count()
    cell = max(s.cell, -(-n // s.most_cells))
    large = {r.part: r.n for r in points.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * cell).collect()}  # at most n / cell parts
    found: dict[int, np.ndarray] = {}
    if large:
        # About 8 points a centre, those of least hash; at most 8 x 2 x most_cells in all.
        share = spark.createDataFrame([(p, min(1.0, 8 / cell)) for p in large], "part long, share double")
        sample = points.join(F.broadcast(share), "part").filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("node", "part", "x").collect()
        by_part: dict[int, list] = {}
        for r in sorted(sample, key=lambda r: r.node):
            by_part.setdefault(r.part, []).append(np.frombuffer(r.x, "<f8"))
        for p, xs in by_part.items():
            x = np.array(xs)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            found[p] = centres(x, min(len(x), -(-large[p] // cell)))
    shared = spark.sparkContext.broadcast(found)
    for _ in range(tries):
        links, stars, met_at = _run(points, shared, s)
        recall = audit(points, links, s)
        if recall >= s.least_recall:
            break
        scratch.drop(spark, met_at)
        s = replace(s, guests=2 * s.guests + 1, margin=2 * s.margin, beam=2 * s.beam)
    else:
        raise RuntimeError(f"recall {recall:.3f} of near-duplicate vectors is below {s.least_recall}")
    comps = graph.components(stars.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = good.select("vec_id", "node").join(links, "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named, _ = scratch.written(named.join(points.select("node", "weight"), "node"), "named")
    scratch.drop(spark, points_at, met_at)
    least = named.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    linked = named.join(least, "comp").select("vec_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    alone = every.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("audit_recall"))


def _run(points: DataFrame, shared, s: Settings) -> tuple[DataFrame, DataFrame, str]:
    """(node, links) of every point, and (node, root): stars of the cells' local components; where they are written."""
    spark = points.sparkSession
    placed, placed_at = scratch.written(points.mapInArrow(_assign(shared, s), PLACED), "placed")
    large, large_at = scratch.written(placed.groupBy("cell").agg(F.count("*").alias("m")).filter(F.col("m") > s.most_points), "large")
    usual = placed.join(large, "cell", "left_anti")
    built = usual.select("cell", "node", "x").repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_build(s), "node long, list array<long>")
    lists = built.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("list")))).alias("list"))
    joined = usual.join(lists, "node").select("cell", "node", "x", "weight", "cells", "list")
    met = joined.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_search(s), MET)
    blocks = F.ceil(F.col("m") / F.lit(s.most_points / 2)).cast("int")
    dealt = placed.join(large, "cell").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("cell", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "x", "weight", "cells")
    met = met.union(dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node").mapInArrow(_compare(s), MET))
    met, met_at = scratch.written(met, "met")
    scratch.drop(spark, placed_at, large_at)
    return met.groupBy("node").agg(F.sum("links").alias("links")), met.select("node", "root"), met_at


def audit(points: DataFrame, links: DataFrame, s: Settings) -> float:
    """Mean share of a point's links that were found, over ``audited`` points of least hash that have any by brute force.

    1 if none of them has.
    """
    spark = points.sparkSession
    queries = points.orderBy(F.xxhash64("node", F.lit(2)), "node").limit(s.audited).select("node", "part", "x").collect()
    by_part: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for p in {r.part for r in queries}:
        own = [r for r in queries if r.part == p]
        x = np.array([np.frombuffer(r.x, "<f8") for r in own])
        by_part[p] = np.array([r.node for r in own]), x / np.linalg.norm(x, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(by_part)
    least = s.least

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            node, part, weight = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy()
            for p in np.unique(part).tolist():
                if p not in shared.value:
                    continue
                names, q = shared.value[p]
                at = np.flatnonzero(part == p)
                near = (q @ _matrix(b.column(2).take(pa.array(at))).T >= least) & (names[:, None] != node[at][None])
                for name, k in zip(names.tolist(), (near * weight[at]).sum(1).tolist()):
                    total[name] = total.get(name, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["node", "truth"])

    truth = points.mapInArrow(work, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth")).filter("truth > 0")
    got = truth.join(links, "node").agg(F.avg(F.least(F.col("links") / F.col("truth"), F.lit(1.0)))).first()[0]
    return 1.0 if got is None else got
