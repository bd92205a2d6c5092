"""Approximate nearest neighbours: hierarchical k-means tree searched best bin first.

The tree (one for each vector length in the sample) is fitted on a bounded sample of distinct vectors (``Plan.sample``, those of lowest id hash); every row is
indexed into a leaf.  A query walks the tree with a priority queue of branches by distance to their
centres and visits leaves in that order.  How many leaves it visits is calibrated: for ``Plan.probes`` queries the true
neighbours are found among all rows, and the visits widen until their mean recall reaches
``Plan.recall``; a query goes on while the leaves it has seen hold fewer rows than it needs.

Leaves are laid out in cells of about ``Plan.cell`` rows: a large leaf has many cells (rows dealt by id hash),
small ones share one, so a vector that a third of the rows have is no hot group.  Queries go to the cells of
their leaves; a cell is copied only as often as its visitors fill groups of about ``Plan.group``, so what is shuffled grows with
the visits, not with rows times queries.  Queries go first to ``Plan.first`` leaves, whose k-th distance
then bounds what all visited cells return, so answers grow with the queries, not with queries times cells.
Distances are exact in double precision on the original vectors; the k best are ranked, ties by id.

Bound: the tree's leaves are those of the sample, so on tables far larger than it a leaf, and what a query reads,
grows with the table; a larger ``Plan.sample`` is the remedy, as the driver and each task hold the centres only.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null
ids; a query's candidates are the vectors of its own length (lengths that the sample lacks share ``ODD`` leaves and are compared in full);
rows with the query's own id are no candidates; a query id that is repeated counts once, with its least valid
vector; repeated candidates each count; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import write_shared


@dataclass(frozen=True)
class Plan:
    k: int = 10
    sample: int = 20_000
    branch: int = 16
    leaf: int = 64  # sample vectors below which a node is not split
    probes: int = 96
    recall: float = 0.96
    first: int = 8  # leaves whose rows bound a query's distances before it visits all
    cell: int = 256
    group: int = 4096


@dataclass
class Node:
    centres: np.ndarray | None = None  # of the children
    children: list["Node"] = field(default_factory=list)
    leaf: int = -1


#: Leaves for vectors of lengths that the sample lacks.
ODD = 16


@dataclass
class Tree:
    """Trees by vector length with the number of their first leaf; ``ODD`` more leaves follow."""

    roots: dict[int, tuple[Node, int]]
    known: int

    @property
    def leaves(self) -> int:
        return self.known + ODD

    def leaf_of(self, rows: list[np.ndarray]) -> np.ndarray:
        """The leaf of each row, by the nearest centre at every level."""
        out = np.zeros(len(rows), dtype=np.int64)
        for length, (at, x) in by_length(rows).items():
            if length not in self.roots:
                out[at] = self.known + length % ODD
                continue
            root, base = self.roots[length]
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, own = todo.pop()
                if not node.children:
                    out[at[own]] = base + node.leaf
                elif len(own):
                    near = _nearest(x[own], node.centres)
                    todo += [(c, own[near == i]) for i, c in enumerate(node.children)]
        return out

    def order(self, q: np.ndarray) -> Iterator[int]:
        """Leaves best bin first."""
        if len(q) not in self.roots:
            yield self.known + len(q) % ODD
            return
        root, base = self.roots[len(q)]
        queue, n = [(0.0, 0, root)], 1
        while queue:
            _, _, node = heapq.heappop(queue)
            if not node.children:
                yield base + node.leaf
                continue
            far = ((node.centres - q) ** 2).sum(axis=1)
            for d, c in zip(far.tolist(), node.children, strict=True):
                heapq.heappush(queue, (d, n, c))
                n += 1


def by_length(rows: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the indices of its rows and their matrix."""
    size = np.array([len(r) for r in rows], dtype=np.int64)
    return {int(n): (at, np.stack([rows[i] for i in at])) for n in np.unique(size) for at in [np.flatnonzero(size == n)]}


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 65_536] @ centres.T).argmin(axis=1) for i in range(0, len(x), 65_536)])


def fit(sample: list[np.ndarray], plan: Plan) -> Tree:
    """Trees over the distinct rows of the sample."""
    rng = np.random.default_rng(7)
    count = 0

    def split(rows: np.ndarray, base: int) -> Node:
        nonlocal count
        if len(rows) > plan.leaf:
            centres = rows[rng.choice(len(rows), plan.branch, replace=False)]
            for _ in range(8):
                near = _nearest(rows, centres)
                centres = np.stack([rows[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(plan.branch)])
            near = _nearest(rows, centres)
            used = [i for i in range(plan.branch) if (near == i).any()]
            if len(used) > 1:
                return Node(centres[used], [split(rows[near == i], base) for i in used])
        count += 1
        return Node(leaf=count - 1 - base)

    roots = {length: (split(np.unique(x, axis=0), count), base) for length, (_, x) in by_length(sample).items() for base in [count]}
    return Tree(roots, count)


def valid(v: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _rows(column: pa.Array) -> list[np.ndarray]:
    return [np.array(v, dtype=np.float64) for v in column.to_pylist()]


def _top(q: np.ndarray, q_id: np.ndarray, v: np.ndarray, v_id: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the indices of its k nearest by distance, then id, and the distances."""
    for i in range(len(q)):
        d = np.sqrt(((v - q[i]) ** 2).sum(axis=1))
        at = np.flatnonzero(v_id != q_id[i])
        if len(at) > k:
            edge = np.partition(d[at], k - 1)[k - 1]
            at = at[d[at] <= edge]
        at = at[np.lexsort((v_id[at], d[at]))[:k]]
        yield at, d[at]


def search(vectors: DataFrame, queries: Column, plan: Plan = Plan(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row that the condition ``queries`` picks."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    kept = lambda df: df.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & valid(F.col("v")))
    base = kept(vectors)
    asked = kept(vectors.where(queries)).groupBy("id").agg(F.min("v").alias("v"))
    sample = _rows(base.orderBy(F.xxhash64("id"), "id").limit(plan.sample).toArrow().column("v").combine_chunks())
    if not sample:
        return spark.createDataFrame([], schema)
    tree = fit(sample, plan)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "leaf": pa.array(tree.leaf_of(_rows(b.column("v"))), pa.int32()), "v": b.column("v")})

    indexed = write_shared(base.mapInArrow(index, "id long, leaf int, v array<double>"), "leaves")
    size = np.zeros(tree.leaves, dtype=np.int64)
    for leaf, n in indexed.groupBy("leaf").count().collect():  # as many rows as leaves, which the sample bounds
        size[leaf] = n
    visits = _calibrate(asked, indexed, tree, plan)

    # Cells: [first, first + parts) of each leaf
    parts = np.maximum(1, -(-size // plan.cell))
    first, used, room = np.zeros(tree.leaves, dtype=np.int64), 0, 0
    for leaf in range(tree.leaves):
        if parts[leaf] == 1 and 0 < size[leaf] <= room:
            first[leaf], room = used - 1, room - size[leaf]
        else:
            first[leaf], used = used, used + parts[leaf]
            room = plan.cell - size[leaf] if parts[leaf] == 1 else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = b.column("leaf").to_numpy()
            ids = b.column("id").to_numpy()
            part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[leaf]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(first[leaf] + part), "id": b.column("id"), "leaf": b.column("leaf"), "v": b.column("v")})

    def walk(visits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, bound = b.column("id").to_pylist(), b.column("bound").to_pylist()
                for i, q in enumerate(_rows(b.column("v"))):
                    cells: dict[int, list[int]] = {}
                    for leaf in _visit(tree, q, size, visits, plan.k):
                        for c in range(first[leaf], first[leaf] + parts[leaf]):
                            cells.setdefault(c, []).append(leaf)
                    n = len(cells)
                    yield pa.RecordBatch.from_pydict({
                        "cell": pa.array(list(cells), pa.int64()), "id": pa.array([ids[i]] * n, pa.int64()), "v": pa.array([q] * n, pa.list_(pa.float64())),
                        "bound": pa.array([bound[i]] * n, pa.float64()), "leaves": pa.array(list(cells.values()), pa.list_(pa.int32()))})

        return run

    def near(key, left: pa.Table, right: pa.Table) -> pa.Table:
        matrix, v_id, leaf = by_length(_rows(left.column("v"))), left.column("id").to_numpy(), left.column("leaf").to_numpy()
        got = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        for q, q_id, leaves, bound in zip(_rows(right.column("v")), *(right.column(c).to_pylist() for c in ("id", "leaves", "bound")), strict=True):
            if len(q) not in matrix:
                continue
            at, x = matrix[len(q)]
            own = np.isin(leaf[at], leaves)
            ids = v_id[at[own]]
            for best, d in _top(q[None], np.array([q_id]), x[own], ids, plan.k):
                good = d <= bound
                got[0].append(np.full(good.sum(), q_id, dtype=np.int64)), got[1].append(ids[best[good]]), got[2].append(d[good])
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(np.concatenate(x)) for x in got), strict=True)))

    cells = indexed.mapInArrow(deal, "cell long, id long, leaf int, v array<double>")

    def found(of: DataFrame, visits: int) -> DataFrame:
        """The k nearest of each query in the leaves that it visits, none beyond its bound, ranked."""
        visiting = write_shared(of.mapInArrow(walk(visits), "cell long, id long, v array<double>, bound double, leaves array<int>"), "visits")
        groups = visiting.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / plan.group).cast("int").alias("groups"))
        left = cells.join(groups, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        right = visiting.join(groups, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")).drop("groups")
        got = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(near, "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return got.withColumn("rank", rank).where(F.col("rank") <= plan.k)

    # The first leaves give each query the distance beyond which no cell needs to answer.
    few = found(asked.withColumn("bound", F.lit(float("inf"))), min(visits, plan.first))
    bounds = few.where(F.col("rank") == plan.k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    out = found(asked.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), visits)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _visit(tree: Tree, q: np.ndarray, size: np.ndarray, visits: int, k: int) -> list[int]:
    seen, rows = [], 0
    for leaf in tree.order(q):
        if len(seen) >= visits and rows > k:
            break
        seen.append(leaf)
        rows += size[leaf]
    return seen


def _calibrate(asked: DataFrame, indexed: DataFrame, tree: Tree, plan: Plan) -> int:
    """Leaves to visit so that the probes' mean recall over all rows reaches the wanted one."""
    probe = asked.orderBy(F.xxhash64("id"), "id").limit(plan.probes).collect()
    if not probe:
        return 1
    q_id, q = [r["id"] for r in probe], [np.array(r["v"], dtype=np.float64) for r in probe]
    asks = {n: (at, x, np.array([q_id[i] for i in at])) for n, (at, x) in by_length(q).items()}

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in q_id]
        for b in batches:
            ids, leaf = b.column("id").to_numpy(), b.column("leaf").to_numpy()
            for n, (rows, v) in by_length(_rows(b.column("v"))).items():
                if n not in asks:
                    continue
                own, x, own_id = asks[n]
                for i, (at, d) in zip(own, _top(x, own_id, v, ids[rows], plan.k), strict=True):
                    best[i] = sorted([*best[i], *zip(d.tolist(), ids[rows][at].tolist(), leaf[rows][at].tolist(), strict=True)])[: plan.k]
        for i, x in enumerate(best):
            if x:
                yield pa.RecordBatch.from_pydict({"q": pa.array([i] * len(x), pa.int32()), "d": pa.array([e[0] for e in x]), "id": pa.array([e[1] for e in x], pa.int64()), "leaf": pa.array([e[2] for e in x], pa.int32())})

    near = indexed.mapInArrow(exact, "q int, d double, id long, leaf int")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("r") <= plan.k)
    true: dict[int, list[int]] = {}
    for r in near.select("q", "leaf").collect():  # probes x k rows
        true.setdefault(r["q"], []).append(r["leaf"])
    total, hits = sum(map(len, true.values())), np.zeros(tree.leaves + 1)
    for i, leaves in true.items():
        at = {leaf: n + 1 for n, leaf in enumerate(tree.order(q[i]))}
        for leaf in leaves:
            hits[at[leaf]] += 1
    reached = np.cumsum(hits) / max(total, 1)
    return max(1, int(np.searchsorted(reached, plan.recall)))
