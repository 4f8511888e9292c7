"""Exact top-k search by inner product with a pair of cover trees.

Queries and data are dealt into blocks, and each pair of blocks is searched by one task: a cover tree
over the queries and one over the data are walked together. A node's covering radius bounds every
inner product below it: (q + a) (r + b) <= qr + |a||r| + |b||q| + |a||b|. A pair of nodes is left
out when that bound is below the worst kth score among the queries under the node. Each task returns
k rows a query, and the best k of all blocks' rows are the result.

Equal vectors are one point of the tree with all its ids; of these only the k smallest rows, and the
k smallest whose id isn't the first's, can be among the best k, whatever the query. Blocks are dealt by a hash of the id, so no key is hot.

Defined results: vectors that are null or hold a null or a number that isn't finite, and rows of
null id, take no part; vectors of other lengths are never compared; rows that repeat a query's id
are its own and no candidates for it; ties go to the smaller id; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF, FAN = 48, 24  # points of a leaf; children of a node
BLOCK, QUERIES = 16384, 4096  # rows of a block of data, and of queries
OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Node:
    centre: np.ndarray
    norm: float
    radius: float  # the farthest point below
    points: np.ndarray  # places of all points below
    children: list[Node] = field(default_factory=list)


def build(x: np.ndarray, points: np.ndarray | None = None) -> Node:
    """A cover tree over rows of x: a node's children are points chosen far from each other until half its radius is covered."""
    points = np.arange(len(x)) if points is None else points
    own = x[points]
    centre = own[np.argmin(((own - own.mean(0)) ** 2).sum(1))]
    far = np.sqrt(((own - centre) ** 2).sum(1))
    node = Node(centre, float(np.sqrt((centre**2).sum())), float(far.max()), points)
    if len(points) <= LEAF or node.radius == 0:
        return node
    nearest, of = far.copy(), np.zeros(len(points), int)
    for k in range(1, FAN):
        at = int(nearest.argmax())
        if nearest[at] <= node.radius / 2:
            break
        d = np.sqrt(((own - own[at]) ** 2).sum(1))
        closer = d < nearest
        nearest[closer], of[closer] = d[closer], k
    groups = [points[of == k] for k in range(of.max() + 1)]
    node.children = [build(x, g) for g in groups if len(g)]
    return node


class Search:
    """The best k of each query over one block of data."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, r: np.ndarray, r_ids: list[np.ndarray], k: int):
        exact = max(1, q.shape[1]) * float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) < 2**52
        self.q, self.r = (a.astype(np.float64 if exact else np.int64) for a in (q, r))
        self.q_ids, self.r_ids, self.k, self.exact = q_ids, r_ids, k, exact
        self.scores = np.full((len(q), k), np.iinfo(np.int64).min)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)

    def bound(self, a: Node, b: Node) -> float:
        """No score below the pair is higher."""
        up = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return up + 1e-9 * abs(up) + 1e-3

    def leaves(self, a: Node, b: Node) -> None:
        s = self.q[a.points] @ self.r[b.points].T
        s = np.rint(s).astype(np.int64) if self.exact else s
        worst = self.scores[a.points, -1]
        for row in np.flatnonzero(s.max(1) >= worst):
            p = a.points[row]
            some = np.flatnonzero(s[row] >= worst[row])
            ids = [self.r_ids[b.points[k]] for k in some]
            scores = np.concatenate([self.scores[p], np.repeat(s[row][some], [len(i) for i in ids])])
            ids = np.concatenate([self.ids[p], *ids])
            scores = np.where(ids == self.q_ids[p], np.iinfo(np.int64).min, scores)
            ids = np.where(ids == self.q_ids[p], np.iinfo(np.int64).max, ids)
            best = np.lexsort((ids, ~scores))[: self.k]  # ~ turns the order, the least number's as well
            self.scores[p], self.ids[p] = scores[best], ids[best]

    def walk(self, a: Node, b: Node) -> None:
        stack = [(self.bound(a, b), a, b)]
        while stack:
            up, a, b = stack.pop()
            if up < self.scores[a.points, -1].min():
                continue
            if not a.children and not b.children:
                self.leaves(a, b)
            elif not b.children or a.children and a.radius > b.radius:
                stack += [(self.bound(c, b), c, b) for c in a.children]
            else:
                stack += sorted(((self.bound(a, c), a, c) for c in b.children), key=lambda x: x[0])

    def run(self) -> None:
        if len(self.q) and len(self.r):
            self.walk(build(self.q.astype(float)), build(self.r.astype(float)))


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column("id").to_numpy()
    flat = rows.column("vector").combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return ids, values.reshape(len(ids), -1)


def needed(ids: np.ndarray, k: int) -> np.ndarray:
    """Of a point's sorted ids, which may repeat, those that can be among the best k of some query."""
    other = int(np.searchsorted(ids, ids[0], side="right"))  # a query of the first id needs what comes from here on
    return np.concatenate([ids[: min(other, k)], ids[other : other + k]])


def search_block(queries: pa.Table, data: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, score): the best k of a block of data for each query of a block."""
    if not queries.num_rows or not data.num_rows:
        return OUT.empty_table()
    q_ids, q = _matrix(queries)
    ids, r = _matrix(data)
    points, of = np.unique(r, axis=0, return_inverse=True)
    order = np.lexsort((ids, of))
    own = np.split(ids[order], np.flatnonzero(np.diff(of.ravel()[order])) + 1)
    found = Search(q, q_ids, points, [needed(i, k) for i in own], k)
    found.run()
    row, place = np.nonzero(found.ids != np.iinfo(np.int64).max)
    return pa.table([q_ids[row], found.ids[row, place], found.scores[row, place]], schema=OUT)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, dims, vector array<long>): floor(scale * x) of the vectors that take part."""
    v = df[vector_col].cast("array<double>")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.coalesce(sound, F.lit(False)) & df[id_col].isNotNull()).select(
        df[id_col].cast("long").alias("id"), F.size(v).alias("dims"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("vector")
    )


def top_k(data: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query over all other rows."""
    r, q = (whole_vectors(x, id_col, vector_col, scale) for x in (data, queries))
    q = q.dropDuplicates(["id", "dims"])
    n_r, n_q = r.count(), q.count()
    r_blocks, q_blocks = max(1, -(-n_r // BLOCK)), max(1, -(-n_q // QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", deal(q_blocks)).withColumn("rb", every(r_blocks))
    r = r.withColumn("rb", deal(r_blocks)).withColumn("qb", every(q_blocks))
    keys = ["qb", "rb", "dims"]
    found = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(lambda a, b: search_block(a, b, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
