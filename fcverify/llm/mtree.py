"""Exact top-k search by inner product in M-trees.

The inner product is no distance, but with one more coordinate, sqrt(M - |x|^2) for
candidates (M: the largest squared norm) and 0 for queries, the largest inner product is
the smallest Euclidean distance. In that space the tree has three levels: routing objects
(a bounded sample), pages of the vectors nearest to one of them, and in each page leaves
around routing objects of its own. All nodes keep a covering radius, all entries the
distance to their parent. A query visits nodes in the order of the least distance they
can hold and stops when that exceeds its k-th best; in a leaf only entries whose stored
parent distance lies within the bound are computed.

Scores are exact integers; distances only decide what need not be computed, with some slack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fcverify.llm.store import ready, stored

K = 5
SCALE = 256
# Routing objects of the root at most, vectors of a page and of a leaf, queries of a block.
ROUTES, PAGE, LEAF, QUERIES = 256, 8192, 256, 4096
# Squared norms below this keep every inner product inside a long, by Cauchy and Schwarz.
LARGEST = float(1 << 62)
NONE = np.int64(-(1 << 62) - 1)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``, the components as floor(scale * x), of the vectors that take part.

    Left out: rows without an id, vectors that are null, empty, hold a null or a number that
    is not finite, or are so long that a score could leave the range of long. Repeated rows
    count once.
    """
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < 2.0 ** 31))
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.coalesce(fine, F.lit(False)))
            .select("vec_id", x.cast("array<long>").alias("v")).withColumn("norm", norm).filter(F.col("norm") < LARGEST)
            .withColumn("dim", F.size("v")).dropDuplicates(["vec_id", "v"]))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Candidates with the further coordinate that gives them all the squared norm ``most``."""
    x = v.astype(np.float64)
    return np.c_[x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles are exact while the norms' product stays below 2^53."""
    if float((q.astype(float) ** 2).sum(axis=1).max(initial=0)) * float((v.astype(float) ** 2).sum(axis=1).max(initial=0)) < 2.0 ** 105:
        return np.rint(q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


class Page:
    """An M-tree over the vectors of one page: leaves with covering radii, entries sorted by parent distance."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, most: float, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        point = lifted(v, most)
        self.routes = point[:: max(1, min(leaf, len(ids)))]
        to = distances(point, self.routes)
        parent = to.argmin(axis=1)
        far = to[np.arange(len(ids)), parent]
        self.leaves, self.radius = [], np.zeros(len(self.routes))
        for r in range(len(self.routes)):
            own = np.flatnonzero(parent == r)
            own = own[np.argsort(far[own], kind="stable")]
            self.leaves.append((ids[own], v[own], far[own]))
            self.radius[r] = far[own].max(initial=0.0)
        self.computed = 0

    def search(self, q_ids: np.ndarray, q: np.ndarray, most: float, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and scores of the k best of every query; ``bound``: scores below it need not be found."""
        point = np.c_[q.astype(np.float64), np.zeros(len(q))]
        norm = (point * point).sum(axis=1)
        slack = 1e-6 * (np.sqrt(norm) + np.sqrt(most) + 1)
        to = distances(point, self.routes)
        least = np.maximum(0.0, to - self.radius)
        order = np.argsort(least, axis=1, kind="stable")
        ids, scores = np.full((len(q), k), -1, np.int64), np.full((len(q), k), NONE)
        active = np.arange(len(q))
        for step in range(len(self.leaves)):
            worst = np.maximum(bound[active], scores[active, -1].astype(np.float64))
            reach = np.sqrt(np.maximum(0.0, norm[active] + most - 2 * worst)) + slack[active]
            node = order[active, step]
            on = least[active, node] <= reach
            active, node, reach = active[on], node[on], reach[on]
            if not active.size:
                break
            for leaf in np.unique(node):
                mine = active[node == leaf]
                near, at = reach[node == leaf], to[mine, leaf]
                e_ids, e_v, far = self.leaves[leaf]
                a, b = np.searchsorted(far, (at - near).min()), np.searchsorted(far, (at + near).max(), side="right")
                if a < b:
                    got = products(q[mine], e_v[a:b])
                    self.computed += got.size
                    got[q_ids[mine][:, None] == e_ids[None, a:b]] = NONE
                    self._merge(ids, scores, mine, np.broadcast_to(e_ids[a:b], got.shape), got, k)
        return ids, scores

    @staticmethod
    def _merge(ids, scores, rows, new_ids, new, k):
        if new.shape[1] > k:  # those above the k-th score, and all that equal it, come into question
            kth = -np.partition(-new, k - 1, axis=1)[:, k - 1:k]
            width = int((new >= kth).sum(axis=1).max())
            pick = np.argsort(-new, axis=1, kind="stable")[:, :width]
            new, new_ids = np.take_along_axis(new, pick, 1), np.take_along_axis(new_ids, pick, 1)
        s, i = np.c_[scores[rows], new], np.c_[ids[rows], new_ids]
        i = np.where(s == NONE, -1, i)
        pick = np.lexsort((i, -s), axis=1)[:, :k]
        scores[rows], ids[rows] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k highest inner products of every query row with other rows.

    ``is_query`` is a condition on ``vec_id``. A row with the query's id is the query's own.
    Ties go to the smaller id. Vectors of another dimension are no candidates. A query with
    two different vectors under its id asks with both.
    """
    spark = ready(vectors.sparkSession)
    rows = stored(quantised(vectors), "vectors")
    sizes = {r["dim"]: r for r in rows.groupBy("dim").agg(
        F.count("*").alias("n"), F.max("norm").alias("most"), F.count(F.when(is_query, 1)).alias("q")).collect()}
    out = [_search(rows.filter(F.col("dim") == dim), is_query, dim, r["n"], r["q"], r["most"], k)
           for dim, r in sorted(sizes.items()) if r["q"]]
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


_NODE = "route int, far double, vec_id long, v array<long>"
_HITS = "query_id long, asked long, vec_id long, score long"


def _search(rows: DataFrame, is_query: Column, dim: int, n: int, n_queries: int, most: float, k: int) -> DataFrame:
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit("route")), "vec_id").limit(min(ROUTES, -(-n // PAGE))).select("v").collect()
    routes = lifted(np.array([r["v"] for r in drawn]), most)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                to = distances(lifted(_matrix(batch.column("v"), dim), most), routes)
                near = to.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.astype(np.int32)), pa.array(to[np.arange(len(near)), near]), batch.column("vec_id"), batch.column("v")],
                    names=["route", "far", "vec_id", "v"])

    nodes = stored(rows.select("vec_id", "v").mapInArrow(route, _NODE), "nodes")
    # at most ROUTES rows: how many pages each routing object has, and how far they reach
    node = nodes.groupBy("route").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    pages = {r["route"]: -(-r["n"] // PAGE) for r in node}
    radius = {r["route"]: r["radius"] for r in node}
    blocks = -(-n_queries // QUERIES)
    number = F.element_at(F.create_map(*[F.lit(x) for p in pages.items() for x in p]), F.col("route"))
    page = F.pmod(F.xxhash64("vec_id", "v"), number).cast("int")
    # every page meets every block of queries that it can serve; a page has about PAGE rows, a block about QUERIES
    entries = (nodes.withColumn("page", page).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
               .select("route", "page", "block", "vec_id", "v"))
    asked = (nodes.filter(is_query).withColumn("asked", F.xxhash64("v"))
             .withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")))

    def answer(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "asked", "vec_id", "score")})
        tree = Page(left.column("vec_id").to_numpy(), _matrix(left.column("v").combine_chunks(), dim), most)
        q_ids = right.column("query_id").to_numpy()
        ids, scores = tree.search(q_ids, _matrix(right.column("v").combine_chunks(), dim), most,
                                  right.column("bound").to_numpy(), k)
        row, col = np.nonzero(scores > NONE)
        return pa.table({"query_id": q_ids[row], "asked": right.column("asked").to_numpy()[row],
                         "vec_id": ids[row, col], "score": scores[row, col]})

    def ask(questions: DataFrame) -> DataFrame:
        on = ["route", "page", "block"]
        return entries.groupBy(*on).cogroup(questions.groupBy(*on)).applyInArrow(answer, _HITS)

    home = asked.withColumn("page", page).select("route", "page", "block", F.col("vec_id").alias("query_id"), "asked", "v",
                                                 F.lit(float("-inf")).alias("bound"))
    first = stored(ask(home), "home")
    kth = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score")))
    bounds = first.withColumn("nth", kth).filter(F.col("nth") == k).select("query_id", "asked", F.col("score").cast("double").alias("bound"))
    rest = (home.select("query_id", "asked", "v", "block", F.col("route").alias("home_route"), F.col("page").alias("home_page"))
            .join(bounds, ["query_id", "asked"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other pages whose routing object may hold something within the query's bound."""
        known = np.array(sorted(pages))
        reach = np.array([radius[r] for r in known])
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.c_[_matrix(batch.column("v"), dim).astype(np.float64), np.zeros(batch.num_rows)]
            norm = (q * q).sum(axis=1)
            within = np.sqrt(np.maximum(0.0, norm + most - 2 * batch.column("bound").to_numpy())) + 1e-6 * (np.sqrt(norm) + np.sqrt(most) + 1)
            may = np.maximum(0.0, distances(q, routes[known]) - reach) <= within[:, None]
            for at, r in enumerate(known):
                for p in range(pages[r]):
                    there = (batch.column("home_route").to_numpy() == r) & (batch.column("home_page").to_numpy() == p)
                    chosen = batch.filter(pa.array(may[:, at] & ~there))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(chosen.num_rows, x, np.int32)) for x in (r, p)]
                        + [chosen.column(c) for c in ("block", "query_id", "asked", "v", "bound")],
                        names=["route", "page", "block", "query_id", "asked", "v", "bound"])

    others = rest.mapInArrow(visit, "route int, page int, block int, query_id long, asked long, v array<long>, bound double")
    return first.unionByName(ask(others))
