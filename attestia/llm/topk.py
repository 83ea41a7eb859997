"""Exact top-k inner products by aggregation of sorted lists without random access.

Each dimension of a tile is a list of (vector, component), sorted by the component. A query reads a list from its top
where its own component is positive and from its bottom where it is negative, so that contributions fall along the list;
a component of zero has no list. All lists are read in turn, entry by entry, to a common depth, and from there on step by
step. A vector's score is at least the sum of the contributions read for it with the worst contribution of each list
that has not shown it, and at most that sum with the last contribution read of each. Reading stops once at most RESOLVE
times k vectors have an upper bound that reaches the limit, or all lists are at their ends, where the bounds meet; the
scores of those vectors are then resolved.

The limit is the k-th best lower bound of the tile. As it closes late, a first search over one tile's worth of vectors
of each length, drawn by hash, gives each query the k-th best score there; no vector below it is among the k best of all,
and so it is the limit in the other tiles. What a vector's upper bound is on average after a step is known from the lists
alone; bounds are only worked out from the step on where that is below the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.llm.tiles import TILE, first_k, matrix, search, sound

#: Depths to which the lists are read, one after the other.
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1)
#: Reading stops when at most so many times k vectors may still be among the k best.
RESOLVE = 16
#: Relative error that is allowed for sums of doubles when bounds are compared.
ERROR = 2.0**-44


class Lists:
    """The sorted lists of a tile."""

    def __init__(self, v: np.ndarray):
        n = len(v)
        order = np.argsort(v, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(v, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T)
        self.depths = sorted({max(1, int(np.ceil(n * part))) for part in DEPTHS})
        # what a vector has on average in a list read to each depth, with the last entry read for what is not shown
        self.top = np.array([(self.values[:, n - k :].sum(axis=1) + (n - k) * self.values[:, n - k]) / n for k in self.depths])
        self.bottom = np.array([(self.values[:, :k].sum(axis=1) + (n - k) * self.values[:, k - 1]) / n for k in self.depths])
        self.cuts: dict[int, tuple] = {}
        self.at, self.gain = np.empty(v.size, np.int64), np.empty(v.size)

    def cut(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the lists hold down to a depth, from the top and from the bottom: vectors, and how far their components are
        from the last one read."""
        if depth not in self.cuts:
            n = self.order.shape[1]
            top, bottom = self.values[:, n - depth :], self.values[:, :depth]
            self.cuts[depth] = tuple(map(np.ascontiguousarray, (self.order[:, n - depth :], top - top[:, :1], self.order[:, :depth], bottom - bottom[:, -1:])))
        return self.cuts[depth]

    def _read(self, up: np.ndarray, down: np.ndarray, query: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(vector, its contribution above the last one read) of all entries down to a depth; valid until the next call."""
        top, above, bottom, below = self.cut(depth)
        n, m = len(up) * depth, (len(up) + len(down)) * depth
        at, gain = self.at[:m], self.gain[:m]
        for lists, places, values, a, b in ((up, top, above, 0, n), (down, bottom, below, n, m)):
            np.take(places, lists, axis=0, out=at[a:b].reshape(-1, depth), mode="clip")
            part = np.take(values, lists, axis=0, out=gain[a:b].reshape(-1, depth), mode="clip")
            part *= query[lists, None]
        return at, gain

    def read(self, query: np.ndarray, out: np.ndarray, k: int, resolve: int, limit: float = -np.inf) -> tuple[np.ndarray, int]:
        """(positions of the vectors that may be among the k best, number of entries read). Those in out take no part, nor
        need those that stay below the limit."""
        lists = np.nonzero(query)[0]
        n, others = self.order.shape[1], int((~out).sum())
        k = min(k, others)
        if not k or others <= resolve or not len(lists):
            return np.nonzero(~out)[0], 0
        up, down = np.nonzero(query > 0)[0], np.nonzero(query < 0)[0]
        ends = float(self.values[up, 0] @ query[up] + self.values[down, -1] @ query[down])  # the worst of all lists
        slack = ERROR * float(np.maximum(-self.values[:, 0], self.values[:, -1]) @ np.abs(query)) + ERROR * abs(ends)
        average = self.top @ np.maximum(query, 0) + self.bottom @ np.minimum(query, 0)
        known = limit > -np.inf
        for depth, mean in zip(self.depths, average):
            if depth < n and (mean >= limit if known else 2 * depth < n):
                continue
            at, gain = self._read(up, down, query, depth)
            front = np.concatenate([self.values[up, n - depth] * query[up], self.values[down, depth - 1] * query[down]])
            high = front.sum() + np.bincount(at, gain, n)
            if not known:
                worst = np.concatenate([self.values[up, 0] * query[up], self.values[down, -1] * query[down]])
                low = ends + np.bincount(at, gain + np.repeat(front - worst, depth), n)
                limit = np.partition(low[~out], others - k)[others - k]
            alive = np.nonzero((high + slack >= limit - slack) & ~out)[0]
            if len(alive) <= resolve or depth == n:
                return alive, len(lists) * depth
        raise AssertionError("the last depth is the lists' length")


def scores(v: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole doubles with a query of such; what is beyond 64 bits is the nearest number
    that is not."""
    bound = float((np.abs(v).max(axis=0, initial=0) * np.abs(query)).sum())
    if bound < 2**53:
        return (v @ query).astype(np.int64)
    if bound < 2**62:
        return v.astype(np.int64) @ query.astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in v], object).reshape(v.shape) @ np.array([int(x) for x in query], object)
    return np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in whole], np.int64)


def top_inner(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(scale * x), ties to smaller ids.

    is_query is a condition over __id. Rows of the query's own id are no candidates. Rows without an id and vectors that
    are null, empty, or hold null or non-finite components take no part; zero vectors do. Vectors of several lengths each
    meet their own length. Rows that repeat an id are candidates of their own, and as queries share their ranks. Scores
    beyond 64 bits count as the nearest 64-bit number. An empty table gives no rows.
    """
    rows = sound(vectors, id_col, vec_col, zero=True)
    y = lambda x: x * scale
    whole = rows.withColumn("__vec", F.transform("__vec", lambda x: F.when(F.abs(y(x)) < 2.0**53, F.floor(y(x)).cast("double")).otherwise(y(x))))

    def run(here: pa.Table, asked: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        d = here.column("__d")[0].as_py()
        ids, v = here.column("__id").to_numpy(), matrix(here.column("__vec"), d)
        lists = Lists(v)
        limits = asked.column("__limit").to_pylist()
        for q_id, query, limit in zip(asked.column("__id").to_pylist(), matrix(asked.column("__vec"), d), limits):
            may, _ = lists.read(query, ids == q_id, k, RESOLVE * k, -np.inf if limit is None else limit)
            yield q_id, *first_k(ids[may], scores(v[may], query), k, True)

    queries = whole.where(is_query)
    counts = F.broadcast(whole.groupBy("__d").agg(F.count("*").alias("__n")))  # one row for each length
    drawn = whole.join(counts, "__d").where(F.pmod(F.xxhash64("__id", F.lit(1)), "__n") < tile).drop("__n")
    first = search(drawn, queries.withColumn("__limit", F.lit(None).cast("double")), run, k, "long", True, tile)
    # the least of 64 bits also stands for what is below it
    limits = first.where((F.col("rank") == k) & (F.col("score") > -(2**63))).select(F.col("query_id").alias("__id"), F.col("score").cast("double").alias("__limit"))
    return search(whole, queries.join(limits, "__id", "left"), run, k, "long", True, tile)
