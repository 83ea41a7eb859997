"""A stated set of query vectors against all vectors of their length, in tiles of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors, and queries, of a tile.
TILE = 4096


def sound(vectors: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(__id, __vec of doubles, __d its length) of the rows that take part.

    No part take rows without an id, and vectors that are null, empty, hold null or non-finite components, or are zero
    (unless zero). Vectors of different lengths take part, but only meet their own length.
    """
    bad = F.exists("__vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(vec_col).cast("array<double>").alias("__vec"))
    rows = rows.where(F.col("__id").isNotNull() & (F.size("__vec") > 0)).where(~bad)
    if not zero:
        rows = rows.where(F.exists("__vec", lambda x: x != 0))
    return rows.withColumn("__d", F.size("__vec"))


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def search(
    index: DataFrame,
    queries: DataFrame,
    run: Callable[[pa.Table, pa.Table], Iterator[tuple[int, np.ndarray, np.ndarray]]],
    k: int,
    score: str,
    descending: bool,
    tile: int = TILE,
) -> DataFrame:
    """The k best of run's (query id, ids, scores) over all tiles: query_id, rank, vec_id, score.

    index: (__id, __vec, __d, ...), queries likewise, with columns of their own if they like. For each length, every tile of
    index rows meets every tile of queries once; a task holds one of each. A tile gives at most k rows for a query, so that
    the last ranking is small. Of the lengths only the counts are gathered, one row for each.
    """
    counted = lambda rows, n: rows.groupBy("__d").agg(F.ceil(F.count("*") / tile).alias(n))
    grid = F.broadcast(counted(index, "__tiles").join(counted(queries, "__blocks"), "__d"))
    at = F.monotonically_increasing_id()
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    here = index.join(grid, "__d").withColumn("__tile", at % F.col("__tiles")).withColumn("__block", spread("__blocks")).withColumn("__asks", F.lit(False))
    asked = queries.join(grid, "__d").withColumn("__block", at % F.col("__blocks")).withColumn("__tile", spread("__tiles")).withColumn("__asks", F.lit(True))
    both = here.drop("__tiles", "__blocks").unionByName(asked.drop("__tiles", "__blocks"), allowMissingColumns=True)
    kind = "double" if score == "double" else "long"

    def group(table: pa.Table) -> pa.Table:
        asks = table.column("__asks")
        held, queries = table.filter(pc.invert(asks)), table.filter(asks)
        found = list(run(held, queries)) if held.num_rows and queries.num_rows else []
        of = np.repeat(np.array([q for q, _, _ in found], np.int64), [len(i) for _, i, _ in found])
        ids = np.concatenate([np.zeros(0, np.int64), *(i for _, i, _ in found)])
        scores = np.concatenate([np.zeros(0, np.float64 if kind == "double" else np.int64), *(s for _, _, s in found)])
        return pa.table({"query_id": of, "vec_id": ids, "score": scores})

    best = both.groupBy("__d", "__tile", "__block").applyInArrow(group, f"query_id long, vec_id long, score {kind}")
    by: Column = F.col("score").desc() if descending else F.col("score")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def first_k(ids: np.ndarray, scores: np.ndarray, k: int, descending: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties to the smaller id."""
    order = np.lexsort((ids, -scores if descending else scores))[:k]
    return ids[order], scores[order]
