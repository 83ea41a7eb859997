"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length in words. A source's target is met by whole rounds over all its
documents, then an even share of each length, and a bounded-knapsack dynamic programme over length counts for what is
left, so that the words taken come as near to the target as sums of whole documents do. Which documents of a length
are taken is decided by a seeded hash. Only counts by source and length meet in one task, at most as many as a source
has different lengths. The documents of one length are ranked by first counting ranges of their hashes, about as many as
the root of their number, so that only the range on the boundary is sorted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestia.llm.common import keep

#: A target is at most so many times its source.
MOST = 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: Lengths that the dynamic programme may combine: beyond, the even share has left at most this many words anyway.
REACH = 1 << 16


#: One word with the white space around it; nothing is tried twice.
WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def words(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return; 0 for null.

    Each run becomes one letter, and what is left of a text without any is white space. Spark's regexp_count would hold
    all runs of a text as an array.
    """
    marks = F.translate(F.regexp_replace(text, F.lit(WORD), F.lit("w")), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.octet_length(marks), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of sizes by weight; a target beyond most times its size stops there, the excess is reshared."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), [k for k in range(len(sizes)) if sizes[k] > 0]
    while free:
        whole = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / whole > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / whole
            return out
        for k in over:
            out[k] = float(most * sizes[k])
            left -= out[k]
        free = [k for k in free if k not in over]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take: at most counts, their words at most budget and near to it."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = counts * budget // total if total < 2**31 else np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    left = budget - int((taken * lengths).sum())
    for k in np.argsort(-lengths, kind="stable").tolist():  # what the rounding has left, but for a window that is fitted exactly
        if left <= REACH:
            break
        more = min(int(counts[k] - taken[k]), (left - REACH) // int(lengths[k]) + 1, left // int(lengths[k]))
        taken[k] += more
        left -= more * int(lengths[k])
    # the dynamic programme may also give back one document of each length, so that it never lacks short ones
    back = np.nonzero(taken > 0)[0]
    while len(back) and left < REACH:
        k = back[np.argmin(lengths[back])]
        give = min(int(taken[k]), max(1, (REACH - left) // int(lengths[k])))
        taken[k] -= give
        left += give * int(lengths[k])
        if len(back) == 1 or left >= REACH // 2:
            break
        back = back[back != k]
    window = min(left, 2 * REACH)
    reached, mask = 1, (1 << (window + 1)) - 1
    first: dict[int, tuple[int, int]] = {}  # sum -> (length's place, number of documents) that first reached it
    for k in np.argsort(lengths, kind="stable").tolist():
        n, spare, size = int(lengths[k]), int(counts[k] - taken[k]), 1
        spare = min(spare, window // n)
        while spare > 0 and not reached >> window & 1:
            step = min(size, spare)
            new = (reached << (n * step)) & mask & ~reached
            reached |= new
            raw = np.unpackbits(np.frombuffer(new.to_bytes(window // 8 + 1, "little"), np.uint8), bitorder="little")
            for s in np.nonzero(raw)[0].tolist():
                first[s] = (k, step)
            spare -= step
            size *= 2
    at = reached.bit_length() - 1
    while at:
        k, step = first[at]
        taken[k] += step
        at -= int(lengths[k]) * step
    return taken


def plan(sized: DataFrame, most: int = MOST) -> DataFrame:
    """(__source, __size, source_size, target, __count, __rounds, __extra) for each source and length.

    Each document of a length is taken __rounds times, and __extra of them once more. sized: (__source, __size).
    """
    spark = sized.sparkSession
    counted = keep(sized.groupBy("__source", "__size").agg(F.count("*").alias("__count")), "lengths")
    sources = counted.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__count")).alias("source_size")).collect()
    sources.sort(key=lambda r: (r[0] is None, r[0] or ""))  # few by nature: one row for each source
    goal = targets([r[1] for r in sources], [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sources))], most)
    rows = [(r[0], int(r[1]), t) for r, t in zip(sources, goal)]
    named = spark.createDataFrame(rows, "__of string, source_size long, target double")

    def by_source(group: pd.DataFrame) -> pd.DataFrame:
        lengths, counts = group["__size"].to_numpy(np.int64), group["__count"].to_numpy(np.int64)
        size, goal = int(group["source_size"].iloc[0]), int(round(group["target"].iloc[0]))
        rounds = min(goal // size, most) if size else 0
        extra, some = np.zeros(len(lengths), np.int64), lengths > 0
        if size and rounds < most:
            extra[some] = fit(lengths[some], counts[some], goal - rounds * size)
        return group.assign(__rounds=rounds, __extra=extra)

    joined = counted.join(named, F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")  # sent whole only where Spark finds it small
    schema = "__source string, __size long, __count long, source_size long, target double, __rounds long, __extra long"
    return joined.groupBy("__source").applyInPandas(by_source, schema)


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, whole: bool) -> DataFrame:
    """__id, __size, source_size, target, __copies of every row; where whole, also the row itself as __row.

    Rows of one id are ranked by a hash of their texts where whole.
    """
    more = [F.xxhash64(text_col).alias("__tie"), F.struct(*docs.columns).alias("__row")] if whole else []
    sized = docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), words(F.col(text_col)).alias("__size"), *more)
    sized = sized.withColumn("__u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__id"), 11) / F.lit(float(1 << 53)))
    sizes = keep(sized.drop("__tie", "__row"), "sizes")  # what is counted and ranged reads no text
    sized = sized if whole else sizes
    planned = keep(plan(sizes.select("__source", "__size")), "plan")
    named = planned.select(F.col("__source").alias("__s"), F.col("__size").alias("__n"), "__count", "source_size", "target", "__rounds", "__extra")
    partly = (F.col("__extra") > 0) & (F.col("__extra") < F.col("__count"))

    def ranged(table: DataFrame) -> DataFrame:
        rows = table.join(named, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__n"))).drop("__s", "__n")
        return rows.withColumn("__range", F.when(partly, F.floor(F.col("__u") * F.ceil(F.sqrt("__count")))))

    rows, open_ = ranged(sized), ranged(sizes).where(partly)
    counted = open_.groupBy("__source", "__size", "__range", "__extra").agg(F.count("*").alias("__here"))
    before = F.sum("__here").over(Window.partitionBy("__source", "__size").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    edge = counted.withColumn("__before", F.coalesce(before, F.lit(0))).where((F.col("__before") < F.col("__extra")) & (F.col("__before") + F.col("__here") >= F.col("__extra")))
    edge = edge.select(F.col("__source").alias("__s"), F.col("__size").alias("__n"), F.col("__range").alias("__edge"), (F.col("__extra") - F.col("__before")).alias("__last"))
    edge = keep(edge, "edges")
    cut = rows.join(edge, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__n")), "left").drop("__s", "__n")
    sure = cut.where(F.col("__edge").isNull() | (F.col("__range") != F.col("__edge")))
    sure = sure.withColumn("__more", F.when(F.col("__edge").isNull(), F.col("__extra") > 0).otherwise(F.col("__range") < F.col("__edge")).cast("long"))
    rank = F.row_number().over(Window.partitionBy("__source", "__size").orderBy("__u", "__id", *["__tie"] * whole))
    close = cut.where(F.col("__range") == F.col("__edge")).withColumn("__more", (rank <= F.col("__last")).cast("long"))
    both = sure.unionByName(close).withColumn("__copies", F.col("__rounds") + F.col("__more"))
    return both.select("__id", "__size", "source_size", "target", "__copies", *["__row"] * whole)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """(id_col, size, source_size, target, __copies) of every row: how often the mix takes it.

    Null and empty texts have size 0 and are never taken; texts of any length count whole. A null source is a source, the last. Rows that repeat a doc_id
    are documents of their own; equal rows are told apart by nothing and share their lot. An empty table gives no rows.
    """
    found = placed(docs, id_col, text_col, source_col, seed, False)
    return found.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", "__copies")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document, repeats counted."""
    found = copies(docs)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("__copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken; all columns of docs, texts whole.

    Rows that share a doc_id, or have none, are taken each by its own lot.
    """
    found = placed(docs, id_col, text_col, source_col, seed, True).where("__copies > 0")
    return found.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col("__row")[c].alias(c) for c in docs.columns])
