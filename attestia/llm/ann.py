"""Nearest neighbours by randomly rotated one-bit codes.

Each vector is taken relative to a centroid, scaled to length 1 and rotated; its code is the signs. Two scalars go with
the code: the length, and the inner product of the unit vector with its code. A query's rotated unit vector is cut into
bit planes, so that its inner product with a code is a few popcounts; divided by the vector's own scalar it estimates
the true inner product, within an error that falls with the root of the dimension. A vector is reranked with its exact
distance if its lower bound is not beyond the k-th best exact distance known. The centroid is the mean of a bounded
sample; every vector is indexed.

The scan is flat: its cost is queries times vectors, a few popcounts for each machine word of a code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.llm.common import keep
from attestia.llm.tiles import TILE, first_k, matrix, search, sound

#: Rows of each length whose mean is the centroid, about so many, drawn by a hash of their id.
SAMPLE = 8192
#: Bits of a code at least: shorter vectors are rotated into more dimensions, as the error falls with their root.
BITS = 256
PLANES = 6


def rotation(d: int, seed: int) -> np.ndarray:
    """d orthonormal rows of a random rotation of the code's dimensions."""
    bits = max(BITS, -(-d // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:d]


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def encode(vectors: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, lengths, inner products of unit vectors and codes); a vector at the centroid has length 0 and product 1."""
    away = vectors - centroid
    lengths = np.sqrt((away * away).sum(axis=1))
    unit = (away / np.where(lengths > 0, lengths, 1)[:, None]) @ turn
    dots = np.abs(unit).sum(axis=1) / np.sqrt(turn.shape[1])
    return packed(unit > 0), lengths, np.where(lengths > 0, dots, 1.0)


def estimates(codes: np.ndarray, dots: np.ndarray, unit: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products of the coded unit vectors with one rotated unit query, error bounds)."""
    d = len(unit)
    low, high = float(unit.min()), float(unit.max())
    step = (high - low) / ((1 << PLANES) - 1) or 1.0
    levels = np.rint((unit - low) / step).astype(np.int64)
    planes = packed((levels[None, :] >> np.arange(PLANES)[:, None] & 1).astype(bool))
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    total = np.zeros(len(codes), np.int64)
    for j in range(PLANES):
        total += np.bitwise_count(codes & planes[j]).sum(axis=1, dtype=np.int64) << j
    over_ones = step * total + low * ones
    whole = float((step * levels + low).sum())
    error = bound * (np.sqrt(np.maximum(1 - dots * dots, 0) / max(d - 1, 1)) + step / np.sqrt(12)) / dots
    return (2 * over_ones - whole) / np.sqrt(d) / dots, error


def nearest(
    vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", bound: float = 2.5, seed: int = 0, tile: int = TILE
) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of smallest Euclidean distance to each query, ties to smaller ids.

    is_query is a condition over __id. Rows of the query's own id are no candidates. Rows without an id and vectors that
    are null, empty, zero, or hold null or non-finite components take no part. Vectors of several lengths each meet their
    own length. Rows that repeat an id are candidates of their own, and as queries share their ranks. An empty table gives
    no rows. bound is the number of standard errors.
    """
    rows = sound(vectors, id_col, vec_col, zero=False)
    counts = F.broadcast(rows.groupBy("__d").agg(F.count("*").alias("__n")))  # one row for each length
    drawn = rows.join(counts, "__d").where(F.pmod(F.xxhash64("__id", F.lit(seed)), "__n") < SAMPLE)
    means = drawn.select("__d", F.posexplode("__vec").alias("at", "x")).groupBy("__d", "at").agg(F.avg("x").alias("x"))
    centres: dict[int, list[tuple[int, float]]] = {}
    for r in means.collect():  # one number for each dimension of each length
        centres.setdefault(r["__d"], []).append((r["at"], r["x"]))
    centre = lambda d: np.array([x for _, x in sorted(centres[d])]) if d in centres else np.zeros(d)
    turns: dict[int, np.ndarray] = {}

    def turn_of(d: int) -> np.ndarray:
        if d not in turns:
            turns[d] = rotation(d, seed)
        return turns[d]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                b = batch if (sizes == d).all() else batch.take(pa.array(np.nonzero(sizes == d)[0]))
                codes, lengths, dots = encode(matrix(b.column(1), d), centre(d), turn_of(d))
                raw = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, raw, pa.array(lengths), pa.array(dots)], ["__id", "__vec", "__d", "__code", "__length", "__dot"])

    index = keep(rows.mapInArrow(code, "__id long, __vec array<double>, __d int, __code binary, __length double, __dot double"), "codes")

    def run(here: pa.Table, asked: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        d = here.column("__d")[0].as_py()
        centroid, turn = centre(d), turn_of(d)
        ids, x = here.column("__id").to_numpy(), matrix(here.column("__vec"), d)
        codes = np.frombuffer(b"".join(here.column("__code").to_pylist()), "<u8").reshape(len(ids), -1)
        lengths, dots = here.column("__length").to_numpy(), here.column("__dot").to_numpy()
        for q_id, q in zip(asked.column("__id").to_pylist(), matrix(asked.column("__vec"), d)):
            away = q - centroid
            far = float(np.sqrt((away * away).sum()))
            found, error = estimates(codes, dots, away @ turn / (far or 1.0), bound)
            scale = 2 * far * lengths
            guess = lengths**2 + far**2 - scale * found
            other = np.nonzero(ids != q_id)[0]
            if not len(other):
                continue
            near = other[np.argpartition(guess[other], min(k, len(other)) - 1)[:k]]
            limit = ((x[near] - q) ** 2).sum(axis=1).max() if len(near) == k else np.inf
            chosen = other[(guess - scale * error)[other] <= limit]
            exact = np.sqrt(((x[chosen] - q) ** 2).sum(axis=1))
            yield q_id, *first_k(ids[chosen], exact, k, False)

    return search(index, index.where(is_query), run, k, "double", False, tile)
