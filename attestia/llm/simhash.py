"""SimHash near-duplicates: fingerprints, exact pairs within a Hamming radius by vantage-point trees, components.

Fingerprints of unlike texts lie about 32 +- 4 bits apart, so that a triangle bound over all 64 bits prunes little.
The trees therefore work on parts of the bits. With the bits cut in `parts` blocks, two fingerprints at `radius` or
fewer differing bits differ in at most floor(radius / parts) bits of some block (pigeonhole). Each block has a tree of
its own over the Hamming distance within the block: a node splits its points by their distance to a vantage point, and
the points so near to the boundary that a partner may lie beyond are put on both sides. The leaves are the shards;
every pair within the radius meets in a shard, where the whole distance is tested, again behind a triangle bound.

Near-duplicate texts (``near_components``, ``firsts``) are found by wide fingerprints of their sets of shingles, whose
blocks make candidates; each link is then verified on the sets themselves.

Null and empty texts have fingerprint zero and link like any other; texts of any length are taken whole. Rows that repeat a doc_id are rows of their own;
a null doc_id takes part, but never names a component unless all ids in it are null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestia.llm.common import keep, mix64, payloads

#: Seed of XXH64 over a shingle's UTF-8 bytes.
SHINGLE_SEED = 42
#: A leaf of a tree is to hold about so many fingerprints.
LEAF = 1024
#: Words of 64 bits in a wide fingerprint, and the bits in which candidates for a similarity of SIMILAR may differ.
LANES, RADIUS, SIMILAR = 6, 76, 0.8
#: Candidates that differ in at most so many bits are hardly ever refused.
SURE = 48
#: Points that take their sets along to one task.
OPEN = 4096
WORDS = [f"__w{k}" for k in range(LANES)]


def shingle_hashes(text: bytes | None, words: int = 4) -> np.ndarray:
    """XXH64 of the word shingles of a UTF-8 text, A-Z in lower case, repeats included; the whole sequence where it is
    shorter, nothing without words."""
    found = (text or b"").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SHINGLE_SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(lengths) + np.arange(n)
    starts = (ends - lengths)[: n - words + 1].tolist()
    digest, seed = xxhash.xxh64_intdigest, SHINGLE_SEED
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set where over half the hashes have it; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        bits = np.unpackbits(hashes[at : at + 255 * 64].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The 64-bit SimHash of the word shingles of a UTF-8 text, A-Z in lower case; zero without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id_col, __fp long) of every row: the unsigned fingerprint's bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, words) for t in payloads(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], [id_col, "__fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, __fp long")


class Tree:
    """A vantage-point tree over the Hamming distance within one block of bits, as deep as total points need.

    A node's vantage point is a hash of the way to it, so that a tree of any size is a few numbers and is never sent or
    fitted. At each node, the points at most ``radius`` bits from the vantage point go inside and the others outside;
    those so near to the boundary that a partner may lie beyond go to both. A leaf is a node that is to hold ``leaf``
    points or fewer if bits are even. Points of equal bits share all their leaves.
    """

    def __init__(self, at: int, width: int, reach: int, total: int, leaf: int, seed: int):
        self.at, self.width, self.reach, self.seed = at, width, reach, seed
        self.mask = np.uint64(((1 << width) - 1) << at)
        share = np.cumsum([comb(width, k) / 2**width for k in range(width + 1)])
        # the radius with the fewest copies for what a split tells
        told = [-(s * log2(s) + (1 - s) * log2(1 - s)) if 0 < s < 1 else 0.0 for s in share]
        copied = [share[m] - (share[m - reach] if m >= reach else 0.0) for m in range(width + 1)]
        self.radius = min((m for m in range(width) if told[m] > 0.5), key=lambda m: copied[m] / told[m])
        self.inside, self.outside = log2(share[self.radius]), log2(1 - share[self.radius])
        self.small = min(0.0, log2(leaf / max(total, 1)))

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, position of the point) for every leaf that a point belongs to."""
        way, at, held = np.ones(len(points), np.uint64), np.arange(len(points)), np.zeros(len(points))
        leaves, places = [], []
        for _ in range(48):  # beyond, a way no longer fits its number
            done = held <= self.small
            leaves.append(way[done])
            places.append(at[done])
            way, at, held = way[~done], at[~done], held[~done]
            if not len(at):
                break
            d = np.bitwise_count((points[at] ^ mix64(way, self.seed)) & self.mask).astype(np.int64)
            near, far = d <= self.radius, d > self.radius - self.reach
            way = np.concatenate([way[near] << np.uint64(1), (way[far] << np.uint64(1)) | np.uint64(1)])
            at, held = np.concatenate([at[near], at[far]]), np.concatenate([held[near] + self.inside, held[far] + self.outside])
        return np.concatenate([*leaves, way]).view(np.int64), np.concatenate([*places, at])


def forest(total: int, radius: int, parts: int, leaf: int = LEAF, seed: int = 0) -> list[Tree]:
    """One tree for each block of bits."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [Tree(a, b - a, radius // parts, total, leaf, seed + a) for a, b in zip(edges, edges[1:])]


def joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (i, j) that join two sets, in turn; parent is brought up to date."""
    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = a, b
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        if x != y:
            out.append((a, b))
            parent[max(x, y)] = min(x, y)
    while not np.array_equal(up := parent[parent], parent):
        parent[:] = up
    return out


def close_pairs(points: np.ndarray, radius: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct points within the radius that connect all such pairs: fewer than there are points.

    Sorted by the distance to a vantage point, only a window is compared.
    """
    points = np.unique(points)
    if len(points) < 2:
        return points[:0], points[:0]
    d = np.bitwise_count(points ^ points[len(points) // 2]).astype(np.int16)
    order = np.argsort(d, kind="stable")
    points, d = points[order], d[order]
    parent = np.arange(len(points))
    pairs: list[tuple[int, int]] = []
    for a in range(0, len(points), block):
        b = min(a + block, len(points))
        top = int(np.searchsorted(d, d[b - 1] + radius, "right"))
        for c in range(a, top, 4 * block):
            near = np.bitwise_count(points[a:b, None] ^ points[None, c : min(c + 4 * block, top)]) <= radius
            i, j = np.nonzero(near)
            i, j = i + a, j + c
            fresh = (i < j) & (parent[i] != parent[j])
            pairs += joined(parent, i[fresh], j[fresh])
    left, right = (points[[p[k] for p in pairs]] if pairs else points[:0] for k in (0, 1))
    return np.minimum(left, right), np.maximum(left, right)


def links(distinct: DataFrame, radius: int = 4, leaf: int = LEAF) -> DataFrame:
    """(a, b) of distinct fingerprints (column __fp) at most radius bits apart, enough to connect all that are; a group
    of many is not given as all its pairs. The blocks are so many that each tree's reach is one bit."""
    trees = forest(distinct.count(), radius, radius // 2 + 1, leaf)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, tree in enumerate(trees):
                leaves, at = tree.route(points)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(leaves), pa.array(points[at].view(np.int64))], ["tree", "shard", "fp"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        a, b = close_pairs(group["fp"].to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    shards = distinct.select("__fp").mapInArrow(route, "tree int, shard long, fp long")
    return shards.groupBy("tree", "shard").applyInPandas(search, "a long, b long").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b): large-star and small-star rounds until every node points to its root.

    A round's shuffles hold edges, at most as many as at the start; a node's neighbours are never gathered in one row.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = keep(small.where("u <> v").distinct(), "small")


def tag(text_col: str) -> Column:
    """A hash of the text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def wide(text: bytes | None, words: int) -> tuple[int, int, list[int]]:
    """(a key of the set of a text's shingles, their number, the LANES words of its wide fingerprint)."""
    held = np.unique(shingle_hashes(text, words))
    return int(mix64(held, LANES).sum(dtype=np.uint64)), len(held), [majority(mix64(held, k)) for k in range(LANES)]


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id_col, __tag, __fp, __n, __w0, __w1, ...) of every row: a hash of its text, a 64-bit key of its set of shingles,
    their number, and the LANES words of the set's fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, lanes = zip(*(wide(t, words) for t in payloads(b.column(1)))) if b.num_rows else ((), (), ())
            columns = [np.array(c, np.uint64).view(np.int64) for c in (keys, *(zip(*lanes) if lanes else [()] * LANES))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(columns[0]), pa.array(sizes, pa.int32()), *map(pa.array, columns[1:])], [id_col, "__tag", "__fp", "__n", *WORDS])

    schema = f"`{id_col}` {kind}, __tag long, __fp long, __n int, " + ", ".join(f"{w} long" for w in WORDS)
    return docs.select(id_col, text_col, tag(text_col).alias("__tag")).mapInArrow(run, schema)


class Near:
    """Which of a shard's points may be alike: fingerprints within the radius, parts within the reach, sizes that allow it."""

    def __init__(self, points: np.ndarray, part: np.ndarray, sizes: np.ndarray, reach: int, radius: int, similar: float):
        self.points, self.part, self.sizes, self.reach, self.radius, self.similar = points, part, sizes, reach, radius, similar

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.points[i] ^ self.points[j]).sum(axis=1, dtype=np.int64)

    def fit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.minimum(self.sizes[i], self.sizes[j]) >= self.similar * np.maximum(self.sizes[i], self.sizes[j])

    def pairs(self, rows: np.ndarray, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, distance) for i in rows and any j whose number in apart differs, in blocks."""
        for a in range(0, len(rows), 256):
            mine = rows[a : a + 256]
            for c in range(0, len(self.points), 8192):
                i, j = np.nonzero(np.bitwise_count(self.part[mine, None] ^ self.part[None, c : c + 8192]) <= self.reach)
                i, j = mine[i], j + c
                some = (apart[i] != apart[j]) & self.fit(i, j)
                i, j = i[some], j[some]
                d = self.distances(i, j)
                yield i[d <= self.radius], j[d <= self.radius], d[d <= self.radius]


def connected(near: Near, sure: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), fewer than there are points, that connect all that may be alike, the nearest first.

    A few points first take in all that are surely alike, the one next to the points' majority in the lead. Only what is
    outside the largest set is then compared with all: inside it, all are connected. So a large group of copies costs
    its size, not the square of it.
    """
    points, n = near.points, len(near.points)
    parent, links_ = np.arange(n), []
    ones = np.zeros(64 * points.shape[1], np.int64)
    for a in range(0, n, 1 << 14):
        ones += np.unpackbits(points[a : a + (1 << 14)].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    centre = np.packbits(2 * ones > n).view(points.dtype)
    pivot, outside = int(np.bitwise_count(points ^ centre).sum(axis=1, dtype=np.int64).argmin()), np.arange(n)
    for turn in range(8):
        j = np.nonzero(parent != parent[pivot])[0]
        i = np.full(len(j), pivot)
        some = (near.distances(i, j) <= min(sure, near.radius)) & near.fit(i, j)
        links_ += joined(parent, i[some], j[some])
        outside = np.nonzero(parent != np.bincount(parent, minlength=n).argmax())[0]
        if not len(outside):
            break
        pivot = int(outside[len(outside) * turn // 8])
    found = list(near.pairs(outside, parent))
    if found:
        i, j, d = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(d, kind="stable")
        links_ += joined(parent, i[order], j[order])
    left, right = np.array(links_, np.int64).reshape(-1, 2).T
    return left, right


def wide_trees(total: int, leaf: int) -> list[tuple[int, int, Tree]]:
    """(word, first bit, tree): each word has three blocks of 20 bits, each block a tree with a reach of one bit."""
    return [(k, at, Tree(at, 20, 1, total, leaf, 64 * k + at)) for k in range(LANES) for at in (0, 20, 40)]


def near_of(group: pa.Table, trees: list[tuple[int, int, Tree]], radius: int, similar: float) -> Near:
    k, at, _ = trees[group.column("tree")[0].as_py()]
    points = np.stack([group.column(w).to_numpy().view(np.uint64) for w in WORDS], axis=1)
    part = ((points[:, k] >> np.uint64(at)) & np.uint64((1 << 20) - 1)).astype(np.uint32)
    return Near(points, part, group.column("__n").to_numpy(), 1, radius, similar)


def routed(distinct: DataFrame, trees: list[tuple[int, int, Tree]], more: tuple[str, ...] = ()) -> DataFrame:
    """(tree, shard, __fp, __n, words, more) of every shard that a wide fingerprint belongs to."""
    rest = ["__n", *WORDS, *more]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, (k, _, tree) in enumerate(trees):
                leaves, at = tree.route(b.column(k + 2).to_numpy(zero_copy_only=False).view(np.uint64))
                rows = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), pa.array(leaves), *rows.columns], ["tree", "shard", "__fp", *rest])

    return distinct.select("__fp", *rest).mapInArrow(route, "tree int, shard long, __fp long, __n int, " + ", ".join(f"{c} long" for c in rest[1:]))


def wide_links(distinct: DataFrame, radius: int, similar: float, sure: int = SURE, leaf: int = 2 * LEAF) -> DataFrame:
    """(a, b), a < b: keys of distinct wide fingerprints that may be alike and meet in a shard, enough to connect all such."""
    trees = wide_trees(distinct.count(), leaf)

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("__fp")  # so that reruns start from the same points
        i, j = connected(near_of(group, trees, radius, similar), sure)
        key = group.column("__fp").to_numpy()
        return pa.table({"a": np.minimum(key[i], key[j]), "b": np.maximum(key[i], key[j])})

    return routed(distinct, trees).groupBy("tree", "shard").applyInArrow(search, "a long, b long").distinct()


def left_apart(points: DataFrame, sets: DataFrame, radius: int, similar: float, leaf: int = 2 * LEAF, block: int = OPEN) -> DataFrame:
    """(a, b): verified links between points (__fp, __n, words, __label) of different labels, enough to connect all that
    meet in a shard and are alike.

    First each shard names its points that have a candidate of another label; only these take their sets of shingles
    along. Candidates are then verified where they meet, the nearest first, and none whose labels a link already joins, so
    that what leaves a task are links, fewer than its points. A shard of more than ``block`` such points is cut, and
    every two of its parts meet in a task of their own.
    """
    trees = wide_trees(points.count(), leaf)

    def name(group: pa.Table) -> pa.Table:
        near, label = near_of(group, trees, radius, similar), group.column("__label").to_numpy()
        mark = np.zeros(len(label), bool)
        for i, j, _ in near.pairs(np.arange(len(label)), label):
            mark[i] = True
            mark[j] = True
        return group.select(["tree", "shard", "__fp", "__n", *WORDS, "__label"]).filter(pa.array(mark))

    kinds = "tree int, shard long, __fp long, __n int, " + ", ".join(f"{c} long" for c in [*WORDS, "__label"])
    open_ = keep(routed(points, trees, ("__label",)).groupBy("tree", "shard").applyInArrow(name, kinds), "apart")
    parts = open_.groupBy("tree", "shard").agg(F.ceil(F.count("*") / block).cast("int").alias("__parts"))
    placed = open_.join(parts, ["tree", "shard"]).withColumn("__part", F.pmod(F.xxhash64("__fp"), "__parts").cast("int"))
    placed = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    placed = placed.withColumns({"__low": F.least("__part", "__other"), "__high": F.greatest("__part", "__other")}).drop("__parts", "__other")

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by("__fp")
        near, key = near_of(group, trees, radius, similar), group.column("__fp").to_numpy()
        held = [np.frombuffer(x, "<u8") for x in group.column("__set").to_pylist()]
        part, two = group.column("__part").to_numpy(), group.column("__low")[0].as_py() != group.column("__high")[0].as_py()
        _, label = np.unique(group.column("__label").to_numpy(), return_inverse=True)
        parent = np.arange(len(key))
        found = list(near.pairs(np.arange(len(key)), label))
        i, j, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        some = (i < j) & ((part[i] != part[j]) if two else True)
        order = np.argsort(d[some], kind="stable")
        out = []
        for x, y in zip(i[some][order].tolist(), j[some][order].tolist()):
            a, b = int(label[x]), int(label[y])
            while parent[a] != a:
                a = int(parent[a])
            while parent[b] != b:
                b = int(parent[b])
            if a != b and alike(held[x], held[y], similar):
                parent[max(a, b)] = min(a, b)
                out.append((x, y))
        x, y = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(key[x], key[y]), "b": np.maximum(key[x], key[y])})

    return placed.join(sets, "__fp").groupBy("tree", "shard", "__low", "__high").applyInArrow(verify, "a long, b long").distinct()


def alike(one: np.ndarray, two: np.ndarray, similar: float) -> bool:
    """Whether two sorted arrays of distinct values have that Jaccard similarity."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both >= similar * (len(one) + len(two) - both)


def shingle_sets(docs: DataFrame, nodes: DataFrame, distinct: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(__fp, __set) of the keys in nodes (column node): the sorted distinct shingle hashes of one text of each, as bytes."""
    need = distinct.join(nodes, F.col("__fp") == F.col("node"), "left_semi").select("__fp", F.col("__rep.id").alias("__id"), F.col("__rep.tag").alias("__t"))
    marked = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"), tag(text_col).alias("__tag"))
    texts = marked.join(need, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__tag") == F.col("__t"))).select("__fp", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.unique(shingle_hashes(t, words)).astype("<u8").tobytes() for t in payloads(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], ["__fp", "__set"])

    return keep(texts.dropDuplicates(["__fp"]).mapInArrow(run, "__fp long, __set binary"), "sets")


def verified(edges: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(a, b, alike): whether the shingle sets of each pair have that similarity. The two sets of a pair meet as two rows
    of its number, so that no task holds more than two."""
    numbered = keep(edges.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    sides = [numbered.select("pair", F.col(c).alias("__fp")).join(sets, "__fp").select("pair", "__set") for c in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, b""
        for b in batches:
            out = []
            for pair, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if pair == last:
                    out.append((pair, alike(np.frombuffer(one, "<u8"), np.frombuffer(raw, "<u8"), similar)))
                last, one = pair, raw
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_())], ["pair", "alike"])

    found = sides[0].unionAll(sides[1]).repartition("pair").sortWithinPartitions("pair").mapInArrow(run, "pair long, alike boolean")
    return keep(found.join(numbered, "pair").select("a", "b", "alike"), "verified")


def alike_links(docs: DataFrame, distinct: DataFrame, radius: int, similar: float, id_col: str, text_col: str, words: int) -> DataFrame:
    """(a, b) of keys whose shingle sets have that similarity, enough to connect all candidates that have it.

    Candidates meet in a shard with fingerprints within the radius. First a spanning set of them is verified. Where one
    is refused, another candidate may still link its points: candidates between points that the verified ones leave apart
    are verified too, where they meet.
    """
    candidates = keep(wide_links(distinct, radius, similar), "links")
    ends = keep(candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct(), "ends")
    sets = shingle_sets(docs, ends, distinct, id_col, text_col, words)
    first = verified(candidates, sets, similar)
    good, refused = first.where("alike").select("a", "b"), first.where("NOT alike").select("a", "b")
    if refused.isEmpty():
        return good
    labels = closed(stars(good)).select(F.col("node").alias("__node"), F.col("root").alias("__to"))
    points = distinct.join(ends, F.col("__fp") == F.col("node"), "left_semi").join(labels, F.col("__fp") == F.col("__node"), "left")
    points = keep(points.select("__fp", "__n", *WORDS, F.coalesce("__to", "__fp").alias("__label")), "open")
    return good.union(left_apart(points, sets, radius, similar))


def closed(linked: DataFrame) -> DataFrame:
    """(node, root) with the roots themselves as nodes."""
    return linked.union(linked.select(F.col("root").alias("node"), "root").distinct())


def named(marked: DataFrame, distinct: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """marked with component_id, the smallest id (__low of distinct) that a row's __fp reaches over edges (a, b), and
    __root, the same __fp for all rows of a component."""
    linked = closed(keep(stars(edges), "stars"))
    lows = distinct.select("__fp", "__low")
    member = keep(linked.join(lows, linked.node == lows["__fp"]).select("node", "root", "__low"), "members")
    low = member.groupBy("root").agg(F.min("__low").alias("__least"))
    found = member.join(low, "root").select(F.col("node").alias("__node"), F.col("root").alias("__to"), "__least")
    found = lows.join(found, lows["__fp"] == found["__node"], "left")
    found = found.select("__fp", F.coalesce("__to", "__fp").alias("__root"), F.coalesce("__least", "__low").alias("component_id"))
    return marked.join(found, "__fp")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row: 16 hex digits, and the smallest id reachable over links."""
    marked = keep(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = keep(marked.groupBy("__fp").agg(F.min(id_col).alias("__low")), "distinct")
    found = named(marked, distinct, links(distinct, radius), id_col)
    return found.select(id_col, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = RADIUS, similar: float = SIMILAR
) -> DataFrame:
    """(id_col, component_id) of every row: the smallest id reachable over links of texts whose sets of five-word shingles
    have a Jaccard similarity of 0.8 or more.

    Every link is verified on the sets' 64-bit hashes; fingerprints only find candidates. In 384 bits, texts with a
    similarity of 0.8 differ in 58 +- 7, and meet in a shard with a chance of 0.96. Null and empty texts form one group;
    rows that repeat an id are rows of their own; an empty table gives no rows.
    """
    return near_rows(docs, id_col, text_col, words, radius, similar).select(id_col, "component_id")


def near_rows(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, similar: float) -> DataFrame:
    """(id_col, __tag, __fp, __root, component_id) of every row: what near_components and firsts are made of."""
    marked = keep(wide_fingerprints(docs, id_col, text_col, words), "fingerprints")
    rep = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__tag").alias("tag"))).alias("__rep")
    distinct = keep(marked.groupBy("__fp", "__n", *WORDS).agg(F.min(id_col).alias("__low"), rep), "distinct")
    return named(marked.select(id_col, "__tag", "__fp"), distinct, alike_links(docs, distinct, radius, similar, id_col, text_col, words), id_col)


def firsts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = RADIUS, similar: float = SIMILAR
) -> DataFrame:
    """docs without the rows of a component (near_components) beyond the one with its smallest id; all its columns, texts whole.

    One row of each component stays: that of the smallest id, null after all others, and of the smallest text hash where
    rows of one id differ. Rows of different components that share an id, or have none, are documents of their own.
    """
    found = near_rows(docs, id_col, text_col, words, radius, similar)
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__tag").alias("tag"))).alias("__first")
    kept = found.groupBy("__root").agg(first).select(F.col("__first.id").alias("__keep"), F.col("__first.tag").alias("__kept"))
    marked = docs.withColumn("__tag", tag(text_col))
    out = marked.join(kept, marked[id_col].eqNullSafe(kept["__keep"]) & (marked["__tag"] == kept["__kept"]), "left_semi")
    return out.dropDuplicates([id_col, "__tag"]).drop("__tag")  # rows of one id and text are in one component
