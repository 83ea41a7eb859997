"""URL verdicts by a Bloom filter cascade over listed keys.

A url's keys are its host's suffixes at label bounds, each with the path's prefixes of the lengths that the list has. The
first level holds the listed keys; the second those keys of the corpus that are not listed but pass the first; the third
the listed keys that pass the second; and so on until a level has no false positives. The universe is complete, so that
a key of the corpus is listed exactly if the first level it fails is an even one. Nothing is joined, and no list is sent
with the levels: which rule fits is told by the url's own key. A list beyond MOST_KEYS is cut into shards by a hash of the
key, each with a cascade of its own, so that what is collected and broadcast at once has that bound at every size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestia.llm.common import keep, mix64

#: Most keys of a shard's level, and so of what is collected and broadcast at once: about 2 MB of bits.
MOST_KEYS = 1 << 20


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key(host_: str, path_: str) -> int:
    """64 bits of a key, as Spark's xxhash64 of host, line feed and path."""
    return xxhash.xxh64_intdigest(f"{host_}\n{path_}".encode(), 42)


class Bloom:
    """Bits of a set of 64-bit keys."""

    def __init__(self, keys: np.ndarray, per_key: int, seed: int):
        self.seed, self.hashes = seed, max(1, round(per_key * 0.69))
        self.size = max(64, 1 << int(np.ceil(np.log2(max(1, len(keys)) * per_key))))
        bits = np.zeros(self.size, bool)
        for at in self._places(keys):
            bits[at] = True
        self.bits = np.packbits(bits, bitorder="little")

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(self.hashes):
            yield (mix64(keys, 1000 * self.seed + k) & np.uint64(self.size - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys):
            out &= (self.bits[at >> 3] >> (at & 7) & 1).astype(bool)
        return out


class Cascade:
    """Exact membership for the keys of the universe it was built over."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def has(self, keys: np.ndarray) -> np.ndarray:
        listed = np.full(len(keys), len(self.levels) % 2 == 1)
        todo = np.arange(len(keys))
        for depth, level in enumerate(self.levels):
            passed = level.has(keys[todo])
            listed[todo[~passed]] = depth % 2 == 1
            todo = todo[passed]
        return listed


class Shards:
    """Cascades of a list cut by a hash of the key."""

    def __init__(self, parts: list):
        self.parts = parts  # a power of two of them

    @staticmethod
    def of(keys: np.ndarray, parts: int) -> np.ndarray:
        return (mix64(keys, 77) & np.uint64(parts - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(keys), bool), self.of(keys, len(self.parts))
        for k, part in enumerate(self.parts):
            at = np.nonzero(shard == k)[0]
            if len(at):
                out[at] = (part if isinstance(part, Cascade) else part.value).has(keys[at])
        return out


def build(listed: np.ndarray, universe: DataFrame, per_key: int = 10, most: int = MOST_KEYS) -> Shards:
    """Cascades of the listed keys over universe, a DataFrame of distinct keys (column key), each sent to the tasks.

    For each shard of at most about most / 2 listed keys, a pass for the first level brings its false positives to the
    driver, which are a hundredth of the universe at 10 bits a key; if they would be more than most, the level gets more
    bits. At most ``most`` keys are collected at once.
    """
    listed = np.unique(listed.astype(np.uint64))
    if not len(listed):
        return Shards([Cascade([])])
    parts = 1 << max(0, int(np.ceil(np.log2(2 * len(listed) / most))))
    shard = Shards.of(listed, parts)
    return Shards([universe.sparkSession.sparkContext.broadcast(_cascade(listed[shard == k], universe, k, parts, per_key, most)) for k in range(parts)])


def _cascade(listed: np.ndarray, universe: DataFrame, shard: int, parts: int, per_key: int, most: int) -> Cascade:
    if not len(listed):
        return Cascade([])
    while True:
        first = Bloom(listed, per_key, 0)
        sent = universe.sparkSession.sparkContext.broadcast((first, listed))

        def strays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level, known = sent.value
            for b in batches:
                keys = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                keys = keys[Shards.of(keys, parts) == shard]
                keys = keys[level.has(keys)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[~np.isin(keys, known)].view(np.int64))], ["key"])

        found = universe.select("key").mapInArrow(strays, "key long")
        rows = found.limit(most + 1).collect()
        if len(rows) <= most:
            break
        per_key *= 2
    levels, inside, outside = [first], np.array([r[0] for r in rows], np.int64).view(np.uint64), listed
    while len(inside):
        levels.append(Bloom(inside, per_key, len(levels)))
        outside, inside = inside, outside[levels[-1].has(outside)]
    return Cascade(levels)


def keys(host_: Column, path_: Column, lengths: Iterable[int]) -> Column:
    """All keys of a url, as an array of longs: longest host first, then longest path."""
    labels = F.split(host_, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in sorted(set(lengths), reverse=True)]), lambda n: n <= F.char_length(path_))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda n: F.xxhash64(F.concat(s, F.lit("\n"), F.substring(path_, F.lit(1), n))))))


def named(host_: str, path_: str, lengths: list[int]) -> list[tuple[int, int, str]]:
    """(length, length of the host's part, text) of all keys of a url, in the order of ``keys``."""
    labels = host_.split(".")
    suffixes = [".".join(labels[k:]) for k in range(len(labels))]
    return [(len(s) + n, len(s), s + path_[:n]) for s in suffixes for n in lengths if n <= len(path_)]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", per_key: int = 10, most: int = MOST_KEYS) -> DataFrame:
    """id_col, host, path, rule, verdict of every row. rules: (verdict, host, path).

    A rule fits its host and all subdomains where the url's path starts with the rule's; the longest wins (host and path
    together, then host). Without a rule, the verdict is the cascade's: block for a listed key, else allow. Both lists,
    block and allow, go into cascades of their own; a rule that is listed under both verdicts has the last one. Null urls
    and urls without ``://`` have empty host and path and no rule; rows that repeat an id are judged alone; an empty table
    gives no rows.
    """
    verdicts = {key(h, p): v for v, h, p in rules}
    lengths = sorted({len(p) for _, _, p in rules} or {0}, reverse=True)
    parts = keep(
        pages.select(F.col(id_col), F.col(url_col).alias("__url")).select(id_col, host(F.col("__url")).alias("host"), path(F.col("__url")).alias("path")), "urls"
    )
    keyed = parts.withColumn("__keys", keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("__keys").alias("key")).distinct()
    universe = keep(universe, "keys")
    blocked, allowed = (build(np.array([k for k, x in verdicts.items() if x == v], np.uint64), universe, per_key, most) for v in ("block", "allow"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index("__keys"))
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            block, allow = blocked.has(flat), allowed.has(flat)
            hit = np.nonzero(block | allow)[0]
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row = np.searchsorted(starts, hit, "right") - 1
            best: dict[int, tuple[int, int, str, str]] = {}
            hosts, paths = b.column(1), b.column(2)
            for r, k, blocks in zip(row.tolist(), hit.tolist(), block[hit].tolist()):
                fits = named(hosts[r].as_py(), paths[r].as_py(), lengths)[k - int(starts[r])]
                best[r] = max(best.get(r, (0, 0, "", "")), (*fits, "block" if blocks else "allow"))
            found = [best.get(r) for r in range(b.num_rows)]
            rule = pa.array([x and x[2] for x in found], pa.string())
            verdict = pa.array([x[3] if x else "allow" for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], rule, verdict], [id_col, "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return keyed.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
