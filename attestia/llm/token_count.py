"""Edit-aware token counts: a sum tree over the pre-token segments of each document.

A text is cut before a space or line feed that stands between two characters that are no white space. The byte-level
pattern never puts such a place inside a pre-token, so a document's count is the sum over its segments; and whether a
place is cut depends on its two neighbours alone, so that an edit can only change the segments it touches and one
character around. An edit finds the touched leaves by the sums in the tree, re-encodes the text between the nearest
bounds that are surely unchanged, and updates the sums above. Trees are kept as tables of leaves between revisions.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestia.llm.common import keep, sliced

#: Where a text is cut: before a space or line feed between two characters that are no white space.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Members of one node, and the depth at which a tree is built anew.
FAN, DEEP = 32, 24


class Counter:
    """Token counts of segments under a rank file; each distinct segment of a call is encoded once."""

    def __init__(self, ranks: str, pattern: str):
        with open(ranks, "rb") as f:
            pairs = [line.split() for line in f]
        self.encoding = tiktoken.Encoding("segments", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})

    def of(self, segments: list[str]) -> np.ndarray:
        coded = pa.array(segments, pa.large_string()).dictionary_encode()
        count = self.encoding.encode_ordinary
        each = np.fromiter((len(count(s)) for s in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        return each[coded.indices.to_numpy()] if len(segments) else each


class Node:
    """A node of a segment tree: leaves (texts with their token counts) or nodes below, and the sums of both."""

    __slots__ = ("below", "counts", "chars", "tokens", "leaf", "depth", "folded")

    def __init__(self, below: list, counts: list[int] | None = None):
        self.below, self.counts, self.leaf, self.folded = below, counts, counts is not None, None
        if self.leaf:
            self.chars, self.tokens, self.depth = sum(map(len, below)), sum(counts), 1
        else:
            self.chars, self.tokens, self.depth = sum(n.chars for n in below), sum(n.tokens for n in below), 1 + max(n.depth for n in below)


    @classmethod
    def fold(cls, text: str, sizes: list[int], counts: list[int], tokens: int) -> Node:
        """Leaves whose text is cut into segments once they are looked at."""
        node = cls([], [])
        node.folded, node.counts, node.chars, node.tokens = (text, sizes), counts, len(text), tokens
        return node

    def members(self) -> list:
        if self.folded is not None:
            text, sizes = self.folded
            at = 0
            for n in sizes:
                self.below.append(text[at : at + n])
                at += n
            self.folded = None
        return self.below


class Tree:
    """Segments of one text under nodes of at most FAN members, with sums of characters and tokens at each node.

    An edit goes down from the root by the sums, cuts out the segments it touches, and puts the rest together again over
    the new ones: nodes beside its way stay as they are. So it takes FAN times the tree's depth steps, beside the text that
    is encoded again. Edits make a tree deeper; beyond DEEP it is built anew from its leaves, without encoding.
    """

    def __init__(self, segments: list[str], tokens: np.ndarray):
        self.encoded = 0
        self.root = self._over(self._leaves(segments, [int(t) for t in tokens]))

    @classmethod
    def of(cls, text: str, sizes: np.ndarray, tokens: np.ndarray) -> Tree:
        """The tree of a text whose segments have these characters and tokens."""
        tree = cls([], np.zeros(0, np.int64))
        if len(sizes):
            starts = np.arange(0, len(sizes), FAN)
            ends = np.cumsum(np.add.reduceat(sizes, starts)).tolist()
            sums, sizes, tokens = np.add.reduceat(tokens, starts).tolist(), sizes.tolist(), tokens.tolist()
            bounds = zip(starts.tolist(), [0, *ends], ends, sums)
            tree.root = cls._over([Node.fold(text[b:e], sizes[a : a + FAN], tokens[a : a + FAN], n) for a, b, e, n in bounds])
        return tree

    @staticmethod
    def _leaves(segments: list[str], counts: list[int]) -> list[Node]:
        return [Node(segments[a : a + FAN], counts[a : a + FAN]) for a in range(0, len(segments), FAN)]

    @staticmethod
    def _over(nodes: list[Node]) -> Node:
        while len(nodes) > 1:
            nodes = [Node(nodes[a : a + FAN]) for a in range(0, len(nodes), FAN)]
        return nodes[0] if nodes else Node([], [])

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def chars(self) -> int:
        return self.root.chars

    def segments(self, node: Node | None = None) -> Iterator[tuple[str, int]]:
        """(segment, tokens) of all leaves in order."""
        node = node or self.root
        if node.leaf:
            yield from zip(node.members(), node.counts)
        else:
            for n in node.below:
                yield from self.segments(n)

    def text(self) -> str:
        return "".join(s for s, _ in self.segments())

    def _span(self, node: Node, a: int, b: int, start: int) -> tuple[int, int, list[str]]:
        """(start, end, segments) of all segments that hold a character of a to b, or touch it."""
        first, last, out = None, start, []
        at = start
        for n in node.members():
            size = len(n) if node.leaf else n.chars
            if at <= b and at + size >= a:
                if node.leaf:
                    found = (at, at + size, [n])
                else:
                    found = self._span(n, a, b, at)
                first = found[0] if first is None else first
                last = found[1]
                out += found[2]
            elif at > b:
                break
            at += size
        return (start if first is None else first), last, out

    def _cut(self, node: Node, at: int) -> tuple[list[Node], list[Node]]:
        """The nodes before and from character at on, which is a segment's bound."""
        if node.leaf:
            held, k, seen = node.members(), 0, 0
            while k < len(held) and seen < at:
                seen += len(held[k])
                k += 1
            return [Node(x, y) for x, y in [(held[:k], node.counts[:k])] if x], [Node(x, y) for x, y in [(held[k:], node.counts[k:])] if x]
        left, right, seen = [], [], 0
        for n in node.below:
            if seen + n.chars <= at:
                left.append(n)
            elif seen >= at:
                right.append(n)
            else:
                l, r = self._cut(n, at - seen)
                left, right = left + l, right + r
            seen += n.chars
        return left, right

    def replace(self, a: int, b: int, new: str, counter: Counter) -> int:
        """Put new in place of characters a to b; returns the new total."""
        # a bound is decided by the characters on its two sides and the one after: those within two characters may move
        start, end, touched = self._span(self.root, max(0, a - 2), b + 1, 0)
        old = "".join(touched)
        changed = old[: a - start] + new + old[b - start :]
        segments = CUT.split(changed) if changed else []
        self.encoded += len(changed)
        fresh = self._leaves(segments, counter.of(segments).tolist())
        self.root = self._over(self._cut(self.root, start)[0] + fresh + self._cut(self.root, end)[1])
        if self.root.depth > DEEP:
            pairs = list(self.segments())
            self.root = self._over(self._leaves([s for s, _ in pairs], [t for _, t in pairs]))
        return self.total


_loaded: dict[tuple[str, str], Counter] = {}


def load(ranks: str, pattern: str) -> Counter:
    """One counter for each file and Python worker."""
    if (ranks, pattern) not in _loaded:
        _loaded[ranks, pattern] = Counter(ranks, pattern)
    return _loaded[ranks, pattern]


def clip(start: int | None, removed: int | None, length: int) -> tuple[int, int]:
    """An edit's range within a text of so many characters; what lies beyond it or is null counts as its bound."""
    a = min(max(start or 0, 0), length)
    return a, min(a + max(removed or 0, 0), length)


def build(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, __text, __chars, __tokens) of every row: its text and the leaves of its tree, the characters and tokens of
    each segment. Write it: later revisions start from it and encode only what they touch."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(ranks, pattern)
        for batch in batches:
            for b in sliced(batch, text_col):
                cut = [CUT.split(t) if t else [] for t in b.column(1).to_pylist()]
                flat = [s for segments in cut for s in segments]
                bounds = np.concatenate([[0], np.cumsum([len(segments) for segments in cut])]).astype(np.int32)
                sizes = np.fromiter(map(len, flat), np.int32, len(flat))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (sizes, counter.of(flat))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], [id_col, "__text", "__chars", "__tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, __text string, __chars array<int>, __tokens array<int>")


def edited(trees: DataFrame, edits: Column, ranks: str, pattern: str, id_col: str = "doc_id", with_trees: bool = True) -> DataFrame:
    """trees after edits, with tokens_before, tokens_after, chars_before, chars_after and chars_encoded; without the trees
    where only the counts are wanted.

    edits: an array of (start, removed, inserted) in characters over the columns of trees, applied in order, each to the
    text the former left; a range beyond the text is clipped, null fields are 0 or empty, and a null array is none.
    """
    kind = trees.schema[id_col].dataType.simpleString()
    numbers = ["tokens_before", "tokens_after", "chars_before", "chars_after", "chars_encoded"]
    columns = {"__text": ("string", pa.string()), "__chars": ("array<int>", pa.list_(pa.int32())), "__tokens": ("array<int>", pa.list_(pa.int32()))} if with_trees else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(ranks, pattern)
        for batch in batches:
            for b in sliced(batch, "__text"):
                rows = []
                lists = [(c.flatten().to_numpy(), (c.offsets.to_numpy() - c.offsets[0].as_py()).tolist()) for c in (b.column(2), b.column(3))]
                for k, (text, changes) in enumerate(zip(b.column(1).to_pylist(), b.column(4).to_pylist())):
                    tree = Tree.of(text or "", *(x[at[k] : at[k + 1]] for x, at in lists))
                    before, chars = tree.total, tree.chars
                    for e in changes or []:
                        if e is not None:
                            tree.replace(*clip(e["start"], e["removed"], tree.chars), e["inserted"] or "", counter)
                    now = list(tree.segments()) if with_trees else []
                    told = ("".join(s for s, _ in now), [len(s) for s, _ in now], [t for _, t in now]) if with_trees else ()
                    rows.append((*told, before, tree.total, chars, tree.chars, tree.encoded))
                types = [t for _, t in columns.values()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [id_col, *columns, *numbers])

    typed = edits.cast("array<struct<start:long,removed:long,inserted:string>>").alias("__edits")
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{n} {t}" for n, (t, _) in columns.items()), *(f"{n} long" for n in numbers)])
    return trees.select(id_col, "__text", "__chars", "__tokens", typed).mapInArrow(run, schema)


def recount(docs: DataFrame, edits, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, tokens_before, tokens_after, chars_before, chars_after, chars_encoded of every row.

    edits: a function of (id column, text column) to the edits of ``edited``. The trees are built and written once, then
    edited. chars_encoded is what the edits made to be encoded again. Null and empty texts have no tokens; texts of any
    length are taken whole, one row in a task at a time; rows that repeat an id are counted alone; an empty table gives
    no rows; other columns do not matter.
    """
    trees = keep(build(docs, ranks, pattern, id_col, text_col), "trees", "zstd")
    return edited(trees, edits(id_col, "__text"), ranks, pattern, id_col, False)


def revision(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The edits of the registered query: near a place given by the id's hash, three words are put in; a stretch of 40
    characters goes at a second place; and the text's first character is written twice."""
    n = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    at = lambda salt: F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(salt)), n + 1)
    edit = lambda a, r, s: F.struct(a.cast("long").alias("start"), F.lit(r).cast("long").alias("removed"), s.alias("inserted"))
    return F.array(edit(at(1), 0, F.lit(" as amended here")), edit(at(2), 40, F.lit("")), edit(F.lit(0), 0, F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, 1)))
