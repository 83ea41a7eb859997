"""Cost-balanced packing of documents into token sequences.

A piece of n tokens costs linear * n + quadratic * n * n, the shape of attention within the piece. Pieces go in
descending length to the sequence of lowest cost that has tokens left; one that does not fit is cut there and its rest
goes on. The sequences of a lot hold exactly as many tokens as the lot: full ones, and for the rest one for each power
of two in it, so that nothing is padded. A task packs its own rows in lots of bounded size and carries what would fill
no whole sequence into its next lot; there is no shuffle, and tokens live only in the task that made them.

Null and empty texts are the end id alone; texts of any length are taken whole and cut freely. Rows that repeat a doc_id, or have none, are documents of their own. An empty
table gives no rows. A task's sequence ids hold its partition number, so that no two tasks share one.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from attestia.llm import bpe
from attestia.llm.common import sliced, trimmed

#: Tokens that a task packs at once.
LOT = 4 << 20


def capacities(total: int, longest: int) -> list[int]:
    """Sizes of sequences that hold exactly total tokens: full ones, then a power of two for each bit of the rest."""
    full, rest = divmod(total, longest)
    return [longest] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def assign(lengths: list[int], room: list[int], linear: float = 1.0, quadratic: float = 1 / 1024, tries: int = 8) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece. The lengths must add up to the room.

    Among the tries cheapest sequences with tokens left, the first with room for the whole piece takes it; else the
    cheapest takes what it can, and the rest of the piece is assigned in its turn.
    """
    longest = max(room, default=1)
    todo = [(-min(n - a, longest), k, a) for k, n in enumerate(lengths) for a in range(0, n, longest)]
    heapq.heapify(todo)
    used = [0] * len(room)
    open_ = [(0.0, s) for s in range(len(room))]
    out = []
    while todo:
        n, doc, start = heapq.heappop(todo)
        n = -n
        passed = []
        while open_ and len(passed) < tries:
            cost, s = heapq.heappop(open_)
            if room[s] - used[s] >= n:
                break
            passed.append((cost, s))
        else:
            passed.sort()
            cost, s = passed.pop(0)
        for x in passed:
            heapq.heappush(open_, x)
        taken = min(n, room[s] - used[s])
        out.append((doc, start, taken, s, used[s]))
        used[s] += taken
        if used[s] < room[s]:
            heapq.heappush(open_, (cost + linear * taken + quadratic * taken * taken, s))
        if taken < n:
            heapq.heappush(todo, (taken - n, doc, start + taken))
    return out


def hold_back(lengths: np.ndarray, most: int) -> np.ndarray:
    """How many tokens of each document, from its end, go into the next lot: most in all, the shortest documents first."""
    held = np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    sums = np.cumsum(lengths[order])
    whole = int(np.searchsorted(sums, most, "right"))
    held[order[:whole]] = lengths[order[:whole]]
    if whole < len(order):
        held[order[whole]] = most - (int(sums[whole - 1]) if whole else 0)
    return held


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048, end_id: int = 1, lot: int = LOT, with_ids: bool = False
) -> DataFrame:
    """One row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids as binary on demand.

    The ids are little-endian unsigned 32-bit numbers. tokenizer is the path of a word-end BPE file, on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(tokenizer)
        numbers = count(TaskContext.get().partitionId() << 40)
        held: list[tuple] = []  # (id, start of what is left, ids left, tokens of the document)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            lengths = np.fromiter((len(x[2]) for x in held), np.int64, len(held))
            back = np.zeros(len(held), np.int64) if last else hold_back(lengths, int(lengths.sum()) % longest)
            now = lengths - back
            room = capacities(int(now.sum()), longest)
            sequence = [next(numbers) for _ in room]
            rows = []
            for k, start, n, s, offset in assign(now.tolist(), room):
                id_, first, ids, total = held[k]
                raw = ids[start : start + n].astype("<u4").tobytes()
                rows.append((id_, first + start, n, zlib.crc32(raw), total, sequence[s], offset) + ((raw,) if with_ids else ()))
            held = [(id_, first + int(a), ids[a:], total) for (id_, first, ids, total), a, b in zip(held, now.tolist(), back.tolist()) if b]
            if rows:
                columns = list(zip(*rows))
                arrays = [pa.array(columns[0], type_), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.binary()) for c in columns[7:])]
                yield pa.RecordBatch.from_arrays(arrays, names)

        type_, size = None, 0
        for batch in batches:
            type_ = batch.column(0).type
            for b in sliced(batch, text_col, 8 << 20):
                ids, lengths = encoder.encode(b.column(1))
                for id_, part in zip(b.column(0).to_pylist(), np.split(ids, np.cumsum(lengths)[:-1])):
                    held.append((id_, 0, np.append(part, np.array([end_id], part.dtype)), len(part) + 1))
                size += len(ids) + b.num_rows
                if size >= lot:
                    yield from flush(False)
                    size = sum(len(x[2]) for x in held)
        if held:
            yield from flush(True)

    longs = ", ".join(f"`{n}` long" for n in names[1:7])
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {longs}" + ", ids binary" * with_ids)
