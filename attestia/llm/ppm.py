"""Prediction by partial matching over bytes: code lengths of documents, beside a unigram base.

A document is the byte stream of its words (A-Z in lower case, split at ASCII white space) joined by one space and ended
by a line feed, after null bytes as first contexts. The trie holds for every context of up to ORDER bytes how often each
byte followed it. A byte is coded in its longest context; if it never followed there, an escape (method C: as likely as
the context has different followers) leads to the next shorter context, where the followers already refused are excluded;
below the empty context all bytes left are equally likely.

Pretrained scoring counts the training documents in one distributed pass, by their longest contexts alone, as the counts
of shorter ones are sums of these. The counts of all orders stay tables, keyed by context; the order is the same at every
size. What a byte costs is a function of its longest context and itself alone, so that the costs of the ENTRIES commonest
such grams are sent to the tasks; the grams of a document that are not among them are counted in it and meet their costs
in a join, each distinct one escaping through the tables once. ``Trie`` is the same model in one process. Adaptive coding
(``adaptive``) learns from the document itself as it goes.

The base's word counts are not bounded: the commonest HOT words are sent to the tasks, and the other words of a document
meet their counts in a join by the word's 64-bit hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.llm.common import Places, crc_mod, keep, sliced

ORDER = 5
ENTRIES = 1 << 22
HOT = 1 << 18
#: Bytes of text that a task turns into grams at once, at 8 bytes each in several arrays.
SLICE = 1 << 20
LN10 = np.log(10)


def streams(texts: pa.Array, order: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all words in a row, number of words of each text, the texts' byte streams in a row with order null bytes before
    each) and where each stream's first byte is; the last bound is the end."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    cut = pc.ascii_split_whitespace(low)
    empty = pc.equal(low, "").to_numpy(zero_copy_only=False)
    lengths = np.where(empty, 0, np.diff(cut.offsets.to_numpy())).astype(np.int64)
    words = cut.flatten()
    words = words.filter(pc.not_equal(words, "")) if empty.any() else words
    pad, end, none = (pa.scalar(x, pa.large_string()) for x in ("\0" * order, "\n", ""))
    whole = pc.binary_join_element_wise(pad, pc.binary_join(cut.cast(pa.list_(pa.string())), " ").cast(pa.large_string()), end, none)
    _, offsets, data = whole.buffers()
    bounds = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return words, lengths, np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def grams(stream: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(a context of order bytes and the byte after it, as a number, for each coded byte; the streams' bounds therein)."""
    x = stream.astype(np.uint64)
    code = x[: len(x) - order].copy() if len(x) > order else x[:0]
    for k in range(1, order + 1):
        code <<= np.uint64(8)
        code |= x[k : len(x) - order + k]
    coded = np.ones(len(code), bool)
    inner = bounds[1:-1]
    if order and len(inner):
        coded[((inner - order)[:, None] + np.arange(order)).ravel()] = False
    return code[coded], bounds - order * np.arange(len(bounds))


def hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct words, the place there of each word)."""
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    return np.fromiter((digest(w) for w in distinct), np.uint64, len(distinct)), coded.indices.to_numpy()


def tallied(code: np.ndarray, wanted: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct wanted codes of each stream, how often it has each, the streams' bounds therein)."""
    at = np.nonzero(wanted)[0]
    row = np.searchsorted(edges, at, "right") - 1
    order = np.lexsort((code[at], row))
    keys, row = code[at][order], row[order]
    start = np.nonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])]))[0] if len(keys) else np.zeros(0, np.int64)
    lots = np.searchsorted(row[start], np.arange(len(edges))).astype(np.int32)
    return keys[start].view(np.int64), np.diff(np.append(start, len(keys))), lots


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, n, len(unique)).astype(np.int64)


class Trie:
    """Followers of all contexts, and the logarithms that coding needs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int):
        self.order, self.made_of = order, (keys, counts)
        self.levels = []  # from the empty context up: (places of grams, counts, places of contexts, sums, followers)
        for j in range(order + 1):
            low = np.uint64((1 << 8 * (j + 1)) - 1)
            gram, n = summed(keys & low, counts)
            context, start = np.unique(gram >> np.uint64(8), return_index=True)
            followers = np.diff(np.append(start, len(gram)))
            total = np.add.reduceat(n, start) if len(gram) else n
            level = {"gram": Places(gram), "log": np.log(np.maximum(n, 1)), "context": Places(context)}
            if j:
                below = self.levels[-1]
                mass = np.add.reduceat(below["n"][below["gram"].find(gram & (low >> np.uint64(8)))], start) if len(gram) else n
                at = below["context"].find(context & (low >> np.uint64(16)) if j > 1 else np.zeros_like(context))
                rest, other = below["total"][at] - mass, below["followers"][at] - followers
                # what a byte refused here meets in the next shorter context, these followers excluded
                level["down"] = np.log(np.maximum(rest + other, 1))
                level["down_escape"] = np.where(rest + other > 0, np.log(np.maximum(other, 1)) - level["down"], 0.0)
            level |= {"n": n, "total": total, "followers": followers, "whole": np.log(np.maximum(total + followers, 1))}
            level["escape"] = np.log(np.maximum(followers, 1)) - level["whole"]
            self.levels.append(level)
        self.last = -np.log(max(1, 256 - (int(self.levels[0]["followers"][0]) if len(keys) else 0)))
        top = self.levels[-1]
        of = top["context"].find(self.top_contexts(keys)) if len(keys) else np.zeros(0, np.int32)
        self.hit = (np.log(np.maximum(top["n"], 1)) - top["whole"][of]).astype(np.float32) if len(keys) else np.zeros(0, np.float32)
        for level in self.levels:
            del level["n"], level["total"], level["followers"]

    def __reduce__(self):
        return Trie, (*self.made_of, self.order)  # what is sent are the counts; each worker makes its own tables

    def top_contexts(self, keys: np.ndarray) -> np.ndarray:
        return np.unique(keys) >> np.uint64(8)

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each byte in its context."""
        place = self.levels[-1]["gram"].find(codes)
        out = np.zeros(len(codes))
        known = place >= 0
        out[known] = self.hit[place[known]]
        todo = np.nonzero(~known)[0]
        codes = codes[todo]
        came = np.full(len(todo), -1, np.int64)  # place of the longer context that refused the byte; -1: it was unseen
        total = np.zeros(len(todo))
        active = np.arange(len(todo))
        for j in range(self.order, -1, -1):
            level = self.levels[j]
            code = codes[active] & np.uint64((1 << 8 * (j + 1)) - 1)
            context = level["context"].find(code >> np.uint64(8)).astype(np.int64)
            whole, escape = np.zeros(len(active)), np.zeros(len(active))
            seen = context >= 0
            whole[seen], escape[seen] = level["whole"][context[seen]], level["escape"][context[seen]]
            if j < self.order:
                longer = came[active]
                from_above = longer >= 0
                whole[from_above] = self.levels[j + 1]["down"][longer[from_above]]
                escape[from_above] = self.levels[j + 1]["down_escape"][longer[from_above]]
            gram = level["gram"].find(code)
            found = gram >= 0
            total[active[found]] += level["log"][gram[found]] - whole[found]
            total[active[~found]] += escape[~found]
            came[active] = context
            active = active[~found]
            if not len(active):
                break
        total[active] += self.last
        out[todo] = total
        return out


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct ones of sorted keys, where each begins)."""
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    start = np.nonzero(first)[0]
    return keys[start], start


class Tally:
    """Counts of keys, put together whenever what came since the last time is as many: so they take a few times what the
    distinct keys take, however many slices they come from."""

    def __init__(self):
        self.keys, self.n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(keys)
        self.n.append(n)
        if sum(map(len, self.keys[1:])) >= max(len(self.keys[0]), 1 << 18):
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            keys, n = np.concatenate(self.keys), np.concatenate(self.n)
            self.keys, self.n = [], []
            order = np.argsort(keys)
            keys, start = runs(keys[order])
            self.keys, self.n = [keys], [np.add.reduceat(n[order], start) if len(start) else n]
        return self.keys[0], self.n[0]


def tallies(batches: Iterator[pa.RecordBatch], text_col: str, order: int) -> Iterator[pa.RecordBatch]:
    """(kind, key, n) of the texts of each batch, as ``gather`` has them."""
    for batch in batches:
        held = {0: Tally(), 1: Tally()}
        for b in sliced(batch, text_col, SLICE):
            words, _, stream, bounds = streams(b.column(0), order)
            distinct, index = hashes(words)
            held[0].add(distinct, np.bincount(index, minlength=len(distinct)))
            code = grams(stream, bounds, order)[0]
            code.sort()
            keys, start = runs(code)
            held[1].add(keys, np.diff(np.append(start, len(code))))
            del words, stream, distinct, index, code, keys, start  # else they stay while the next slice is read
        for kind in list(held):
            keys, n = held.pop(kind).sums()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])
            del keys, n
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0]), pa.array([batch.num_rows])], ["kind", "key", "n"])


def gather(docs: DataFrame, text_col: str, order: int) -> DataFrame:
    """(kind, key, n): kind 1 for grams, 0 for word hashes; kind 2 counts documents. Summed over tasks, written."""
    parts = docs.select(text_col).mapInArrow(lambda batches: tallies(batches, text_col, order), "kind int, key long, n long")
    return keep(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def learn(counts: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """(grams, contexts) of each order from the empty context up, as written tables.

    grams: key, n. contexts: context, total, followers, and from order 1 on what a byte refused here meets in the next
    shorter context, these followers excluded: left, other (counts and followers). A context has at most 256 followers.
    """
    grams = [counts.where("kind = 1").select("key", "n")]
    for j in range(order - 1, -1, -1):
        shorter = grams[0].groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        grams.insert(0, keep(shorter, f"grams{j}"))
    contexts = []
    for j, table in enumerate(grams):
        here = table.select("key", "n", F.shiftright("key", 8).alias("context"))
        sums = [F.sum("n").alias("total"), F.count("*").alias("followers")]
        if not j:
            contexts.append(keep(here.groupBy("context").agg(*sums), "contexts0"))
            continue
        below = small(grams[j - 1].select(F.col("key").alias("__key"), F.col("n").alias("__n")), j)
        here = here.join(below, F.col("key").bitwiseAND(F.lit((1 << 8 * j) - 1)) == F.col("__key"))
        found = here.groupBy("context").agg(*sums, F.sum("__n").alias("__mass"))
        under = small(contexts[j - 1].select(F.col("context").alias("__context"), F.col("total").alias("__total"), F.col("followers").alias("__followers")), j - 1)
        found = found.join(under, F.col("context").bitwiseAND(F.lit((1 << 8 * (j - 1)) - 1)) == F.col("__context"))
        left, other = (F.col("__total") - F.col("__mass")).alias("left"), (F.col("__followers") - F.col("followers")).alias("other")
        contexts.append(keep(found.select("context", "total", "followers", left, other), f"contexts{j}"))
    return grams, contexts


def small(table: DataFrame, width: int) -> DataFrame:
    """A table keyed by so many bytes: sent whole where it has 65,536 rows at most by nature, as its keys are hot."""
    return F.broadcast(table) if width <= 2 else table


def costs(codes: DataFrame, grams: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """(key, log): the natural logarithm of the probability of each distinct gram (column key); Trie.logs over tables."""
    order = len(grams) - 1
    zero, none = F.lit(0.0), F.lit(None).cast("long")
    now = codes.select("key", zero.alias("log"), F.lit(False).alias("done"), none.alias("left"), none.alias("other"))
    for j in range(order, -1, -1):
        gram, context = F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)), F.shiftright(F.col("key"), 8).bitwiseAND(F.lit((1 << 8 * j) - 1))
        bounds = [F.col("left").alias("__left"), F.col("other").alias("__other")] if j else [none.alias("__left"), none.alias("__other")]
        now = now.join(small(grams[j].select(F.col("key").alias("__key"), "n"), j + 1), gram == F.col("__key"), "left")
        named = contexts[j].select(F.col("context").alias("__context"), "total", "followers", *bounds)
        now = now.join(small(named, j), context == F.col("__context"), "left")
        # left is null where no longer context has refused the byte; both are null where this context is unseen too
        seats = F.coalesce("other", "followers")
        whole = F.log(F.greatest(F.coalesce("left", "total") + seats, F.lit(1)).cast("double"))
        escape = F.when(F.coalesce("left", "total") + seats > 0, F.log(F.greatest(seats, F.lit(1)).cast("double")) - whole)
        step = F.when(F.col("n").isNotNull(), F.log(F.col("n").cast("double")) - whole).otherwise(F.coalesce(escape, zero))
        log = F.col("log") + F.when(F.col("done"), zero).otherwise(step)
        now = now.select("key", log.alias("log"), (F.col("done") | F.col("n").isNotNull()).alias("done"), F.col("__left").alias("left"), F.col("__other").alias("other"))
    seen = contexts[0].agg(F.coalesce(F.max("followers"), F.lit(0)).alias("__seen"))  # one row
    last = -F.log(F.greatest(F.lit(256) - F.col("__seen"), F.lit(1)).cast("double"))
    return now.crossJoin(F.broadcast(seen)).select("key", (F.col("log") + F.when(F.col("done"), zero).otherwise(last)).alias("log"))


def hits(grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """(key, n, log) of the longest grams that were learned."""
    named = contexts.select(F.col("context").alias("__context"), (F.col("total") + F.col("followers")).alias("__whole"))
    found = grams.join(named, F.shiftright("key", 8) == F.col("__context"))
    return found.select("key", "n", (F.log(F.col("n").cast("double")) - F.log(F.col("__whole").cast("double"))).alias("log"))


def rarest(grams: DataFrame, entries: int) -> int:
    """The least count such that at most so many grams have it or more. Collects a row for each different count: their
    number grows with the root of the text's size."""
    held = 0
    for n, grams_ in sorted(grams.groupBy("n").count().collect(), reverse=True):
        held += grams_
        if held > entries:
            return n + 1
    return 0


def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, hot: int = HOT, entries: int = ENTRIES) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; logarithms to base 10.

    training is a condition over docs; rows where it is null are trained on. Tokens are the words and one end. Null and
    empty texts are the end alone; texts of any length are scored whole, a long row by itself; rows that repeat an id are scored alone; without training rows every byte is one of
    256 and no token is known. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held_out = ~F.coalesce(training, F.lit(True))
    counts = gather(docs.where(~held_out), text_col, order)
    totals = {r[0]: (r[1], r[2]) for r in counts.groupBy("kind").agg(F.sum("n"), F.count("*")).collect()}
    ends = totals.get(2, (0, 0))[0]
    tokens, kinds = totals.get(0, (0, 0))[0] + ends, totals.get(0, (0, 0))[1] + (ends > 0)
    grams_, contexts = learn(counts, order)
    top = hits(grams_[-1], contexts[-1]).where(F.col("n") >= rarest(grams_[-1], entries)).select("key", "log").toArrow()
    codes = top.column(0).to_numpy().view(np.uint64)
    words = counts.where("kind = 0").select("key", "n")
    common = words.orderBy(F.desc("n"), "key").limit(hot).toArrow()
    log_all = float(np.log10(max(tokens + 0.5 * (kinds + 1), 1)))
    keys = common.column(0).to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast((codes, top.column(1).to_numpy(), Places(keys), np.log10(common.column(1).to_numpy() + 0.5) - log_all))
    end_log = float(np.log10(ends + 0.5)) - log_all
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["__row", id_col, "held_out", "n_tokens", "known", "base", "score", "rare", "missed", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, costs_, places, logs = sent.value
        cached = Places(codes)
        numbers = count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            for b in sliced(batch, text_col, SLICE):
                found, lengths, stream, bounds = streams(b.column(1), order)
                code, edges = grams(stream, bounds, order)
                del stream
                at = cached.find(code)
                sums = np.add.reduceat(np.where(at >= 0, costs_[at] if len(costs_) else 0.0, 0.0), edges[:-1])
                missed, times, lots = tallied(code, at < 0, edges)
                del code, at
                distinct, index = hashes(found)
                place = places.find(distinct)[index]
                row = np.repeat(np.arange(b.num_rows), lengths)
                is_hot = place >= 0
                base = np.bincount(row[is_hot], logs[place[is_hot]], b.num_rows) + end_log
                known = np.bincount(row[is_hot], minlength=b.num_rows) + (ends > 0)
                rare = np.bincount(row[~is_hot], minlength=b.num_rows)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(rare)]).astype(np.int32), distinct[index[~is_hot]].view(np.int64))
                ids = pa.array([next(numbers) for _ in range(b.num_rows)], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, b.column(0), b.column(2), pa.array(lengths + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(sums), lists, *(pa.ListArray.from_arrays(lots, x) for x in (missed, times))], names)

    schema = f"__row long, `{id_col}` {kind}, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, missed array<long>, times array<long>"
    rows = keep(docs.select(id_col, text_col, held_out.alias("held_out")).mapInArrow(run, schema), "scores")
    rare = rows.select("__row", F.explode("rare").alias("key")).join(words, "key", "left")
    more = rare.groupBy("__row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5) - log_all).alias("__base"), F.count("n").alias("__known"))
    missed = rows.select("__row", F.explode(F.arrays_zip("missed", "times")).alias("x")).select("__row", F.col("x.missed").alias("key"), F.col("x.times").alias("times"))
    priced = keep(costs(missed.select("key").distinct(), grams_, contexts), "costs")
    cost = missed.join(priced, "key").groupBy("__row").agg(F.sum(F.col("times") * F.col("log")).alias("__cost"))
    out = rows.drop("rare", "missed", "times").join(more, "__row", "left").join(cost, "__row", "left")
    zero = F.lit(0)
    return out.select(
        id_col, "held_out", "n_tokens", (F.col("known") + F.coalesce("__known", zero)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("__base", zero.cast("double"))).alias("base_score"),
        ((F.col("score") + F.coalesce("__cost", zero.cast("double"))) / LN10).alias("score"),
    )


def adaptive(text: bytes, order: int = ORDER) -> float:
    """Bits of a byte string under a trie that starts empty and learns each byte after coding it."""
    trie: dict[bytes, dict[int, int]] = defaultdict(dict)
    bits = 0.0
    for at, byte in enumerate(text):
        refused: set[int] = set()
        for n in range(min(order, at), -1, -1):
            seen = {s: c for s, c in trie[text[at - n : at]].items() if s not in refused}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if byte in seen:
                bits -= np.log2(seen[byte] / whole)
                break
            bits -= np.log2(len(seen) / whole)
            refused |= seen.keys()
        else:
            bits += np.log2(256 - len(refused))
        for n in range(min(order, at) + 1):
            follow = trie[text[at - n : at]]
            follow[byte] = follow.get(byte, 0) + 1
    return float(bits)


def digest(docs: DataFrame) -> DataFrame:
    """Scores of every document by a trie learned from those whose crc32 of the id modulo 5 is not 1."""
    return score(docs, crc_mod("doc_id", 5) != 1)
