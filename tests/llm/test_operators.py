"""The training-data operators against brute force, and on nulls, empty texts, ties, repeated rows and empty tables."""

import os
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestia.llm import ann, bpe, langid, mixing, packing, ppm, simhash, substring_dedup, token_count, topk, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"
PATH = public_tokenizers.path("word_bpe_49k.json")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    shared = prose(1, 60)
    rows = [
        (1, prose(2, 30) + " " + shared + " " + prose(3, 30)), (2, prose(4, 20) + "\n" + shared + " " + prose(5, 10)), (3, prose(6, 80)), (4, prose(6, 80)), (4, prose(6, 80)),
        (5, None), (6, ""), (7, "a"), (None, prose(7, 70)), (8, " \t\n"), (9, prose(8, 3000)), (10, "1 2 3 !!"), (11, prose(6, 80).upper()),
    ]
    return spark.createDataFrame([(i, t, "xy"[k % 2] if t else None, [None, "s1", "s2"][k % 3], 0, "clash") for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_passages_of_all_shapes_against_brute_force(spark):
    rng = random.Random(11)
    fresh = iter(range(10**6))
    unique = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    rows: list[list[str]] = []
    for k in range(60):
        shared = unique(52 + k)
        rows.append(unique(k) + shared + unique(30))
        rows.append(unique(70 - k) + shared + unique(k % 7))
    notice = unique(55)
    rows += [unique(20 + k % 30) + notice + unique(25) for k in range(150)]
    damaged = []
    for k in range(30):
        base = unique(120)
        changed = list(base)
        for at in rng.sample(range(0, 120, 30), 2):
            changed[at] = next(iter(unique(1)))
        damaged.append(len(rows) + 1)
        rows += [unique(10) + base, changed + unique(10)]
    clean = len(rows)
    rows += [unique(150) for _ in range(60)]
    runs: dict[tuple, int] = {}
    repeated = set()
    for k, words in enumerate(rows):
        for at in range(len(words) - 49):
            if runs.setdefault(tuple(words[at : at + 50]), k) != k:
                repeated.add(k)
    assert len(repeated) > 200
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string").repartition(4)
    found = substring_dedup.digest(docs).collect()
    named = {r.doc_id for r in found}
    assert repeated <= named and set(damaged) <= named and not named & set(range(clean, len(rows)))
    for r in found:
        a, b = rows[r.doc_id][r.start : r.start + r.words], rows[r.other_id][r.other_start : r.other_start + r.other_words]
        one, two = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        assert r.other_id < r.doc_id and len(a) == r.words >= 50 and abs(len(one & two) / len(one | two) - r.similarity) < 1e-9 and r.similarity >= 0.8


def test_texts_that_many_ask_are_read_in_parts(spark, monkeypatch):
    shared = prose(1, 60)
    docs = spark.createDataFrame([(k, f"{prose(100 + k, 20)} {shared} {prose(200 + k, 20)}") for k in range(40)], "doc_id long, text string")
    whole = sorted(map(tuple, substring_dedup.digest(docs).collect()))
    monkeypatch.setattr(substring_dedup, "ASKS", 3)
    assert sorted(map(tuple, substring_dedup.digest(docs).collect())) == whole and {r[0] for r in whole} == set(range(1, 40))


def test_substring_dedup(docs, none):
    found = substring_dedup.digest(docs).collect()
    pair = next(r for r in found if (r.doc_id, r.other_id) == (2, 1))
    assert abs(pair.start - 20) <= 1 and abs(pair.words - 60) <= 2
    assert {r.doc_id for r in found} == {2, 4, 11}  # equal rows of one id are one
    assert substring_dedup.digest(none).count() == 0
    left = {r.doc_id: r.text for r in substring_dedup.remove(docs).collect()}
    assert len(left[1].split()) == 120 and abs(len(left[2].split()) - 30) <= 2 and 4 not in left and 5 in left
    assert substring_dedup.remove(docs).columns == docs.columns


def test_every_round_of_a_passage_goes(spark):
    notice, apart = prose(41, 60), prose(42, 100)
    rows = [(1, prose(43, 90) + " " + notice), (2, prose(44, 40) + " " + " ".join([notice] * 3)), (3, prose(45, 40) + f" {notice} {apart} {notice} " + prose(46, 40))]
    left = {r.doc_id: r.text.split() for r in substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(left[1]) == 150 and abs(len(left[2]) - 40) <= 2 and abs(len(left[3]) - 180) <= 4


def test_windows_cover_every_subsequence():
    rng = np.random.default_rng(0)
    code = rng.integers(1, 1 << 60, 60).astype(np.uint64)
    lengths = np.array([25, 0, 35])
    low, c, high = substring_dedup.windows(code, lengths, substring_dedup.repeats(code, lengths), 0, 8)
    v = substring_dedup.mix64(code, 1)
    for a, b in [(0, 25), (25, 60)]:
        for i in range(a, b - 7):
            for j in range(i + 7, b):
                held = [(l, m, r) for l, m, r in zip(low, c, high) if l <= i <= m <= j <= r]
                assert len(held) == 1 and held[0][1] == i + v[i : j + 1].argmin()


def vectors(spark, n=300, d=16):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(d).tolist(), "x") for k in range(n)]
    rows += [(n + 50, rows[0][1], "x"), (n + 51, None, "x"), (n + 52, [], "x"), (n + 53, [0.0] * d, "x"), (n + 54, [float("nan")] * d, "x"), (n + 55, [None] * d, "x"), (None, rows[1][1], "x")]
    rows += [(400, [1.0], "x"), (401, [0.5], "x"), (450, [2.0, 1.0, 0.5], "x")]  # few of other lengths
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def nearest_by_hand(rows, q, v, k):
    return sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in rows if j != q and len(w) == len(v))[:k]


def test_neighbours(spark):
    frame = vectors(spark)
    rows = [(r.vec_id, np.array(r.embedding)) for r in frame.collect() if r.vec_id is not None and (r.vec_id < 300 or r.vec_id in (350, 400, 401, 450))]
    hit = total = 0
    found = ann.nearest(frame, F.col("__id") % 50 == 0, 10, tile=100).collect()
    for q, v in rows:
        if q % 50 == 0:
            want = nearest_by_hand(rows, q, v, 10)
            got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
            hit += len({k for _, k in want} & {k for _, k, _ in got})
            total += len(want)
            assert [x[0] for x in got] == list(range(1, len(want) + 1)) and got == sorted(got, key=lambda x: (x[2], x[1]))
    assert hit / total >= 0.95 and [(r.query_id, r.vec_id) for r in found if r.query_id >= 400] == [(400, 401)]
    assert ann.nearest(frame.where("false"), F.lit(True)).count() == 0


def test_codes_tell_most_vectors_apart():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((2000, 64))
    codes, lengths, dots = ann.encode(v, np.zeros(64), ann.rotation(64, 0))
    seen = 0
    for q in range(20):
        unit = v[q] / np.sqrt((v[q] ** 2).sum())
        found, error = ann.estimates(codes, dots, unit @ ann.rotation(64, 0), 2.5)
        true = v @ unit / lengths
        assert (np.abs(found - true) <= error).mean() > 0.97
        limit = np.sort(true)[-11]
        seen += int((found + error >= limit).sum())
    assert seen < 0.3 * 20 * 2000


def test_top_inner(spark):
    frame = vectors(spark)
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding)).astype(int)) for r in frame.collect() if r.vec_id is not None and (r.vec_id < 300 or r.vec_id in (350, 353, 400, 401, 450))]
    found = topk.top_inner(frame, F.col("__id") % 50 == 0, 5, tile=100).collect()
    for q, v in rows:
        if q % 50 == 0:
            want = sorted((-int(v @ w), k) for k, w in rows if k != q and len(w) == len(v))[:5]
            assert [(-r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == want
    assert topk.top_inner(frame.where("false"), F.lit(True)).count() == 0


def test_top_inner_beyond_64_bits(spark):
    rows = [(0, [1e18, -1e18]), (1, [1e18, 0.0]), (2, [0.0, 1e18]), (3, [-1.0, 0.0]), (4, [3.0, 2.0]), (5, [3.0, 2.0])]
    found = topk.top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("__id") == 0, 5).collect()
    most, least = 2**63 - 1, -(2**63)
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [(1, most), (4, most), (5, most), (2, least), (3, least)]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(1, 7), st.integers(0, 10**6), st.integers(0, 12), st.booleans())
def test_reading_keeps_the_best(n, d, k, seed, resolve, limited):
    rng = np.random.default_rng(seed)
    v, query = rng.integers(-4, 5, (n, d)).astype(float), rng.integers(-3, 4, d).astype(float)
    out = rng.random(n) < 0.1
    exact = np.where(out, -np.inf, v @ query)
    others = int((~out).sum())
    limit = np.sort(exact)[-min(k, others)] if others else -np.inf
    may, entries = topk.Lists(v).read(query, out, k, resolve, limit if limited else -np.inf)
    assert not out[may].any() and entries <= n * d and len(may) >= min(k, others)
    assert set(np.nonzero((exact >= limit) & ~out)[0].tolist()) <= set(may.tolist())


def test_reading_stops_early_on_a_skewed_table():
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.standard_normal((4096, 64)) * 0.7 ** np.arange(64))
    lists, shares = topk.Lists(v), []
    for q in range(40):
        exact = np.where(np.arange(4096) == q, -np.inf, v @ v[q])
        may, entries = lists.read(v[q], np.arange(4096) == q, 5, 80, np.sort(exact)[-5])
        assert set(np.argsort(exact)[-5:].tolist()) <= set(may.tolist())
        shares.append(entries / v.size)
    assert np.mean(shares) < 0.6


def test_mixing(docs, none):
    found = mixing.digest(docs).collect()
    assert len(found) == docs.count() and mixing.digest(none).count() == 0
    assert all(r.taken <= 3 * r.size for r in found) and all(r.size == 0 for r in found if r.doc_id in (5, 6, 8))
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, mixing.digest(docs).collect()), key=repr)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.targets([10, 100, 0], [1, 2, 3]) == [30.0, 80.0, 0.0]


def test_mix_takes_rows_of_one_id_each_by_its_lot(spark):
    rows = [(None if k % 2 else 7, prose(k, 5 + k % 9), "abc"[k % 3 if k < 30 else 0]) for k in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    taken = dict.fromkeys("abc", 0)
    for r in mixing.mix(table).collect():
        taken[r.source] += len(r.text.split())
    sizes = [sum(len(t.split()) for _, t, s in rows if s == x) for x in "abc"]
    goals = mixing.targets(sizes, [1, 2, 3])
    assert sum(taken.values()) == sum(r.taken for r in mixing.digest(table).collect())
    assert all(g - 14 <= taken[x] <= g + 1 for x, g in zip("abc", goals))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=6), st.floats(0, 1))
def test_fit_is_the_nearest_sum(lengths, share):
    n, c = np.array(list(lengths), np.int64), np.array(list(lengths.values()), np.int64)
    budget = int(share * (n * c).sum())
    taken = mixing.fit(n, c, budget)
    sums = {0}
    for k, m in lengths.items():
        sums = {s + j * k for s in sums for j in range(m + 1)}
    assert (taken >= 0).all() and (taken <= c).all() and int((taken * n).sum()) == max(s for s in sums if s <= budget)


def test_language(spark, none):
    def text(k, letters):
        rng = np.random.default_rng(k)
        return " ".join("".join(rng.choice(list(letters), 4)) for _ in range(30))

    rows = [(k, text(k, "abcde" if k % 2 else "éèàxyz"), "en" if k % 2 else "fr") for k in range(240)] + [(900, None, "en"), (901, "12 !?", None), (902, "", "en"), (None, text(7, "abcde"), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    found = {r.doc_id: r for r in langid.digest(frame).collect()}
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(found[k].lang_pred == rows[k][2] for k in held) >= 0.98 * len(held) and all(found[k].held_out for k in held)
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (900, 901, 902)) and found[None].lang_pred == "en"
    assert langid.digest(frame.where("false")).count() == 0
    assert langid.keep_accepted(frame, langid.fit(frame)).columns == frame.columns


def test_predictions_are_the_weights_argmax(spark):
    """The model applied by hand: every run of two to four bytes, looked up one by one."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc de" if k % 2 else "éx yz,1"), 80)) for k in range(120)] + ["a", "É", "x" * 5000]
    model = langid.train([t.encode() for t in texts[:100]], ["one" if k % 2 else "two" for k in range(100)], epochs=2)
    for text in texts:
        low = bytes(langid.LETTERS[b] for b in (" " + text + " ").encode())
        while b"  " in low:
            low = low.replace(b"  ", b" ")
        total = np.zeros(2)
        places = []
        for n in langid.RUNS:
            for at in range(len(low) - n + 1):
                code = int.from_bytes(low[at : at + n])
                places.append(((code * 0x9E3779B1 + n * 0x85EBCA6B) & 0xFFFFFFFF) >> 17)
        for place in places:
            total = total + model.weights[place].astype(float)
        z = total / max(1, len(places)) + model.bias
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        got = model.probabilities([text.encode()])[0]
        assert np.allclose(got, want, atol=1e-5) and (abs(want[0] - want[1]) < 1e-4 or got.argmax() == want.argmax())
    names, scores, good = langid.guess(model, [t.encode() for t in texts])
    assert (good == (scores >= model.threshold)).all()


def test_the_mix_takes_the_nearest_sums(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.choice([0, 3, 5, 8, 13])), rng.choice(["a", "b", "c", None])) for k in range(50)]
    found = mixing.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size = {k: len(t.split()) for k, t, _ in rows}
    of = {k: s for k, _, s in rows}
    names = ["a", "b", "c", None]
    sizes = [sum(size[k] for k in size if of[k] == s) for s in names]
    for s, whole, goal in zip(names, sizes, mixing.targets(sizes, [1, 2, 3, 1])):
        mine = [r for r in found if of[r.doc_id] == s]
        assert all(r.size == size[r.doc_id] and r.source_size == whole and abs(r.target - goal) < 1e-6 and r.taken in {n * r.size for n in range(4)} for r in mine)
        rounds, budget = min(int(round(goal)) // whole, 3), int(round(goal))
        sums = {rounds * whole}
        for r in mine:  # each document once more, or not
            sums |= {x + r.size for x in sums if rounds < 3}
        assert sum(r.taken for r in mine) == max(x for x in sums if x <= budget)


def test_a_very_long_text(spark):
    words = prose(77, 60_000)
    rows = [(1, words, "xy", "s", 0), (2, words[:3000] + " and more", "xy", "s", 0), (3, prose(78, 100), "zz", "t", 0), (4, "a" * 2000, "zz", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.doc_id, r.other_id) for r in substring_dedup.digest(docs).collect()} == {(2, 1)}
    assert {r.doc_id: r.size for r in mixing.digest(docs).collect()}[1] == 60_000
    assert {r.doc_id: r.lang_pred for r in langid.digest(docs).collect()}.keys() == {1, 2, 3, 4}
    packed = packing.pack(docs, PATH).collect()
    assert sum(r.length for r in packed if r.doc_id == 1) == next(r.doc_tokens for r in packed if r.doc_id == 1) > 60_000
    assert {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4} and simhash.components(docs).count() == 4
    args = (token_count.revision, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    long = next(r for r in token_count.recount(docs, *args).collect() if r.doc_id == 1)
    assert long.tokens_before == len(COUNTER.encoding.encode_ordinary(words)) and long.chars_encoded < 1000
    assert {r.doc_id: r.n_tokens for r in ppm.digest(docs).collect()}[1] == 60_001


def test_packing(docs, none):
    found = packing.pack(docs.coalesce(1), PATH, longest=64, lot=500, with_ids=True).collect()
    library = Tokenizer.from_file(PATH)
    whole = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    places = {}
    for r in found:
        ids = whole[r.doc_id]
        assert r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 == zlib.crc32(r.ids)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        pieces.sort()
        n = sum(x for _, x in pieces)
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [x for _, x in pieces])[:-1]) and n <= 64 and n & (n - 1) == 0
    assert sum(r.length for r in found) == sum(len(whole[r.doc_id]) for r in docs.collect())
    assert packing.pack(none, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from("  \n\t'sé.<|>"), max_size=40), min_size=1, max_size=4))
def test_encoder_is_the_library(texts):
    encoder = bpe.load(PATH)
    ids, lengths = encoder.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_simhash(docs, none):
    found = simhash.components(docs).collect()
    points = [int(r.fingerprint, 16) for r in found]
    group = list(range(len(points)))
    for _ in points:
        group = [min(group[j] for j in range(len(points)) if (points[i] ^ points[j]).bit_count() <= 4) for i in range(len(points))]
    ids = [r.doc_id for r in found]
    for k, r in enumerate(found):
        assert r.component_id == min((i for i, g in zip(ids, group) if g == group[k] and i is not None), default=None)
    assert {r.doc_id: r.component_id for r in found}[11] == 3 and {r.doc_id: r.fingerprint for r in found}[5] == "0" * 16
    assert simhash.components(none).count() == 0
    kept = [r.doc_id for r in simhash.firsts(docs).collect()]
    assert kept.count(3) == 1 and 4 not in kept and 11 not in kept and simhash.firsts(docs).columns == docs.columns


def test_firsts_of_rows_that_share_an_id(spark):
    texts = [(None, prose(31, 80)), (None, prose(32, 80)), (None, prose(32, 80)), (1, prose(33, 80)), (5, prose(34, 80)), (5, prose(33, 80)), (5, prose(34, 80))]
    kept = simhash.firsts(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted({texts[0], texts[1], texts[3], texts[4]}, key=repr)


def test_close_pairs_connect_all():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    points = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)) for _ in range(6)]))
    a, b = simhash.close_pairs(points, 4, block=16)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    every = {(x, y) for x in points.tolist() for y in points.tolist() if x < y and (x ^ y).bit_count() <= 4}
    met = set()
    for tree in simhash.forest(100_000, 4, 3, leaf=10):
        leaves, at = tree.route(points)
        shards: dict[int, list[int]] = {}
        for leaf, x in zip(leaves.tolist(), points[at].tolist()):
            shards.setdefault(leaf, []).append(x)
        assert len(shards) > 100
        met |= {(x, y) for held in shards.values() for x in held for y in held if x < y} & every
    assert met == every and len(every) > 100


def test_small_leaves_change_nothing(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    points = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40), base ^ np.uint64(0b10111)])).view(np.int64)
    frame = spark.createDataFrame([(int(x),) for x in points], "__fp long")
    found = []
    for leaf in (4, 1 << 20):
        roots = {r.node: r.root for r in simhash.closed(simhash.stars(simhash.links(frame, 4, leaf))).collect()}
        found.append(roots)
    assert found[0] == found[1] and len(set(found[0].values())) <= 300


def test_urls(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/")]
    urls = {
        "http://A.Example.com/en/1": ("com/en/", "block"), "https://example.com/en/72?q": ("example.com/en/7", "allow"), "http://com/en/": ("com/en/", "block"), "//com/en/": (None, "allow"),
        "http://xcom/en/": (None, "allow"), "http://a.net/de/x#y": ("net/de/", "allow"), "http://a.net": (None, "allow"), "": (None, "allow"), "x://com?/en/": (None, "allow"),
    }
    rows = [(k, u, "x") for k, u in enumerate(urls)] + [(99, None, "x"), (0, next(iter(urls)), "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = url_filter.judge(frame, rules).collect()
    assert len(found) == len(rows) and {(r.page_id, r.rule, r.verdict) for r in found} == {(k, *x) for k, x in enumerate(urls.values())} | {(99, None, "allow")}
    assert url_filter.judge(frame.where("false"), rules).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 500])
def test_cascade_is_exact(spark, most):
    universe = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    keys = np.array([r[0] for r in universe.collect()], np.int64).view(np.uint64)
    cascade = url_filter.build(keys[::7], universe, 4 if most > 500 else 10, most)
    parts = [p.value for p in cascade.parts]
    assert len(parts) == (1 if most > 500 else 16) and max(len(p.levels) for p in parts) > 2 and (cascade.has(keys) == np.isin(keys, keys[::7])).all()


def test_urls_under_a_long_list(spark):
    rules = [("block" if k % 3 else "allow", f"h{k % 40}.example", f"/{k}") for k in range(900)]
    rows = [(k, f"http://a.h{k % 40}.example/{k}/x") for k in range(1200)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(frame, rules, most=128).collect()}
    for k, url in rows:
        fits = [(len(h + p), h + p, v) for v, h, p in rules if h == f"h{k % 40}.example" and f"/{k}/x".startswith(p)]
        assert found[k] == (max(fits)[1:] if fits else (None, "allow"))


COUNTER = token_count.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
TEXT = st.text(st.sampled_from("ab's  \n\té1.,'ll"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 70), st.integers(0, 20), TEXT), max_size=4))
def test_edits_count_as_from_scratch(text, edits):
    segments = token_count.CUT.split(text) if text else []
    tree = token_count.Tree(segments, COUNTER.of(segments))
    for start, removed, new in edits:
        a, b = token_count.clip(start, removed, len(text))
        text = text[:a] + new + text[b:]
        assert tree.replace(a, b, new, COUNTER) == len(COUNTER.encoding.encode_ordinary(text)) and tree.text() == text


def test_many_edits_keep_the_tree_right():
    rng = random.Random(2)
    text = prose(3, 4000)
    segments = token_count.CUT.split(text)
    tree = token_count.Tree(segments, COUNTER.of(segments))
    for _ in range(300):
        a = rng.randrange(len(text))
        b, new = min(len(text), a + rng.randrange(60)), " ".join(rng.choices(["one", "two\n", " x", "e9"], k=rng.randrange(5)))
        text = text[:a] + new + text[b:]
        tree.replace(a, b, new, COUNTER)
        assert tree.root.depth <= token_count.DEEP
    assert tree.text() == text and tree.chars == len(text) and tree.total == len(COUNTER.encoding.encode_ordinary(text)) and tree.encoded < 300 * 300


def test_recount(docs, none):
    args = (token_count.revision, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = sorted(token_count.recount(docs, *args).collect(), key=repr)
    assert len(found) == docs.count() and {r.tokens_before for r in found if r.doc_id in (5, 6)} == {0}
    long = next(r for r in found if r.doc_id == 9)
    assert long.chars_encoded < long.chars_before / 20
    want = []
    for r in docs.select("doc_id", "text", token_count.revision().alias("edits")).collect():
        text = r.text or ""
        before = text
        for e in r.edits:
            a, b = token_count.clip(e.start, e.removed, len(text))
            text = text[:a] + e.inserted + text[b:]
        count = lambda s: len(COUNTER.encoding.encode_ordinary(s))
        want.append((repr(r.doc_id), count(before), count(text), len(before), len(text)))
    assert sorted((repr(r.doc_id), *r[1:5]) for r in found) == sorted(want)
    assert token_count.recount(none, *args).count() == 0


def test_trees_serve_later_revisions(docs):
    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    trees = token_count.build(docs, *ranks)
    once = token_count.edited(trees, token_count.revision("doc_id", "__text"), *ranks)
    twice = token_count.edited(once, F.array(F.struct(F.lit(3).alias("start"), F.lit(2).alias("removed"), F.lit("and so").alias("inserted"))), *ranks).collect()
    for r in twice:
        assert r.tokens_after == len(COUNTER.encoding.encode_ordinary(r["__text"])) == sum(r["__tokens"]) and sum(r["__chars"]) == len(r["__text"])


def test_ppm_sums_to_one_and_scores(docs, none):
    texts = [prose(k, 40) for k in range(5)]
    _, _, stream, bounds = ppm.streams(pa.array(texts), 3)
    keys, n = np.unique(ppm.grams(stream, bounds, 3)[0], return_counts=True)
    trie = ppm.Trie(keys, n, 3)
    for context in (b"\0\0\0", b"abc", b"zzz", b" ab"):
        codes = np.array([int.from_bytes(context + bytes([s])) for s in range(256)], np.uint64)
        assert abs(np.exp(trie.logs(codes)).sum() - 1) < 1e-4
    found = ppm.digest(docs).collect()
    assert len(found) == docs.count() and all(r.n_tokens == 1 for r in found if r.doc_id in (5, 6, 8)) and all(r.score < 0 for r in found)
    words = [(r.doc_id, (r.text or "").lower().split()) for r in docs.collect()]
    learned = [w for i, ws in words if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in [*ws, "\n"]]
    n, v = len(learned), len(set(learned))
    for r in found:
        if r.doc_id in (9, 10):
            tokens = [*dict(words)[r.doc_id], "\n"]
            want = sum(np.log10((learned.count(t) + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
            assert abs(r.base_score - want) < 1e-6 * abs(want) and r.n_known == sum(t in learned for t in tokens) and r.train_tokens == n
    assert ppm.digest(none).count() == 0
    assert ppm.adaptive(b"abcabcabcabc") < 12 * 8


def test_ppm_keeps_its_order_when_the_cache_is_small(spark, docs):
    table = docs.unionByName(spark.createDataFrame([(20 + k, prose(8, 3000)[k : k + 900] + f" odd{k} zq", "xy", "s1", 0, "clash") for k in range(6)], DOCS))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    learned = pa.array([t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 == 1], pa.string())
    _, _, stream, bounds = ppm.streams(learned, ppm.ORDER)
    trie = ppm.Trie(*np.unique(ppm.grams(stream, bounds, ppm.ORDER)[0], return_counts=True), ppm.ORDER)
    want = []
    for i, t in rows:
        _, _, stream, bounds = ppm.streams(pa.array([t], pa.string()), ppm.ORDER)
        want.append((i is None, i, trie.logs(ppm.grams(stream, bounds, ppm.ORDER)[0]).sum() / np.log(10)))
    for entries in (50,):
        got = [(r.doc_id is None, r.doc_id, r.score) for r in ppm.score(table, ppm.crc_mod("doc_id", 5) == 1, entries=entries).collect()]
        for (_, i, a), (_, j, b) in zip(sorted(want, key=repr), sorted(got, key=repr), strict=True):
            assert i == j and abs(a - b) < 1e-5 * abs(a)
    found = ppm.score(table, F.lit(False)).collect()
    assert all(abs(r.score + (len(" ".join((t or "").lower().split())) + 1) * np.log10(256)) < 1e-6 * abs(r.score) for r in found for i, t in rows if i == r.doc_id)


def test_near_components_are_those_of_exact_similarity(spark, monkeypatch):
    rng = random.Random(5)
    base = [" ".join(rng.choices(["word%d" % k for k in range(900)], k=300)) for _ in range(40)]

    def changed(text, n):
        words = text.split()
        for at in rng.sample(range(len(words)), n):
            words[at] = "other"
        return " ".join(words)

    texts = base + [changed(t, 5) for t in base] + [changed(t, 150) for t in base] + [None, "", " \n", base[0].upper()] + [changed(base[1], 3) for _ in range(60)]
    texts += [changed(t, 9) for t in base] + [changed(base[2], 8 + k % 3) for k in range(40)] + ["a b c", "A  b c", "a b d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [(t or "").lower().split() for t in texts]
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = np.arange(len(texts))
    below = 0
    for b in range(len(texts)):
        for a in range(b):
            both, whole = len(shingles[a] & shingles[b]), len(shingles[a] | shingles[b])
            below += 0.6 * whole <= both < 0.8 * whole
            if both >= 0.8 * whole:
                group[group == max(group[a], group[b])] = min(group[a], group[b])
    assert below > 100 and len(set(group.tolist())) > 80
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    assert got == dict(enumerate(group.tolist()))
    monkeypatch.setattr(simhash.left_apart, "__defaults__", (2 * simhash.LEAF, 16))
    assert {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()} == got
    assert simhash.near_components(docs.limit(0)).count() == 0


def test_connected_links_as_all_pairs_do():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 1 << 63, (300, 2), np.uint64)
    points[100:] = points[7] ^ (np.uint64(1) << rng.integers(0, 64, (200, 2)).astype(np.uint64))
    points[290:] ^= np.uint64(0b1011)
    part = (points[:, 0] & np.uint64(0xFFFFF)).astype(np.uint32)
    for radius in (3, 5, 60):
        for sure in (0, 4, 48):
            i, j = simhash.connected(simhash.Near(points, part, np.ones(300), 20, radius, 0.8), sure)
            ours, theirs = np.arange(300), np.arange(300)
            simhash.joined(ours, i, j)
            simhash.joined(theirs, *np.nonzero(np.bitwise_count(points[:, None] ^ points[None]).sum(axis=2) <= radius))
            assert len(i) < 300 and ours.tolist() == theirs.tolist()


def test_a_passage_meets_other_documents_beyond_its_own(spark):
    """Windows of one key: the nearest before one may be its own document's, or overlap too little, and is passed over."""
    columns = "key long, near int, doc long, tag int, c int, l int, r int"
    rows = [(16, 1, 1, 0, 100, 0, 200), (16, 2, 2, 0, 50, 0, 150), (16, 3, 3, 0, 49, 40, 90), (16, 4, 4, 0, 60, 0, 160), (16, 5, 4, 0, 900, 850, 950)]
    met = {(r.doc, r.other, r.bit) for r in substring_dedup.meet(spark.createDataFrame(rows, columns).coalesce(1), 60).collect()}
    assert met == {(2, 1, 1), (4, 1, 1), (4, 2, 1)}  # 3 overlaps no one; both of 4 meet 1 and 2, and not each other
    beside = [(17, 7, 1, 0, 100, 0, 200), (17, 7, 2, 0, 50, 0, 150), (17, 7, 3, 0, 50, 0, 150)]
    links = substring_dedup.meet(spark.createDataFrame(beside, columns).coalesce(1), 60)
    assert {(r.doc, r.other) for r in links.collect()} == {(2, 1), (3, 1), (3, 2)}
    assert substring_dedup.join_intervals(links, 2).count() == 3  # a longer run in common needs no second function


def test_every_round_of_a_passage_is_named(spark):
    """Two rounds of a passage in one document, far apart: each is named, whatever stands around them."""
    import random

    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(30):
        p = words(56)
        rows.append((k, " ".join([*words(30), *p, *words(30)])))
        rows.append((100 + k, " ".join([*words(40), *p, *words(400), *p, *words(40)])))
        want |= {(100 + k, 40, k), (100 + k, 496, k)}
    found = substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert want <= {(r.doc_id, r.start, r.other_id) for r in found.collect()}


def test_counts_of_many_slices_stay_small():
    """Held together, the grams of a batch are bounded by its distinct ones and a slice, not by all slices' arrays."""
    rng = np.random.default_rng(3)
    vocabulary = np.array(prose(91, 5000).split())
    texts = [" ".join(rng.choice(vocabulary, 2000)) for _ in range(1000)] + [None, "", " \n", "A a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    tracemalloc.start()
    found = list(ppm.tallies(iter([batch, batch.slice(0, 0)]), "text", 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20  # numpy's arrays; 141 MB with slices of 4 MB that were held until the last
    got = {kind: {} for kind in range(3)}
    for b in found:
        for kind, key, n in zip(*(c.to_pylist() for c in b.columns)):
            got[kind][key] = got[kind].get(key, 0) + n
    words = Counter(w for t in texts for w in (t or "").lower().split())
    assert got[0] == {int(np.uint64(xxhash.xxh64_intdigest(w)).view(np.int64)): n for w, n in words.items()} and got[2] == {0: len(texts)}
    _, _, stream, bounds = ppm.streams(pa.array(texts, pa.string()), 5)
    keys, n = np.unique(ppm.grams(stream, bounds, 5)[0], return_counts=True)
    assert got[1] == dict(zip(keys.view(np.int64).tolist(), n.tolist()))


def test_words_are_counted_without_holding_them(spark):
    space = " \t\n\x0b\x0c\r"
    rng = random.Random(9)
    texts = [None, "", *space, space, "w", "www", "a\xa0b\u2003c d", "\x1c\x85\u2028 x", "\0 \x1f", "$1 \\1", "\U0001f600 \U0001f600\U0001f601"]
    texts += ["".join(rng.choice("w$\\é\U0001f600\xa0" + space * 2) for _ in range(rng.randrange(60))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("n", mixing.words(F.col("text")))
    assert {r.k: r.n for r in frame.collect()} == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}
    assert "regexp_extract_all" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_the_mix_counts_words_where_rows_are_written_alone(spark, monkeypatch):
    calls, keep = [], mixing.keep
    monkeypatch.setattr(mixing, "keep", lambda df, what: calls.append((what, df._jdf.queryExecution().optimizedPlan().toString())) or keep(df, what))
    rows = [(k, prose(k, 3 + k % 7), "xy", "ab"[k % 2], 0, "z") for k in range(60)]
    table = keep(spark.createDataFrame(rows, DOCS), "docs")
    taken = mixing.mix(table).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in taken} == {r.doc_id: r.taken // r.size for r in mixing.digest(table).collect() if r.taken}
    read = [what for what, plan in calls if "regexp_replace" in plan or "regexp_extract_all" in plan]
    assert set(read) == {"sizes"}  # the lengths, the plan and its edges were counted from texts before


def test_workers_give_free_memory_back():
    """What a task has freed must not stay with its worker, which waits for the next one beside other stages."""
    code = """
import ctypes, re
import pyarrow as pa
from attestia.llm.common import trimmed
held = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
def run(batches):
    small = [bytes(1000) for _ in range(200_000)]
    kept.append(bytes(1000))  # on top of the heap, so that free() alone gives nothing back
    yield from batches
kept, before = [], held()
list(RUN(iter([])))
print(held() - before)
"""
    plain, given = (int(subprocess.run([sys.executable, "-c", code.replace("RUN", r)], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONMALLOC": "malloc"}).stdout) for r in ("run", "trimmed(run)"))
    assert plain > 150 and given < 60
