"""Whole columns of texts to the ids of a word-end BPE tokenizer file, many words at a time.

The ids are those of the ``tokenizers`` library for the same file. Words are merged in numpy, all words of one length
together, always the pair of lowest rank and of these the leftmost, as the library does for one word. Text is cut at
spaces and line ends, which no pre-token of these files spans, and each distinct piece is encoded once. Pieces with
characters whose normal form, case or class differs between Unicode versions go to the library itself.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Plain pieces hold only characters below U+0250 without controls and U+0130; there Python's lower() is the file's.
PLAIN = r"^[\x20-\x7e¡-įı-ɏ]*$"
#: Of these, pieces that are one word.
LETTERS = r"^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+$"


def byte_symbols() -> list[str]:
    """The character that byte-level tokenizer files write for each byte: itself if printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (chr(0x100 + k) for k in range(256))
    return [chr(b) if b in shown else next(hidden) for b in range(256)]


class WordEndBPE:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0]["pattern"]["Regex"] + "|\n")
        vocab, symbols = model["vocab"], byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + end] for c in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._table(keys, np.arange(len(keys)), made)

    def _table(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """Open addressing: slots of (key, rank, merged id)."""
        self.bits = int(np.ceil(np.log2(len(keys) * 8 + 8)))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, 1 << 30, np.int64)
        self.made = np.zeros(1 << self.bits, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]
            won = self.keys[at[left]] == keys[left]
            done = left[won]
            self.ranks[at[done]], self.made[at[done]] = ranks[done], made[done]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, slot) of each key; a rank of 1 << 30 where there is none."""
        at = self._slot(keys)
        hit = self.keys[at] == keys
        open_ = np.nonzero(~hit & (self.keys[at] >= 0))
        for _ in range(self.probes):
            if not len(open_[0]):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            go = (there != keys[open_]) & (there >= 0)
            open_ = tuple(x[go] for x in open_)
        return np.where(self.keys[at] == keys, self.ranks[at], 1 << 30), at

    def _merge(self, words: np.ndarray) -> list[np.ndarray]:
        """Ids of words given as rows of equally many bytes."""
        ids = self.inner[words]
        ids[:, -1] = self.last[words[:, -1]]
        out: list[np.ndarray] = [None] * len(ids)
        rows = np.arange(len(ids))
        while True:
            if ids.shape[1] > 1:
                ranks, slots = self._look(ids[:, :-1] << 20 | ids[:, 1:])
                best = ranks.argmin(axis=1)
                line = np.arange(len(ids))
                more = ranks[line, best] < 1 << 30
            else:
                more = np.zeros(len(ids), bool)
            for r, found in zip(rows[~more].tolist(), ids[~more].astype("<u2")):
                out[r] = found
            if not more.any():
                return out
            line, best = line[more], best[more]
            new = self.made[slots[line, best]]
            ids, rows = ids[more], rows[more]
            column = np.arange(ids.shape[1] - 1)[None, :]
            merged = np.where(column <= best[:, None], ids[:, :-1], ids[:, 1:])
            merged[np.arange(len(merged)), best] = new
            ids = merged

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all distinct words in a row, number of ids of each)."""
        words = words.cast(pa.binary())
        lengths = pa.compute.binary_length(words).to_numpy(zero_copy_only=False)
        bytes_, ends = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.cumsum(lengths)
        found: list[np.ndarray] = [None] * len(words)
        for n in np.unique(lengths).tolist():
            of = np.nonzero(lengths == n)[0]
            for at in range(0, len(of), step := max(1, (1 << 18) // n)):
                part = of[at : at + step]
                for k, ids in zip(part.tolist(), self._merge(bytes_[(ends[part] - n)[:, None] + np.arange(n)])):
                    found[k] = ids
        return np.concatenate([np.zeros(0, "<u2"), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each piece)."""
        like = lambda pattern: pa.compute.match_substring_regex(pieces, pattern).to_numpy(zero_copy_only=False)
        one_word = like(LETTERS)
        plain = like(PLAIN) & ~like("<[|]") & ~one_word
        strange = np.nonzero(~plain & ~one_word)[0]
        cut = pa.array(self.words.findall("\n".join(pieces.filter(pa.array(plain)).to_pylist()).lower()), pa.string())
        is_end = pa.compute.equal(cut, "\n").to_numpy(zero_copy_only=False)
        cut = cut.filter(pa.array(~is_end))
        words = pa.concat_arrays([pa.compute.utf8_lower(pieces.filter(pa.array(one_word))), cut]).dictionary_encode()
        owner = np.concatenate([np.nonzero(one_word)[0], np.nonzero(plain)[0][np.cumsum(is_end)[~is_end]] if len(cut) else np.zeros(0, np.int64)])
        flat, sizes = self._word_ids(words.dictionary)
        index = words.indices.to_numpy()
        if len(strange):
            more = [np.array(self.library.encode(pieces[k].as_py(), add_special_tokens=False).ids, "<u2") for k in strange.tolist()]
            index = np.concatenate([index, len(sizes) + np.arange(len(more))])
            flat, sizes = np.concatenate([flat, *more]), np.concatenate([sizes, np.fromiter(map(len, more), np.int64, len(more))])
            owner = np.concatenate([owner, strange])
        order = np.argsort(owner, kind="stable")
        ids, taken = gather(flat, sizes, index[order])
        return ids, np.bincount(owner[order], taken, len(pieces)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, without special tokens; number of ids of each text); null is an empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        cut = pa.compute.split_pattern(pa.compute.replace_substring(texts, "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        ids, lengths = gather(*self._piece_ids(coded.dictionary.cast(pa.string())), coded.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(lengths)])
        edges = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        return ids, np.diff(ends[edges])


def gather(flat: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat, of the given lengths, that index names: (all in a row, their lengths)."""
    starts = np.cumsum(lengths) - lengths
    taken = lengths[index]
    move = np.repeat(starts[index] - (np.cumsum(taken) - taken), taken)
    return flat[move + np.arange(len(move))], taken


_loaded: dict[str, WordEndBPE] = {}


def load(path: str) -> WordEndBPE:
    """One encoder for each file and Python worker."""
    if path not in _loaded:
        _loaded[path] = WordEndBPE(path)
    return _loaded[path]
