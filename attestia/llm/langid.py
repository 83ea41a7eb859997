"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the 2-, 3- and 4-byte runs of its UTF-8 bytes, with A-Z in lower case and every run of bytes that
are no letters as one space; each is hashed to a row of an embedding table. The text's vector is the mean of its rows,
over the whole text, and a linear softmax gives the languages. Table and softmax are trained together by stochastic
gradient descent in numpy, on a bounded sample of labelled texts. As both are linear, their product is what is applied.

A temperature is fitted on a part of the sample that training did not see, and the threshold of rejection is that
probability which all but a stated part of the right predictions there reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestia.llm.common import crc_mod, sliced

#: Rows of the embedding table, and its width.
BUCKETS, WIDTH = 1 << 15, 16
#: Sizes of the subwords in bytes.
RUNS = (2, 3, 4)
#: Labelled texts of each language that training draws, by a hash of the id, and their greatest length in bytes: longer
#: ones are not learned from. Prediction takes every text whole.
SAMPLE, LONGEST = 400, 1 << 16
#: Training cuts texts to parts of so many bytes, so that short texts are known as well.
PART = 600


def _letters() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


LETTERS = _letters()


def subwords(text: bytes) -> np.ndarray:
    """Places in the table of all subwords of a text."""
    x = LETTERS[np.frombuffer(b" " + text + b" ", np.uint8)]
    x = x[np.concatenate([[True], (x[1:] != 0x20) | (x[:-1] != 0x20)])].astype(np.uint32)
    found = []
    code = x
    for n in range(2, max(RUNS) + 1):
        if len(x) < n:
            break
        code = (code[:-1] << np.uint32(8)) | x[n - 1 :]
        if n in RUNS:
            found.append(((code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(17)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # of each subword for each language, the temperature in it
    bias: np.ndarray
    threshold: float

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """One row for each text, over all its subwords."""
        out = np.empty((len(texts), len(self.languages)))
        for k, text in enumerate(texts):
            places = subwords(text)
            total = np.zeros(len(self.languages))
            for at in range(0, len(places), 1 << 18):
                total += self.weights[places[at : at + (1 << 18)]].sum(axis=0, dtype=np.float64)
            out[k] = total / max(1, len(places)) + self.bias
        return softmax(out)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], epochs: int = 6, rate: float = 0.5, batch: int = 64, seed: int = 0, lose: float = 0.001) -> Model:
    """Fit table, softmax, temperature and threshold; lose is the part of right predictions that may be rejected."""
    languages = sorted(set(labels))
    parts, of, held = [], [], []
    for k, (text, label) in enumerate(zip(texts, labels)):
        for at in range(0, max(1, len(text)), PART):
            parts.append(subwords(text[at : at + PART]))
            of.append(languages.index(label))
            held.append(k % 5 == 4)
    of, held = np.array(of), np.array(held)
    if held.all() or not held.any():
        held = np.zeros(len(of), bool)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    learned = np.nonzero(~held)[0]
    steps, done = epochs * max(1, -(-len(learned) // batch)), 0
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(learned), max(1, -(-len(learned) // batch))):
            now = rate * (1 - done / steps)
            done += 1
            sizes = np.array([len(parts[k]) for k in chosen])
            places, row = np.concatenate([parts[k] for k in chosen]), np.repeat(np.arange(len(chosen)), sizes)
            if not len(places):
                continue
            mean = np.zeros((len(chosen), WIDTH), np.float32)
            starts, some = np.cumsum(sizes) - sizes, sizes > 0
            mean[some] = np.add.reduceat(table[places], starts[some], axis=0) / sizes[some, None]
            wrong = softmax(mean @ out + bias).astype(np.float32)
            wrong[np.arange(len(chosen)), of[chosen]] -= 1
            back = wrong @ out.T / np.maximum(sizes, 1)[:, None] * 20
            out -= now * 20 * (mean.T @ wrong) / len(chosen)
            bias -= now * wrong.mean(axis=0)
            unique, inverse = np.unique(places, return_inverse=True)
            step = np.zeros((len(unique), WIDTH), np.float32)
            for j in range(WIDTH):
                step[:, j] = np.bincount(inverse, back[row, j], len(unique))
            table[unique] -= now * step
    weights = table @ out
    check = np.nonzero(held if held.any() else ~held)[0]
    scores = np.array([weights[parts[k]].mean(axis=0) + bias if len(parts[k]) else bias for k in check])
    right = of[check]

    def loss(t: float) -> float:
        return float(-np.log(softmax(scores * t)[np.arange(len(right)), right] + 1e-12).mean())

    heat = min((float(t) for t in np.geomspace(0.1, 10, 41)), key=loss)
    found = softmax(scores * heat)
    hit = found.argmax(axis=1) == right
    threshold = float(np.quantile(found.max(axis=1)[hit], lose)) if hit.any() else 0.0
    return Model(languages, (weights * heat).astype(np.float32), bias * heat, threshold)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column, most: int = SAMPLE) -> tuple[list[bytes], list[str]]:
    """About most texts of each language among the rows that may be learned from, drawn by a hash of id and text."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= LONGEST) & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    rate = F.lit(0.0)
    for language, n in counts.items():
        rate = F.when(F.col(lang_col) == language, F.lit(min(1.0, most / n))).otherwise(rate)
    drawn = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), 11) / F.lit(float(1 << 53))
    found = rows.where(drawn < rate).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).orderBy("l", "t").collect()
    return [r["t"].encode() for r in found], [r["l"] for r in found]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model learned from the rows with a language whose crc32 of the id modulo 3 is not 1; None without such rows."""
    texts, labels = sample(docs, id_col, text_col, lang_col, F.coalesce(crc_mod(id_col, 3) != 1, F.lit(True)))
    return train(texts, labels) if texts else None


def has_letter(text: bytes) -> bool:
    return text.upper() != text.lower() or any(c.isalpha() for c in text.decode())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, accepted) of every row, from the whole text alone.

    lang_pred is the most probable learned language and score its probability; accepted is false below the threshold.
    Null texts, texts without a letter, and all texts where nothing was learned are ``und`` with score 0, not accepted.
    Texts of any length are taken whole. Of languages that are equally probable, the first by name is predicted. Rows
    that repeat an id are predicted alone; an empty table gives no rows; other columns do not matter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for b in sliced(batch, text_col):
                names, scores, good = guess(model, b.column(1).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(good)], [id_col, "lang_pred", "score", "accepted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean")


def guess(model: Model | None, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, probability, whether it is accepted) of each text."""
    names, scores, good = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    known = [k for k, t in enumerate(texts) if model is not None and t and has_letter(t)]
    if known:
        found = model.probabilities([texts[k] for k in known])
        scores[known] = found.max(axis=1)
        good[known] = scores[known] >= model.threshold
        for k, best in zip(known, found.argmax(axis=1).tolist()):
            names[k] = model.languages[best]
    return names, scores, good


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every document; held-out rows are those never learned from."""
    out = predict(docs, fit(docs))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def keep_accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language the model accepts; all columns, texts whole."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced(batch, text_col):
                yield b.filter(pa.array(guess(sent.value, b.column(at).cast(pa.binary()).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)
