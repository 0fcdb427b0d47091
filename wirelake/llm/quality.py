"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its words and of their character n-grams, all
hashed into one table, and, for a fixed share (``SHAPE``), of three pseudo-words that name the bins of its length, of the share of
words that repeat the word before and of the share of distinct words, which are counts beside the method's n-grams; a softmax layer over the average gives the probability of each label. Vectors and
layer are trained together by seeded stochastic gradient descent in numpy on the driver, over a bounded
sample of labelled rows (``max_docs``, a parameter, and of each text the first ``FIT_CHARS`` characters). As the layer is linear, a document's score is the
average of its words' scores, so each worker remembers the scores of words it has met; the n-grams of words that it has not met are
hashed together, many words at a time. Every text is scored whole.

Edge cases: null and empty texts get the score of no words (the bias); labels that are null or without a document are dropped, a
label that is repeated counts once, and both labels of a document that has both count; if no row or one class only is labelled, every
score is that class's share (0.5 without labels); rows with null doc_id are scored and not learnt from;
repeated rows give equal rows; an empty table gives an empty result. Columns other than the named ones are
ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, islice, repeat
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import fold, give_back

GRAMS = (3, 4)
#: Words remembered by a worker; the longest remembered.
MEMO, MEMO_CHARS = 400_000, 48
#: Characters whose n-grams are hashed at a time; distinct words of texts that wait for the scores of their new words.
PIECE, WAITING = 1 << 16, 1 << 16
#: Characters of a text that are learnt from.
FIT_CHARS = 200_000
#: Share of the pseudo-words in a document's average.
SHAPE = 0.3


@dataclass
class Model:
    """Score of a feature bucket under the trained layer, and the bias."""

    weight: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.memo: dict[str, float] = {}

    def sums(self, words: list[str]) -> list[float]:
        """The sum of the weights of each word's features: the word's own, then its n-grams from left to right, by length."""
        out: list[float] = []
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = sizes.cumsum()
        while len(out) < len(words):
            start = len(out)
            end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + PIECE, "right")))  # a longer word goes alone
            part, each = words[start:end], np.arange(end - start)
            marked, owner = f"<{'><'.join(part)}>", np.repeat(each, sizes[start:end])
            total = self.weight[np.array([zlib.crc32(f"<{w}>>".encode()) for w in part]) % len(self.weight)]
            for at in range(0, len(marked), PIECE):
                for n, hashes in gram_hashes(marked[at : at + PIECE + max(GRAMS) - 1], PIECE):
                    first = owner[at : at + len(hashes)]
                    inside = first == owner[at + n - 1 : at + n - 1 + len(hashes)]
                    values = self.weight[hashes[inside] % len(self.weight)]
                    # bincount adds one after the other, so a word's sum does not depend on the words beside it
                    total = np.bincount(np.concatenate([each, first[inside]]), np.concatenate([total, values]))
            out += total.tolist()
        return out

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        """Scores of the texts, in their order."""
        out: list[float] = []
        waiting: list[tuple[np.ndarray, np.ndarray, int, float]] = []
        absent: list[str] = []
        held = 0
        for text in texts:
            words = (text or "").split()
            counts = Counter(words)
            values = np.fromiter(map(self.memo.get, counts, repeat(math.nan)), np.float64, len(counts))
            times = np.fromiter(counts.values(), np.float64, len(counts))
            absent += compress(counts, np.isnan(values).tolist())
            shape = float(self.weight[shape_features(words, len(counts), len(self.weight))].mean()) if words else 0.0
            waiting.append((values, times, 2 * sum(map(len, words)), shape))  # a word has two features a character
            held += len(counts)
            if held >= WAITING:
                out += self._scored(waiting, absent)
                waiting, absent, held = [], [], 0
        return out + self._scored(waiting, absent) if waiting else out

    def _scored(self, waiting: list[tuple[np.ndarray, np.ndarray, int, float]], absent: list[str]) -> list[float]:
        """Scores of texts: values (NaN for words of ``absent``, in order) and times of the distinct words, number of features, mean of the shape's."""
        new = list(dict.fromkeys(absent))
        known = dict(zip(new, self.sums(new), strict=True))
        sizes = [len(values) for values, _, _, _ in waiting]
        values = np.concatenate([w[0] for w in waiting])
        values[np.isnan(values)] = np.fromiter(map(known.__getitem__, absent), np.float64, len(absent))
        # as above, a text's total does not depend on the texts beside it
        totals = np.bincount(np.repeat(np.arange(len(sizes)), sizes), values * np.concatenate([w[1] for w in waiting]), len(sizes)).tolist()
        out = []
        for total, (_, _, n, shape) in zip(totals, waiting, strict=True):
            z = self.bias + ((1 - SHAPE) * total / n + SHAPE * shape if n else 0.0)
            out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
        self.memo.update((w, value) for w, value in known.items() if len(w) <= MEMO_CHARS)
        if len(self.memo) > MEMO:
            self.memo = dict(islice(self.memo.items(), MEMO // 2))  # words met first are mostly the frequent ones
        return out

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def crc_table() -> np.ndarray:
    """What crc32 does with each byte."""
    out = np.arange(256, dtype=np.int64)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ 0xEDB88320, out >> 1)
    return out


CRC, ONES = crc_table(), 0xFFFFFFFF


def after_byte(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return CRC[(state ^ byte) & 255] ^ state >> 8


def after_character(state: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """States of crc32 after the UTF-8 bytes of one more character each."""
    out = after_byte(state, codes)
    wide = np.flatnonzero(codes > 0x7F)
    if len(wide):
        c = codes[wide]
        lead = np.where(c > 0xFFFF, 0xF0 | c >> 18, np.where(c > 0x7FF, 0xE0 | c >> 12, 0xC0 | c >> 6))
        own = after_byte(state[wide], lead)
        for shift, least in ((12, 0x10000), (6, 0x800), (0, 0x80)):
            own = np.where(c >= least, after_byte(own, 0x80 | c >> shift & 0x3F), own)
        out[wide] = own
    return out


def gram_hashes(text: str, starts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each length of ``GRAMS``, with crc32 of the n-grams that begin at the first ``starts`` characters, as far as they fit."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    state = np.full(min(starts, len(codes)), ONES)
    for n in range(1, max(GRAMS) + 1):
        here = max(0, min(starts, len(codes) - n + 1))
        state = after_character(state[:here], codes[n - 1 : n - 1 + here])
        if n in GRAMS:
            yield n, state ^ ONES


def feature_names(word: str) -> list[str]:
    """The word and each of its character n-grams, ends marked."""
    marked = f"<{word}>"
    out = [f"{marked}>"]  # unlike every n-gram
    for n in GRAMS:
        out += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return out


def features(word: str, buckets: int) -> list[int]:
    return [zlib.crc32(x.encode()) % buckets for x in feature_names(word)]


def shape_features(words: list[str], distinct: int, buckets: int) -> list[int]:
    """Buckets of the document's pseudo-words."""
    n = len(words)
    again = sum(map(eq, words, words[1:]))
    names = f"\nlength {n.bit_length()}", f"\nagain {10 * again // n}", f"\ndistinct {10 * distinct // n}"
    return [zlib.crc32(x.encode()) % buckets for x in names]


def train(texts: list[str | None], labels: list[int], buckets: int = 1 << 16, dim: int = 12, epochs: int = 8, rate: float = 0.5, seed: int = 0) -> Model:
    """Embeddings and softmax layer by stochastic gradient descent, one document a step."""
    share = sum(labels) / len(labels) if labels else 0.5
    if share in (0.0, 1.0) or not labels:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(buckets), math.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    memo: dict[str, array] = {}
    docs = []
    for text in texts:
        words = (text or "").split()
        distinct = Counter(words)
        counts: Counter = Counter()
        for w, times in distinct.items():
            if w not in memo:
                memo[w] = array("I", features(w, buckets))
            for b in memo[w]:
                counts[b] += times
        shape = shape_features(words, len(distinct), buckets) if words else []
        docs.append((np.array([*counts, *shape], np.int32), np.fromiter(counts.values(), np.int32, len(counts))))
    del memo
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    layer, bias = np.zeros((dim, 2)), np.zeros(2)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, counted = docs[k]
            part = counted.astype(np.float64)
            if shapes := len(ids) - len(part):
                part = np.concatenate([part * (1 - SHAPE) / part.sum(), np.full(shapes, SHAPE / shapes)])
            now = rate * (1 - done / steps)
            done += 1
            hidden = part @ vectors[ids]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = layer @ p
            layer -= now * np.outer(hidden, p)
            bias -= now * p
            vectors[ids] -= now * np.outer(np.minimum(1.0, part * len(part)), back)  # a bucket twice in ids moves once
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, label: str, max_docs: int, seed: int = 0) -> tuple[list[str | None], list[int]]:
    """Texts and labels of about ``max_docs`` labelled rows, chosen by hash of doc_id, in a fixed order."""
    marked = labels.where(learn & F.col(label).isNotNull()).select("doc_id", (F.col(label).cast("int") == 1).cast("int").alias("_label")).distinct()
    n = marked.count()
    if not n:
        return [], []
    scale = 1 << 40
    limit = min(scale, math.ceil(scale * max_docs / n))
    chosen = marked.where(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(scale)) < limit)
    # About max_docs narrow rows, as no id has more than two, so their broadcast is bounded by the parameter; so is what the driver gets,
    # however often an id stands in the documents.
    met = docs.select("doc_id", F.substring("text", 1, FIT_CHARS).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_label")
    got = met.orderBy(F.xxhash64(F.lit(seed), "doc_id", "_label", "text")).limit(2 * max_docs).collect()
    got.sort(key=lambda r: (r["doc_id"], r["_label"], r["text"] or ""))
    return [r["text"] for r in got], [r["_label"] for r in got]


_MODELS: dict[str, Model] = {}


def scorer(spark, model: Model):
    """A pandas UDF text -> score; the broadcast holds one number a bucket."""
    shared, key = spark.sparkContext.broadcast((model.weight, model.bias)), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model(*shared.value)
        own = _MODELS[key]
        for batch in texts:
            yield pd.Series(own.scores(batch), dtype="float64")

    return score


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, held: int = 0, max_docs: int = 3000, seed: int = 0) -> Model:
    """The model learnt from the labelled rows outside the held-out fold."""
    texts, marks = labelled_sample(docs, labels, fold("doc_id", parts) != held, label, max_docs, seed)
    try:
        return train(texts, marks, seed=seed)
    finally:
        del texts
        give_back()


def score_quality(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, threshold: float = 0.3, max_docs: int = 3000, seed: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    score = scorer(docs.sparkSession, fit(docs, labels, "quality", parts, held, max_docs, seed))
    out = docs.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_docs: int = 3000, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    score = scorer(docs.sparkSession, fit(docs, labels, max_docs=max_docs, seed=seed))
    return docs.where(score(F.col("text")) >= threshold)
