"""Language identification by cross-parsing entropy.

A generalised suffix automaton over a language's labelled text gives the longest match of a text at each
place. A text is cut into such longest matches (phrases), across words; a phrase costs the logarithm of the number of
places it can point to, and the language that needs the fewest phrases, so normalised, wins.

Texts are lower-cased, runs of other ASCII characters than letters become one space, and letters are the bytes of UTF-8, so that an
alphabet is small in any script. A text is parsed in stretches of ``STRETCH`` bytes, each from the automaton's root; all stretches of
a batch are parsed side by side, a byte of each at a time, through the automaton's transition table.

Training reads a bounded sample of labelled rows: about ``docs_per_lang`` documents of each language by hash of doc_id and text (of
each the first ``bytes_per_lang`` bytes), and of their texts in that order the first ``bytes_per_lang`` bytes; of the languages, the
``MOST_LANGS`` with the most rows. Every text is read whole for its prediction.

Edge cases: null texts and texts without a letter (Unicode's) are ``und`` with score 0; ties go to the language
first in code point order; rows with null doc_id are not learnt from and are predicted (held_out null);
if nothing is labelled every text is ``und``; languages without a letter in their sample are left out; repeated rows give equal rows; an
empty table gives an empty result. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelake.llm.common import fold

LETTER = r"\p{L}"
UNDETERMINED = "und"
#: Bytes that are parsed in one go; languages that are learnt at most.
STRETCH, MOST_LANGS = 1024, 512
#: Bytes of texts that are parsed side by side.
TOGETHER = 16 << 20
#: What ASCII bytes become: letters themselves, all others a space.
PLAIN = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Words in lower case, a space before, between and after them."""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split()) + b" "


class SuffixAutomaton:
    """Suffix automaton of several runs of bytes; afterwards one transition table, state times letters + letter -> state times letters,
    0 for none (the root is 0, and nothing leads to it)."""

    def __init__(self, runs: list[bytes]) -> None:
        letters = sorted(set(b"".join(runs)))
        self.code = np.full(256, len(letters), np.int64)  # the last column: letters that are unknown
        self.code[letters] = np.arange(len(letters))
        step: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def state(n: int, out: dict[int, int]) -> int:
            link.append(-1)
            length.append(n)
            step.append(out)
            return len(link) - 1

        def split(p: int, c: int) -> int:
            """The state that holds exactly the longest run of ``p`` and then ``c``."""
            q = step[p][c]
            if length[q] == length[p] + 1:
                return q
            k = state(length[p] + 1, dict(step[q]))
            link[k], link[q] = link[q], k
            while p != -1 and step[p].get(c) == q:
                step[p][c] = k
                p = link[p]
            return k

        for run in runs:
            last = 0
            for c in run:
                if c in step[last]:
                    last = split(last, c)
                    continue
                new, p = state(length[last] + 1, {}), last
                while p != -1 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                link[new] = 0 if p == -1 else split(p, c)
                last = new
        width = self.width = len(letters) + 1
        self.table = np.zeros(len(step) * width, np.int32)
        rows = np.repeat(np.arange(len(step)), [len(x) for x in step])
        letter = np.fromiter((c for x in step for c in x), np.int64, len(rows))
        self.table[rows * width + self.code[letter]] = np.fromiter((q for x in step for q in x.values()), np.int64, len(rows)) * width

    def phrases(self, lanes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each stretch, a column of ``lanes`` of so many bytes (longest first), the longest matches one after another that make it
        up; an unknown letter is one of its own."""
        n = np.zeros(len(sizes), np.int64)
        at = np.zeros(len(sizes), np.int64)
        table, unknown = self.table, self.width - 1
        ends = np.searchsorted(-sizes, -np.arange(1, len(lanes) + 1), "right")  # stretches that have a byte there
        for row, m in zip(lanes, ends, strict=True):
            c = self.code[row[:m]]
            to = table[at[:m] + c]
            miss = to == 0
            n[:m] += miss & (at[:m] > 0)
            n[:m] += c == unknown
            at[:m] = np.where(miss, table[c], to)
        return n + (at > 0)


class Model:
    """Automata by language; picks the language of a text."""

    def __init__(self, texts: dict[str, list[bytes]]) -> None:
        self.langs = sorted(texts)
        self.automata = [SuffixAutomaton(texts[x]) for x in self.langs]
        self.cost = [math.log2(2 + sum(map(len, texts[x]))) for x in self.langs]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text in each language."""
        stretches = [(k, t[i : i + STRETCH]) for k, t in enumerate(texts) for i in range(0, len(t), STRETCH)]
        stretches.sort(key=lambda x: -len(x[1]))
        sizes = np.array([len(x) for _, x in stretches])
        lanes = np.zeros((len(stretches), sizes.max(initial=0)), np.uint8)
        for row, (_, x) in zip(lanes, stretches, strict=True):
            row[: len(x)] = np.frombuffer(x, np.uint8)
        lanes = np.ascontiguousarray(lanes.T)
        owner = np.array([k for k, _ in stretches], np.int64)
        return np.stack([np.bincount(owner, x.phrases(lanes, sizes), len(texts)) for x in self.automata], axis=1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of texts that have a letter; the others are None."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.langs:
            return out
        batch: list[tuple[int, bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            if text is not None:
                batch.append((k, normal(text)))
                size += len(batch[-1][1])
            if batch and (size >= TOGETHER or k == len(texts) - 1):
                for (i, _), own in zip(batch, self.counts([t for _, t in batch]) * np.array(self.cost), strict=True):
                    out[i] = self.choice(own)
                batch, size = [], 0
        if batch:
            for (i, _), own in zip(batch, self.counts([t for _, t in batch]) * np.array(self.cost), strict=True):
                out[i] = self.choice(own)
        return out

    def choice(self, costs: np.ndarray) -> tuple[str, float]:
        best = int(costs.argmin())
        rest = float(np.delete(costs, best).min()) if len(costs) > 1 else 2 * float(costs[best])
        return self.langs[best], rest / (rest + float(costs[best]))


def labelled_texts(docs: DataFrame, docs_per_lang: int, bytes_per_lang: int, learn: Column, seed: int = 0) -> dict[str, list[bytes]]:
    """Normal texts of each language in the sample, in a fixed order: at most MOST_LANGS times bytes_per_lang bytes."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    scale = 1 << 40
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(scale))
    sampled = rows.join(F.broadcast(counts), "lang").where(place < F.ceil(F.lit(float(scale) * docs_per_lang) / F.col("n")))  # MOST_LANGS rows
    sample = sampled.select("lang", place.alias("place"), "doc_id", F.substring("text", 1, bytes_per_lang).alias("text")).distinct()
    # About docs_per_lang rows of a language, of which it uses the first in the order, up to its bytes.
    order = W.partitionBy("lang").orderBy("place", "doc_id", "text")
    before = F.sum(F.octet_length("text")).over(order.rowsBetween(W.unboundedPreceding, -1))
    chosen = sample.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < bytes_per_lang).drop("_before")
    found: dict[str, list[bytes]] = defaultdict(list)
    left: dict[str, int] = defaultdict(lambda: bytes_per_lang)
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["place"], r["doc_id"], r["text"])):
        run = normal(r["text"])[: left[r["lang"]]]
        if len(run) > 2:
            found[r["lang"]].append(run)
            left[r["lang"]] -= len(run)
    return dict(found)


_MODELS: dict[str, Model] = {}


def predictor(spark, texts: dict[str, list[bytes]]):
    """A pandas UDF text (null without a letter) -> struct<lang_pred, score>; the sample is broadcast, at most bytes_per_lang a language."""
    shared, key = spark.sparkContext.broadcast(texts), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model(shared.value)
        model = _MODELS[key]
        for batch in batches:
            yield pd.DataFrame(model.predict(list(batch)), columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, docs_per_lang: int = 400, bytes_per_lang: int = 60_000, parts: int = 4, held: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs``; learnt from the rows outside the held-out fold."""
    held_out = fold("doc_id", parts) == held
    texts = labelled_texts(docs, docs_per_lang, bytes_per_lang, ~held_out, seed)
    predict = predictor(docs.sparkSession, texts)
    lettered = F.when(F.col("text").rlike(LETTER), F.col("text"))
    out = docs.select("doc_id", held_out.alias("held_out"), predict(lettered).alias("_p"))
    return out.select("doc_id", "held_out", F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"))
