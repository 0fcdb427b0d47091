"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised items make one suffix automaton, whose letters are words. A document's words are
streamed through it; at each word the automaton holds the longest run of words that ends there and occurs
in an item. Where that run is a window long (13 words; a shorter item is one window whole), the words
of the window are hit and the items that hold it are noted.

Items pass the driver in blocks of at most ``block_words`` words, each broadcast as an automaton of its own; a worker streams a text through
``TOGETHER`` of them at most, which it builds once and keeps. More blocks take more passes over the documents: a pass writes
what it found of the texts that it hits (places and item ids, no texts), and the passes' findings meet by text in the end.

Edge cases: a null text has no words (0 hits, not contaminated, the digest of nothing); items without words,
null items and null item ids are no windows; items of equal text all count; very long texts are read whole;
repeated rows give equal rows; empty tables give an empty result, or no hits. Columns other than the
named ones are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import LOWER, UPPER, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = re.compile(WORD)
ASCII_LOWER = str.maketrans(UPPER, LOWER)
WINDOW = 13
#: Words of items in a block, and blocks in a pass.
BLOCK_WORDS, TOGETHER = 100_000, 4


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.translate(ASCII_LOWER)) if text else []


class Automaton:
    """Generalised suffix automaton of items; knows the items of each window."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[tuple[int, int], set[str]] = {}  # (state, window length) -> items
        runs = []
        for name, words in items:
            codes = [self.ids.setdefault(w, len(self.ids)) for w in words]
            if codes:
                runs.append((name, codes))
                self._add(codes)
        for name, codes in runs:  # again, when no state is split any more
            size = min(window, len(codes))
            state = n = 0
            for c in codes:
                state, n = self.next[state][c], n + 1
                at = state
                while self.length[self.link[at]] >= size:
                    at = self.link[at]
                if n >= size:
                    ends.setdefault((at, size), set()).add(name)
        #: For each state, the windows (length, items) that end where it is, at it or up its links.
        own: list[list[tuple[int, frozenset[str]]]] = [[] for _ in self.link]
        for (state, size), names in ends.items():
            own[state].append((size, frozenset(names)))
        self.windows: dict[int, list[tuple[int, frozenset[str]]]] = {}
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            found = own[state] + (self.windows.get(self.link[state], []) if state else [])
            if found:
                self.windows[state] = found
        self.shortest = min((min(window, len(c)) for _, c in runs), default=0)

    def _new(self, length: int, link: int = -1, step: dict[int, int] | None = None) -> int:
        self.next.append(dict(step or {}))
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that has exactly the longest run of ``p`` and then ``c``."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, self.link[q], self.next[q])
        self.link[q] = twin
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _add(self, codes: list[int]) -> None:
        last = 0
        for c in codes:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            new, p = self._new(self.length[last] + 1), last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            self.link[new] = 0 if p == -1 else self._split(p, c)
            last = new

    def hits(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans of hit words in order (end exclusive), and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        if not self.windows:
            return spans, names
        codes = list(map(self.ids.get, words))
        step, link, length, windows = self.next, self.link, self.length, self.windows
        state = n = 0
        for i, c in enumerate(codes):
            if c is None:
                state = n = 0
                continue
            to = step[state].get(c)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = step[state].get(c)
                n = length[state]
                if to is None:
                    continue
            state = to
            n += 1
            if state in windows:
                longest = 0
                for size, found in windows[state]:
                    if size <= n:
                        longest = max(longest, size)
                        names |= found
                if longest:
                    lo = i + 1 - longest
                    while spans and spans[-1][1] >= lo:
                        lo = min(lo, spans.pop()[0])
                    spans.append((lo, i + 1))
        return spans, names


def item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[str]]]]:
    """(item id, words) in lists of at most about ``block_words`` words."""
    block, size = [], 0
    for r in items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("i"), "text").orderBy("i", "text").toLocalIterator():
        words = words_of(r["text"])
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((r["i"], words))
        size += len(words)
    if block:
        yield block


_AUTOMATA: dict[tuple[str, int], Automaton] = {}
FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, kept_text string"
FOUND = "array<struct<lo:int,hi:int>>"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def judge(n_words: int, spans: list[tuple[int, int]], names: set[str], share: int) -> tuple:
    """n_words, n_hit, n_items, items_sha256 and contaminated."""
    hit = sum(hi - lo for lo, hi in spans)
    return n_words, hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), hit > 0 and share * hit >= n_words


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in WORDS.finditer(text.translate(ASCII_LOWER))]
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at : places[lo][0]])
        at = places[hi - 1][1]
    return "".join([*out, text[at:]])


def streamed(spark, blocks: list[list[tuple[str, list[str]]]], window: int):
    """A function of lists of words -> (spans, item ids) of each, by the blocks' automata; a worker builds them once."""
    shared, key = [spark.sparkContext.broadcast(b) for b in blocks], uuid.uuid4().hex

    def run(lists: list[list[str]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        if not any(k == key for k, _ in _AUTOMATA):
            _AUTOMATA.clear()
            _AUTOMATA.update({(key, k): Automaton(b.value, window) for k, b in enumerate(shared)})
        out = []
        for words in lists:
            parts = [_AUTOMATA[key, k].hits(words) for k in range(len(shared))]
            spans = parts[0][0] if len(parts) == 1 else merged([s for x, _ in parts for s in x])
            out.append((spans, set().union(*(n for _, n in parts))))
        return out

    return run


def judged(docs: DataFrame, items: DataFrame, window: int, share: int, block_words: int, cut: bool = False) -> DataFrame:
    """_row (all columns of ``docs``) and _j, a struct of FIELDS; kept_text is filled in if ``cut``."""
    spark = docs.sparkSession
    blocks = item_blocks(items, block_words)
    first = list(islice(blocks, TOGETHER))
    more = list(islice(blocks, 1))
    rows = docs.select(F.struct("*").alias("_row"))
    if not more:
        run = streamed(spark, first, window)

        @F.pandas_udf(FIELDS)
        def judge_texts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in texts:
                lists = [words_of(x) for x in batch]
                out = []
                for text, words, (spans, names) in zip(batch, lists, run(lists), strict=True):
                    out.append((*judge(len(words), spans, names, share), without(text, spans) if cut and text is not None else None))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in FIELDS.split(", ")])

        return rows.select("_row", judge_texts(F.col("_row.text")).alias("_j"))

    # In passes: equal texts are found equal things, so findings are of texts, named by two hashes.
    name = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    texts = docs.select("text", name.alias("_name")).where("text is not null")
    found, together = None, first
    while together:
        own = written(hits_of(texts, streamed(spark, together, window)), "decontam-hits")
        found = own if found is None else found.unionByName(own)
        together = [*more, *islice(blocks, TOGETHER - len(more))]
        more = []
    # Of one text: a row a pass and item at most, which the passes' number and the items bound.
    hits = written(found.groupBy("_name").agg(F.flatten(F.collect_set("spans")).alias("_spans"), F.flatten(F.collect_set("names")).alias("_names")), "decontam-found")

    @F.pandas_udf(FIELDS)
    def judge_found(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts_, all_spans, all_names in batches:
            out = []
            for text, spans, names in zip(texts_, all_spans, all_names, strict=True):
                spans = merged([(s["lo"], s["hi"]) for s in spans]) if spans is not None else []
                names = set(names) if names is not None else set()
                out.append((*judge(len(words_of(text)), spans, names, share), without(text, spans) if cut and text is not None else None))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FIELDS.split(", ")])

    named = rows.withColumn("_name", F.struct(F.xxhash64("_row.text").alias("a"), F.xxhash64(F.lit(1), "_row.text").alias("b")))
    return named.join(hits, "_name", "left").select("_row", judge_found("_row.text", "_spans", "_names").alias("_j"))


def hits_of(texts: DataFrame, run) -> DataFrame:
    """_name, spans and names of the texts that the blocks hit; equal texts once."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, (spans, names) in zip(pdf["_name"], run([words_of(x) for x in pdf["text"]]), strict=True):
                if spans:
                    out.append((name, [{"lo": lo, "hi": hi} for lo, hi in spans], sorted(names)))
            yield pd.DataFrame(out, columns=["_name", "spans", "names"])

    return texts.mapInPandas(found, f"_name struct<a:long,b:long>, spans {FOUND}, names array<string>").dropDuplicates(["_name"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs``; no shuffle of texts where the items fit
    a pass."""
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return judged(docs.select("doc_id", "text"), items, window, share, block_words).select("_row.doc_id", *[F.col(f"_j.{n}").alias(n) for n in names])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the contaminated rows; all columns, texts below the limit untouched."""
    return judged(docs, items, window, share, block_words).where("not _j.contaminated").select("_row.*")


def cut_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, contaminated and the text without its hit spans."""
    done = judged(docs.select("doc_id", "text"), items, window, share, block_words, cut=True)
    return done.select("_row.doc_id", F.col("_j.contaminated").alias("contaminated"), F.col("_j.kept_text").alias("text"))
