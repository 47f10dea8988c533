"""Evaluation texts that leaked into documents: Wu-Manber search for seeds, then word alignment.

Symbols are normalised words. Of a passage of at least fifteen words with at most one word in seven changed, five
successive words are always intact, so all five-word patterns of the items are searched at once: a shift table over blocks of
two words skips places where no pattern can end, a bucket table by pattern hash selects the patterns at the others, and a
direct comparison confirms them. Around each confirmed seed, edit distances over words decide whether the passage is long
and clean enough.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayline.plans.materialize import materialize

SEED, BLOCK = 5, 2
MIN_WORDS, ONE_IN = 15, 7
#: A passage that is clean enough has a part of at most this many words beside a seed that is so too.
REACH, BAND = 28, 4
SHIFT_BITS = 20
CHUNK = 512
#: Letters of items searched in one pass over the documents; more items are searched in further passes, which find the same.
LETTERS_PER_PASS = 20_000_000
#: An opening sentence that at least this many items, and this share of all, have in common is an instruction.
SHARED_BY, SHARED_PART = 3, 0.1

_DROP = re.compile(r"[^\w\s]|_")


def words_of(text: str) -> list[str]:
    """Lower-case words without punctuation; what is only punctuation is no word."""
    return _DROP.sub("", text.lower()).split()


def opening(text: str) -> tuple[str, str]:
    """Words of the opening sentence, and the text behind it; no words where the text is one sentence.

    A sentence ends at a mark before white space, or with its line.
    """
    m = re.match(r"\s*.*?(?:[.!?:](?=\s)|\n)\s*(?=\S)", text)
    return (" ".join(words_of(m.group())), text[m.end() :]) if m else ("", text)


def without_instruction(items: DataFrame) -> DataFrame:
    """``(item_id, text)`` without the opening sentence that a clear share of all items have in common."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [opening(t) for t in batch["text"]]
            yield batch.assign(key=[k for k, _ in parts], rest=[r for _, r in parts])

    opened = items.mapInPandas(split, "item_id long, text string, key string, rest string")
    counts = opened.where("key <> ''").groupBy("key").agg(F.count_distinct("item_id").alias("n"))
    total = items.select("item_id").distinct().count()
    # at most 1/SHARED_PART openings
    shared = counts.where(F.col("n") >= max(SHARED_BY, SHARED_PART * total)).select("key", F.lit(True).alias("shared"))
    return opened.join(F.broadcast(shared), "key", "left").select("item_id", F.when(F.col("shared"), F.col("rest")).otherwise(F.col("text")).alias("text"))


class Patterns:
    """All seeds of the items with their shift and bucket tables."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.number: dict[str, int] = {}
        coded = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], np.int64) for ws in self.words]
        self.coded = coded
        grams, owner, place = [], [], []
        for k, c in enumerate(coded):
            if len(c) >= MIN_WORDS - MIN_WORDS // ONE_IN:
                w = np.lib.stride_tricks.sliding_window_view(c, SEED)
                grams.append(w)
                owner.append(np.full(len(w), k))
                place.append(np.arange(len(w)))
        self.grams = np.concatenate(grams) if grams else np.zeros((0, SEED), np.int64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.place = np.concatenate(place) if place else np.zeros(0, np.int64)
        self.shift = np.full(1 << SHIFT_BITS, SEED - BLOCK + 1, np.int64)
        for at in range(SEED - BLOCK + 1):
            np.minimum.at(self.shift, self._block(self.grams[:, at], self.grams[:, at + 1]), SEED - BLOCK - at)
        key = self._key(self.grams)
        order = np.argsort(key, kind="stable")
        self.grams, self.owner, self.place, self.key = self.grams[order], self.owner[order], self.place[order], key[order]

    @staticmethod
    def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & ((1 << SHIFT_BITS) - 1)

    @staticmethod
    def _key(grams: np.ndarray) -> np.ndarray:
        key = np.zeros(len(grams), np.int64)
        for k in range(SEED):
            key = key * 1_000_003 + grams[:, k]
        return key

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start places in the coded text and numbers of the patterns that stand there."""
        if len(text) < SEED or not len(self.key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # many windows move at once, one in each chunk; `at` is where a window ends
        first = np.arange(SEED - 1, len(text), CHUNK)
        last = np.minimum(first + CHUNK, len(text))
        at, found = first.copy(), []
        while len(at):
            step = self.shift[self._block(text[at - 1], text[at])]
            hit = at[step == 0]
            if len(hit):
                found.append(hit - SEED + 1)
            at = at + np.maximum(step, 1)
            live = at < last
            at, last = at[live], last[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.concatenate(found)
        window = text[start[:, None] + np.arange(SEED)]
        key = self._key(window)
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = high - low
        start = np.repeat(start, n)
        pattern = np.repeat(low - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
        same = (self.grams[pattern] == text[start[:, None] + np.arange(SEED)]).all(1)
        start, pattern = start[same], pattern[same]
        order = np.argsort(start, kind="stable")
        return start[order], pattern[order]


def _edits(item: list[int], doc: list[int]) -> list[int]:
    """Least edits that align the first k words of ``item`` with some beginning of ``doc``, for k = 0, 1, ..."""
    inf = 10**6
    width = 2 * BAND + 1
    row = [j - BAND if BAND <= j and j - BAND <= len(doc) else inf for j in range(width)]
    best = [0]
    for i in range(1, len(item) + 1):
        new = [inf] * width
        for j in range(width):
            d = i + j - BAND
            if d < 0 or d > len(doc):
                continue
            cost = row[j + 1] + 1 if j + 1 < width else inf
            if d:
                change = row[j] + (item[i - 1] != doc[d - 1])
                cost = change if change < cost else cost
                if j and new[j - 1] + 1 < cost:
                    cost = new[j - 1] + 1
            new[j] = cost
        row = new
        best.append(min(row))
    return best


def holds_passage(item: list[int], doc: list[int], item_at: int, doc_at: int, least: int = MIN_WORDS) -> bool:
    """Whether a passage of the item around an exact seed meets the length and the share of changed words."""
    a, b = item_at, doc_at
    while a and b and item[a - 1] == doc[b - 1]:
        a, b = a - 1, b - 1
    c, d = item_at, doc_at
    while c < len(item) and d < len(doc) and item[c] == doc[d]:
        c, d = c + 1, d + 1
    core = c - a
    if core >= least:
        return True
    left = _edits(item[max(0, a - REACH) : a][::-1], doc[max(0, b - REACH - BAND) : b][::-1])
    right = _edits(item[c : c + REACH], doc[d : d + REACH + BAND])
    return any(x + core + y >= least and left[x] + right[y] <= (x + core + y) // ONE_IN for x in range(len(left)) for y in range(max(0, least - core - x), len(right)))


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, item_id)`` of every document that holds a passage of an item; each pair once.

    Null and empty texts hold nothing, items with null texts leak nothing, and neither do items shorter than a passage.
    Texts are read whole. Repeated documents or items give one row. An item identifier that has several texts leaks if
    one of them does. An opening shared by a clear share of all items is no part of them. Empty tables give no rows; other columns are not read. Every task holds a block of items of about
    ``LETTERS_PER_PASS``; the documents are read once for each block.
    """
    spark = documents.sparkSession
    held = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()
    held = materialize(without_instruction(held))
    letters = held.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = int(letters // LETTERS_PER_PASS) + 1
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    found = None
    for k in range(passes):
        mine = held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        shared = spark.sparkContext.broadcast(sorted((r["item_id"], r["text"]) for r in mine.collect()))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            patterns = Patterns(shared.value)
            number = patterns.number
            coded_items = [c.tolist() for c in patterns.coded]
            for batch in batches:
                out: set[tuple[int, int]] = set()
                coded = [[number.get(w, 0) for w in words_of(t)] for t in batch["text"]]
                # a gap of unknown words between texts keeps windows from reaching over
                lengths = np.array([len(c) + SEED for c in coded], np.int64)
                flat = np.zeros(int(lengths.sum()), np.int64)
                begins = np.append(0, np.cumsum(lengths))
                for c, at in zip(coded, begins[:-1], strict=True):
                    flat[at : at + len(c)] = c
                place, pattern = patterns.search(flat)
                doc = np.searchsorted(begins, place, "right") - 1
                tried: set[tuple[int, int, int]] = set()
                ids = batch["doc_id"].tolist()
                for d, p, k in zip(doc.tolist(), place.tolist(), pattern.tolist(), strict=True):
                    owner, item_at, doc_at = int(patterns.owner[k]), int(patterns.place[k]), p - int(begins[d])
                    pair = (ids[d], patterns.ids[owner])
                    if pair in out:
                        continue
                    # seeds of one exact run are one seed
                    run = (d, owner, doc_at - item_at, doc_at - 1)
                    fresh = run not in tried
                    tried.add((d, owner, doc_at - item_at, doc_at))
                    if fresh and holds_passage(coded_items[owner], coded[d], item_at, doc_at):
                        out.add(pair)
                yield pd.DataFrame(sorted(out), columns=["doc_id", "item_id"]).astype("int64")

        part = docs.mapInPandas(search, "doc_id long, item_id long")
        found = part if found is None else found.unionByName(part)
    return found.distinct()
