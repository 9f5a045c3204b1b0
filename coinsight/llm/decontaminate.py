"""Benchmark decontamination by BM25 retrieval over test items.

Test items form an inverted index with block maxima. Every training document
is cut into overlapping passages, each passage is a query, and block-max WAND
retrieves every item whose score reaches a share of the item's score against
itself. Retrieved items are verified: word trigrams of both the question (the
first two thirds of the item) and the answer (the rest) must recur in the
passage, or most trigrams of the whole item, wherever the missing ones stand,
or most of its words in a row, other words changed, left out or put between.

A passage is skipped before retrieval only when, for every group of items, the
sum of its terms' greatest impacts in that group stays below the threshold, so
no item is lost by it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

K1, B = 1.2, 0.75
SHARE = 0.6  # of an item's score against itself
OVERLAP = 0.5  # of the trigrams of question and of answer
WHOLE = 0.75  # of the trigrams of the whole item, whatever its parts hold
ALIGNED = 0.8  # of the words of the whole item, in order and close together
BLOCK = 64  # postings under one block maximum
GROUPS = 64  # groups of items with bounds of their own before retrieval
MAX_INDEX_CHARS = 50_000_000  # of item text in one index; more items go in turns
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    """Letters and digits of a text, A-Z lower-cased, as words in UTF-8."""
    return WORD.findall(text.encode().lower()) if text else []


def trigrams(w: list[bytes]) -> set[tuple[bytes, ...]]:
    """Distinct runs of three words; shorter texts are one run."""
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def aligned(item: list[bytes], inside: list[bytes]) -> int:
    """Most words of an item that stand in order in a stretch of its length.

    Stretches begin where a trigram of the item recurs at its own distance, so
    words scattered over a passage do not count.
    """
    places: dict[tuple[bytes, ...], list[int]] = {}
    for j in range(len(inside) - 2):
        places.setdefault(tuple(inside[j : j + 3]), []).append(j)
    starts = {j - i for i in range(len(item) - 2) for j in places.get(tuple(item[i : i + 3]), ())}
    best, n, slack = 0, len(item), max(1, len(item) // 10)
    for s in starts:
        part = inside[max(0, s - slack) : max(0, s + n + slack)]
        row = [0] * (len(part) + 1)
        for x in item:  # longest common subsequence
            last = 0
            for j, y in enumerate(part, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        best = max(best, row[-1])
    return best


class Statistics(NamedTuple):
    """What BM25 knows of all test items, whichever of them an index holds."""

    items: int
    mean: float  # words of an item
    longest: int
    frequency: dict[bytes, int]  # items of each word of an index

    @classmethod
    def of(cls, found: list[list[bytes]]) -> Statistics:
        """Statistics of the words of non-empty items."""
        size = [len(w) for w in found]
        return cls(len(found), sum(size) / max(1, len(found)), max(size, default=1), Counter(t for w in found for t in set(w)))


class ItemIndex:
    """Inverted index of test items; impacts are shares of an item's own score."""

    def __init__(self, items: list[tuple[int, str | None]], known: Statistics | None = None):
        """``known``: statistics of all items, if these are some of them."""
        kept = [(i, w) for i, t in items if (w := words(t))]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        n, mean, self.longest, df = known or Statistics.of(self.words)
        lists: dict[bytes, list[tuple[int, float]]] = {}
        for k, w in enumerate(self.words):
            tf = Counter(w)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                lists.setdefault(t, []).append((k, x / own))
        self.term = {t: i + 1 for i, t in enumerate(lists)}
        self.docs = [[], *([k for k, _ in p] for p in lists.values())]
        self.impacts = [[], *([x for _, x in p] for p in lists.values())]
        self.most = np.array([0.0, *(max(x for _, x in p) for p in lists.values())])
        # Greatest impact of each term in each group of neighbouring items.
        self.groups = np.zeros((len(self.most), GROUPS), np.float32)
        for t, p in enumerate(lists.values(), 1):
            for k, x in p:
                g = k * GROUPS // len(kept)
                self.groups[t, g] = max(self.groups[t, g], x)
        self.block_most = [[max(p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for p in self.impacts]
        self.block_last = [[p[min(i + BLOCK, len(p)) - 1] for i in range(0, len(p), BLOCK)] for p in self.docs]
        cut = [-(-2 * len(w) // 3) for w in self.words]
        self.question = [trigrams(w[:c]) for w, c in zip(self.words, cut, strict=True)]
        self.answer = [trigrams(w[c:]) for w, c in zip(self.words, cut, strict=True)]

    def search(self, terms: list[int], threshold: float = SHARE) -> list[tuple[int, float]]:
        """Every item whose score is at least the threshold (block-max WAND)."""
        least = threshold - 1e-9
        lists = [[self.docs[t][0], 0, t] for t in terms]  # item now, position, term
        found = []

        def advance(c: list[int], item: int) -> bool:
            docs = self.docs[c[2]]
            c[1] = bisect_left(docs, item, c[1])
            if c[1] < len(docs):
                c[0] = docs[c[1]]
                return True
            return False

        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(lists):
                bound += self.most[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            bound, after = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 60
            for c in lists[: pivot + 1]:
                b = bisect_left(self.block_last[c[2]], item)
                if b < len(self.block_last[c[2]]):
                    bound += self.block_most[c[2]][b]
                    after = min(after, self.block_last[c[2]][b] + 1)
            if bound < least:
                target = max(after, item + 1)
                lists = [c for k, c in enumerate(lists) if k > pivot or advance(c, target)]
            elif lists[0][0] == item:
                score = sum(self.impacts[c[2]][c[1]] for c in lists[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                lists = [c for k, c in enumerate(lists) if k > pivot or advance(c, item + 1)]
            else:
                lists = [c for k, c in enumerate(lists) if k > pivot or c[0] >= item or advance(c, item)]
        return found

    def passages(self, w: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """Start, end and terms of each passage that can reach the threshold.

        A passage is two neighbouring blocks of as many words as the longest
        item has, so every run of that length lies inside one.
        """
        get = self.term.get
        terms = np.array([get(x, 0) for x in w], np.int64)
        at = np.flatnonzero(terms)
        if not at.size:
            return
        size = self.longest
        keys = np.unique(at // size * len(self.most) + terms[at])
        block = keys // len(self.most)
        new = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        own = np.zeros(((len(w) - 1) // size + 2, GROUPS), np.float32)
        own[block[new]] = np.add.reduceat(self.groups[keys % len(self.most)], new)
        for k in np.flatnonzero((own[:-1] + own[1:]).max(1) >= SHARE - 1e-5):
            inside = terms[k * size : (k + 2) * size]
            yield int(k) * size, min(len(w), (int(k) + 2) * size), np.unique(inside[inside > 0]).tolist()

    def whole(self, item: int, inside: list[bytes], grams: set[tuple[bytes, ...]]) -> bool:
        """Whether most of an item stands in a passage."""
        w = self.words[item]
        own = trigrams(w)
        found = len(own & grams)
        if found >= WHOLE * len(own):
            return True
        # A word changed takes three trigrams at most, so many words in a row
        # leave some; without any there is nothing to align.
        return bool(found) and aligned(w, inside) >= ALIGNED * len(w)

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """By item: best score, and overlap of question and answer with it."""
        w, out = words(text), {}
        for start, end, terms in self.passages(w):
            hits = self.search(terms)
            if not hits:
                continue
            grams = trigrams(w[start:end])
            for item, score in hits:
                q = len(self.question[item] & grams) / max(1, len(self.question[item]))
                a = len(self.answer[item] & grams) / len(self.answer[item]) if self.answer[item] else 1.0
                if q >= OVERLAP and a >= OVERLAP or self.whole(item, w[start:end], grams):
                    out[item] = max(out.get(item, (0.0, 0.0, 0.0)), (score, q, a))
        return {self.ids[k]: v for k, v in out.items()}


def indexes(items: DataFrame) -> list[ItemIndex]:
    """Indexes over all items, of bounded size each.

    Number, mean length and word frequencies are those of all items together,
    so scores do not depend on how items are dealt to indexes.
    """
    spark, ddl = items.sparkSession, "turn int, size long, words array<binary>"
    items = items.select("item_id", "text").filter("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    turns = -(-chars // MAX_INDEX_CHARS) or 1
    turn = F.pmod(F.xxhash64("item_id"), F.lit(turns)).cast("int")
    schema = shared.pa_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in found], pa.int64()), pa.array([list(set(w)) for w in found], schema.field("words").type)], schema=schema)

    of_item = items.select(turn.alias("turn"), "text").mapInArrow(run, ddl).filter("size > 0")
    n, mean, longest = of_item.agg(F.count("*"), F.avg("size"), F.max("size")).first()
    word = of_item.select("turn", F.explode("words").alias("word"))
    frequency = word.groupBy("word").agg(F.count("*").alias("n"), F.collect_set("turn").alias("turns"))
    out = []
    for k in range(turns):
        rows = items.filter(turn == k).collect()  # of bounded size, as are their words
        df = {bytes(r["word"]): r["n"] for r in frequency.filter(F.array_contains("turns", k)).select("word", "n").collect()}
        out.append(ItemIndex(sorted((r["item_id"], r["text"]) for r in rows), Statistics(n, mean or 0.0, longest or 1, df)))
    return out


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of each leak.

    Every document is queried whole, however long. A document row gives one
    row per leaked item, so repeated rows give repeated rows; of passages with
    one score the last one's overlaps are given. Null and empty texts and items
    match nothing, empty tables give no rows. Other columns are left out.
    """
    ddl = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    schema = shared.pa_schema(docs.sparkSession, ddl)
    out = None
    for index in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, i, *v) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, v in sorted(sent.value.leaks(t).items())]
                columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

        part = docs.select("doc_id", "text").mapInArrow(shared.tidied(run), ddl)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a test item.

    The decision is made where the text is read, so no join is needed.
    """
    from pyspark.sql.types import BooleanType

    kept = docs
    for index in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        @F.arrow_udf(BooleanType())
        def clean(texts, sent=sent):
            return pa.array([not sent.value.leaks(t) for t in texts.to_pylist()], pa.bool_())

        kept = kept.filter(clean(F.col("text")))
    return kept
