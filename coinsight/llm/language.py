"""Language identification by a linear-chain conditional random field.

Each word gets a score per language from hashed features: n-grams of two to
four characters with word borders (so prefixes and suffixes have their own)
and the word itself as a lexicon entry. Learned transitions join the words of
a document, and forward-backward gives each word's language in its context, so
switches inside a text are labelled too. A document's language is the one with
the largest mean over its words; that mean is the score.

Training takes whole documents of a bounded sample for each language, and
sequences that switch between two of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

FEATURE_BITS = 17
SAMPLE_DOCS = 300  # labelled documents for each language
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
CACHE = 150_000
CHUNK_WORDS = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-cased words of a text; none if it has no letter."""
    found = WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def features(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, one after another, and where each word starts."""
    joined = "".join(f"\x02{w}\x03" for w in batch)
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for w in batch])
    start = np.r_[0, np.cumsum(length)[:-1]]
    owner = np.repeat(np.arange(len(batch)), length)
    left = np.repeat(start + length, length) - np.arange(len(c))  # characters to the word's end
    keys, owners = [], []
    gram = c * _P
    for n in (2, 3, 4):
        gram = gram[:-1] * np.uint64(31) + c[n - 1 :] * _P if len(gram) > 1 else gram[:0]
        fits = left[: len(gram)] >= n
        keys.append(gram[fits] + np.uint64(n))
        owners.append(owner[: len(gram)][fits])
    power = np.cumprod(np.full(int(length.max()) + 1, 1_000_003, np.uint64))
    whole = np.add.reduceat(c * _P * power[np.arange(len(c)) - start[owner]], start)
    keys.append(whole + np.uint64(7))
    owners.append(np.arange(len(batch)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(owner, kind="stable")
    at = np.searchsorted(owner[order], np.arange(len(batch)))
    return (key >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)[order], at


class Field:
    """Weights of the features and of the transitions, and inference."""

    def __init__(self, languages: list[str]):
        n = len(languages)
        self.languages = languages
        self.weights = np.zeros((1 << FEATURE_BITS, n), np.float32)
        self.transitions = np.eye(n, dtype=np.float32) * 2
        self.start = np.zeros(n, np.float32)
        self._row: dict[str, int] = {}
        self._scores = np.zeros((0, n), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"_row": {}, "_scores": self._scores[:0]}

    def forget(self) -> None:
        """Let go of the words met so far."""
        self._row, self._scores = {}, self._scores[:0]

    def scores(self, batch: list[str]) -> np.ndarray:
        """Score per language of each word."""
        if not batch:
            return np.zeros((0, len(self.languages)), np.float32)
        f, at = features(batch)
        return np.add.reduceat(self.weights[f], at)

    def rows(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Rows of ``_scores`` for the words of documents; new words are added."""
        if len(self._row) > CACHE:
            self.forget()
        row, out, new = self._row, [], []
        for doc in docs:
            for w in doc:
                if w not in row:
                    row[w] = len(row)
                    new.append(w)
            out.append(np.array([row[w] for w in doc], np.int64))
        parts = [self.scores(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
        self._scores = np.concatenate([self._scores, *parts])
        return out

    def means(self, docs: list[list[str]]) -> np.ndarray:
        """Mean posterior per language over the words of non-empty documents."""
        n = len(self.languages)
        rows = self.rows(docs)
        length = np.array([len(r) for r in rows])
        order = np.argsort(-length, kind="stable")
        length = length[order]
        flat = np.concatenate([rows[i] for i in order])
        first = np.r_[0, np.cumsum(length)[:-1]]
        emit = self._scores[flat]
        emit = np.exp(emit - emit.max(1, keepdims=True))
        move = np.exp(self.transitions - self.transitions.max())
        begin = np.exp(self.start - self.start.max())
        live = [int(x) for x in np.searchsorted(-length, -np.arange(int(length[0])), side="left")]
        forward = np.empty_like(emit)
        a = emit[first] * begin
        a /= a.sum(1, keepdims=True)
        forward[first] = a
        for t in range(1, int(length[0])):
            at = first[: live[t]] + t
            a = (a[: live[t]] @ move) * emit[at]
            a /= a.sum(1, keepdims=True)
            forward[at] = a
        total = np.zeros((len(docs), n))
        b = np.ones((len(docs), n), np.float32)
        for t in range(int(length[0]) - 1, -1, -1):
            k = live[t]
            at = first[:k] + t
            g = forward[at] * b[:k]
            g /= g.sum(1, keepdims=True)
            total[:k] += g
            back = (b[:k] * emit[at]) @ move.T
            b[:k] = back / back.sum(1, keepdims=True)
        out = np.empty_like(total)
        out[order] = total / length[:, None]
        return out

    def _gradient(self, emit: np.ndarray, gold: np.ndarray):
        """Posteriors and expected transitions of sequences (B x T x languages)."""
        size, steps, n = emit.shape
        e = np.exp(emit - emit.max(2, keepdims=True))
        move, begin = np.exp(self.transitions - self.transitions.max()), np.exp(self.start - self.start.max())
        f, b = np.empty_like(e), np.ones_like(e)
        f[:, 0] = e[:, 0] * begin
        f[:, 0] /= f[:, 0].sum(1, keepdims=True)
        for t in range(1, steps):
            x = (f[:, t - 1] @ move) * e[:, t]
            f[:, t] = x / x.sum(1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            x = (b[:, t + 1] * e[:, t + 1]) @ move.T
            b[:, t] = x / x.sum(1, keepdims=True)
        g = f * b
        g /= g.sum(2, keepdims=True)
        pairs = f[:, :-1, :, None] * move * (e[:, 1:] * b[:, 1:])[:, :, None, :]
        pairs /= pairs.sum((2, 3), keepdims=True)
        seen = np.eye(n, dtype=np.float32)[gold]
        d_move = pairs.sum((0, 1)) - np.einsum("bti,btj->ij", seen[:, :-1], seen[:, 1:])
        return g - seen, d_move, (g[:, 0] - seen[:, 0]).sum(0)

    def train(self, docs: list[tuple[list[str], int]], epochs: int = 3, steps: int = 32, size: int = 64, seed: int = 5) -> None:
        """Adaptive gradient over sequences of whole documents and of switches."""
        rnd = np.random.default_rng(seed)
        runs = [(w[i : i + steps], y) for w, y in docs for i in range(0, len(w), steps)]
        if not runs or len(self.languages) < 2:
            return
        squares = np.full(self.weights.shape, 1e-3, np.float32)
        square_move, square_start = np.full(self.transitions.shape, 1e-3), np.full(self.start.shape, 1e-3)
        for _ in range(epochs):
            order = rnd.permutation(len(runs))
            for at in range(0, len(order), size):
                texts, gold = [], []
                for k in order[at : at + size]:
                    w, y = runs[k]
                    other, z = runs[rnd.integers(len(runs))]
                    cut = int(rnd.integers(8, 25)) if rnd.random() < 0.5 else steps
                    seq = [w[i % len(w)] for i in range(cut)] + [other[i % len(other)] for i in range(steps - cut)]
                    texts += seq
                    gold.append([y] * cut + [z] * (steps - cut))
                f, start = features(texts)
                emit = np.add.reduceat(self.weights[f], start).reshape(len(gold), steps, -1)
                d, d_move, d_start = self._gradient(emit, np.array(gold))
                d = d.reshape(-1, len(self.languages)) / len(gold)
                full = np.repeat(d, np.diff(np.r_[start, len(f)]), axis=0)
                used, inverse = np.unique(f, return_inverse=True)
                g = np.stack([np.bincount(inverse, full[:, k], len(used)) for k in range(full.shape[1])], 1).astype(np.float32)
                g += 1e-5 * self.weights[used]
                squares[used] += g * g
                self.weights[used] -= 0.2 * g / np.sqrt(squares[used])
                d_move, d_start = d_move / len(gold), d_start / len(gold)
                square_move += d_move * d_move
                square_start += d_start * d_start
                self.transitions -= (0.1 * d_move / np.sqrt(square_move)).astype(np.float32)
                self.start -= (0.1 * d_start / np.sqrt(square_start)).astype(np.float32)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field learned from text and non-null lang of ``docs``.

    About ``sample_docs`` whole documents of each language are taken, chosen
    by a hash of the id, so the sample does not depend on the order of rows.
    """
    docs = docs.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    field = Field(sorted(counts))
    if not counts:
        return field
    chosen = F.lit(False)
    for lang, n in counts.items():
        share = int(min(1.0, sample_docs / n) * 10**12)
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(10**12)) < share))
    rows = docs.filter(chosen).select("text", "lang").collect()
    of = {lang: k for k, lang in enumerate(field.languages)}
    field.train(sorted((words(r["text"]), of[r["lang"]]) for r in rows))
    return field


def _predictor(field: Field):
    """From texts to languages and scores."""

    def batch(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        held: list[list[str]] = []
        at: list[int] = []
        size = 0

        def flush():
            if held:
                for k, m in zip(at, field.means(held), strict=True):
                    best = int(m.argmax())
                    names[k], scores[k] = field.languages[best], min(1.0, float(m[best]))
            held.clear(), at.clear()

        for k, text in enumerate(texts):
            found = words(text) if field.languages else []
            if found:
                held.append(found)
                at.append(k)
                size += len(found)
                if size > CHUNK_WORDS:
                    flush()
                    size = 0
        flush()
        return names, scores

    return batch


def predict(docs: DataFrame, field: Field, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (all if None; text among them) and two more of each row.

    The language and its score are named by ``names``; columns named so are
    replaced. A null text, or one without a letter, is ``und`` with score 0.
    """
    kept = docs.select(*[c for c in (keep or docs.columns) if c not in names])
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    ddl = StructType([*kept.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    schema = pa_schema_of(ddl)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _predictor(sent.value)
        for batch in batches:
            found, scores = work(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return kept.mapInArrow(shared.tidied(run, lambda: sent.value.forget()), ddl)


def pa_schema_of(schema) -> pa.Schema:
    """The Arrow schema of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def predict_corpus(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``docs``.

    Documents whose remainder modulo 4 is not 2 teach. Null ids count as an
    empty id; null texts, and texts without a letter, are ``und`` with score 0;
    long texts are read whole. Repeated rows are kept and predicted alike; of
    languages with one mean the first in order of name is taken. Other columns
    are left out. Without labels every text is ``und``; an empty table gives
    no rows.
    """
    field = fit(docs.filter(shared.remainder("doc_id", 4) != 2))
    found = predict(docs, field, ["doc_id", "text"])
    return found.select("doc_id", (shared.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs`` without rows of unknown language or a score below ``least``."""
    field = fit(docs.filter(shared.remainder("doc_id", 4) != 2))
    marked = predict(docs, field, names=("__lang", "__score"))
    return marked.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).select(*docs.columns)
