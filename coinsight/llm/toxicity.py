"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts their common three-letter subsequences, gaps
lowering the weight, so that inserted characters keep most of a word's
likeness; a power of it sets words of one stem apart from others. The kernel of
two sentences is the sum over their pairs of words. Landmarks are words of the
labelled training documents; a sentence's kernel values with them, multiplied
by the inverse root of the landmarks' own kernel matrix, are its Nyström
features. A linear machine over them judges sentences. Labels are given per
document, so training alternates between choosing the worst sentence of each
toxic document and fitting. A document scores as its worst sentence, put on a
probability scale by a calibration that weighs each training document by the
inverse of its label's sampling rate, so that scores mean the same however
many labels there are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SPAN = 6  # characters that one subsequence may reach over
DECAY = 0.6
POWER = 4  # of the kernel of words
FLOOR = 0.3  # kernel values below count as none; their power is under 0.01
RIDGE = 1e-4
LANDMARKS = 96
LEAST_Z = 4.5  # standard errors by which a landmark's share must differ
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 2000  # labelled training documents
THRESHOLD = 0.3
CACHE = 400_000
TURN = 1000  # words whose kernel values are taken at once; arrays of more leave the processor's cache
FIRST, LAST = 230, 231  # codes of a word's borders
TRIPLES = 32749  # a prime; three codes are hashed below it
FACTORS = (20011, 307, 17)
TERMS = np.array([np.r_[3 * TRIPLES, np.arange(1, 256) * f % TRIPLES] for f in FACTORS], np.int32)  # by code, what it adds to a hash; 0 lifts the sum beyond all
MAX_SENTENCE = 64  # words; longer sentences are taken in parts
MAX_WORD = 64  # longer words are taken in overlapping parts of this length
SENTENCE = re.compile(r"[.!?]+\s+|\n+|\s*\|\s*")
PLAIN = re.compile(r"[.!?\n](?:(?<=\n)\n*|(?<=[.!?])[.!?]*\s+)")  # the same in texts without a bar, faster
SPELLED = re.compile(r"(?<!\S)(?:\w\s+){3,}\w(?!\S)")
_CODES = np.full(0x110000, -1, np.int16)  # by code point; -1 was not met yet


def _code(c: str) -> int:
    """1 to 26 for a to z in either case, 27 to 229 for other letters, else 0."""
    low = c.lower()[:1]
    return ord(low) - 96 if "a" <= low <= "z" else (27 + ord(low) % 203 if low.isalpha() else 0)


def _coded(words: list[str], gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words between their borders, and where each begins.

    ``gap`` zeros follow each word.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    if (new := np.unique(points[_CODES[points] < 0])).size:
        _CODES[new] = [_code(chr(p)) for p in new]
    length = np.array([len(w) for w in words])
    start = np.cumsum(length + 2 + gap) - length - 2 - gap
    out = np.zeros(int(length.sum()) + len(words) * (2 + gap), np.int64)
    out[start], out[start + length + 1] = FIRST, LAST
    out[np.repeat(start + 1 - np.cumsum(length) + length, length) + np.arange(len(points))] = _CODES[points]
    return out, start


def sentences(text: str | None) -> list[list[str]]:
    """Sentences of a text as lower-cased words; spelled-out words are joined."""
    out = []
    for s in (SENTENCE if "|" in text else PLAIN).split(text.lower()) if text else ():
        if " " in s and SPELLED.search(s):
            s += " " + " ".join("".join(m[0].split()) for m in SPELLED.finditer(s))
        w = s.split()
        out += [w[i : i + MAX_SENTENCE] for i in range(0, len(w), MAX_SENTENCE)]
    return out


def _parts(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Words cut to at most MAX_WORD characters, and whose part each is."""
    parts, owner = [], []
    for k, w in enumerate(words):
        if len(w) <= MAX_WORD:
            parts.append(w)
            owner.append(k)
        else:
            found = [w[i : i + MAX_WORD] for i in range(0, len(w) - SPAN, MAX_WORD - SPAN)]
            parts += found
            owner += [k] * len(found)
    return parts, np.array(owner)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, three-letter subsequence and weight, for words of unit length."""
    length = np.array([len(w) + 2 for w in words])
    c, _ = _coded(words)
    owner = np.repeat(np.arange(len(words)), length)
    end = np.repeat(np.cumsum(length), length)
    place = np.arange(len(c))
    keys, weights = [], []
    for j in range(1, SPAN - 1):
        for k in range(j + 1, SPAN):
            at = place[place + k < end]
            a, b, d = c[at], c[at + j], c[at + k]
            good = (a > 0) & (b > 0) & (d > 0)
            keys.append(owner[at[good]] << 15 | (a[good] * FACTORS[0] + b[good] * FACTORS[1] + d[good] * FACTORS[2]) % TRIPLES)
            weights.append(np.full(int(good.sum()), DECAY ** (k - 2)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    if not len(key):
        return key, key, weight
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, weight = key[new], np.add.reduceat(weight, new)
    word = key >> 15
    norm = np.sqrt(np.bincount(word, weight * weight, len(words)))
    return word, key & 32767, weight / norm[word]


class Machine:
    """Landmarks, the linear machine over them, and the calibration."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        n = len(landmarks)
        word, seq, weight = subsequences(landmarks) if n else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        # By subsequence, the landmarks that have it and its weight in them.
        order = np.argsort(seq, kind="stable")
        self.of_seq, self.seq_weight = word[order], weight[order]
        self.seq_at = np.searchsorted(seq[order], np.arange((1 << 15) + 1))
        some = np.zeros(TRIPLES, bool)
        some[seq] = True
        self.met = np.r_[np.tile(some, 3), np.zeros(9 * TRIPLES, bool)]  # by sum of TERMS
        values, vectors = np.linalg.eigh(self.evidence(landmarks)) if n else (np.zeros(0), np.zeros((0, 0)))
        self.white = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
        self.weight, self.bias = np.zeros(n), 0.0
        self.slope, self.offset = 0.0, 0.0
        self.knots: tuple[np.ndarray, np.ndarray] | None = None
        self._known: set[str] = set()
        self._told: dict[str, float] = {}  # what those with evidence add

    def __getstate__(self):
        return self.__dict__ | {"_known": set(), "_told": {}}

    def _shared(self, word: np.ndarray, seq: np.ndarray, weight: np.ndarray, n_words: int) -> np.ndarray:
        """Products of the weights of words with those of the landmarks, added up."""
        n = len(self.landmarks)
        lists = self.seq_at[seq + 1] - self.seq_at[seq]
        some = np.flatnonzero(lists)
        word, weight, lists, first = word[some], weight[some], lists[some], self.seq_at[seq[some]]
        at = np.repeat(first - np.cumsum(lists) + lists, lists) + np.arange(lists.sum())
        cell = np.repeat(word, lists) * n + self.of_seq[at]
        return np.bincount(cell, np.repeat(weight, lists) * self.seq_weight[at], n_words * n).reshape(-1, n)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel values of words with the landmarks, 1 for equal words.

        Subsequences that no landmark has are passed over.
        """
        n = len(self.landmarks)
        out = np.zeros((len(words), n))
        if len(words) and n:
            parts, owner = _parts(words)
            got = self._shared(*subsequences(parts), len(parts))
            np.maximum.at(out, owner, got) if len(parts) > len(words) else out.__setitem__(owner, got)
        return out

    def near(self, words: list[str]) -> np.ndarray:
        """Places of all words with a kernel value of FLOOR, and of few others.

        A word's subsequences are taken as they come. Only its length needs
        repeated ones added up first, and is the smaller without that, so the
        value compared is at least the kernel's. Words that the kernel takes in
        parts always stay.
        """
        short = np.flatnonzero(np.array([len(w) for w in words], int) <= MAX_WORD)
        if not len(short) or not self.landmarks:
            return np.arange(len(words))
        c, start = _coded([words[i] for i in short], SPAN - 1)
        owner = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(c)]))
        a, b, d = (t[c] for t in TERMS)
        size, places, seqs, weights = np.zeros(len(c), np.float32), [], [], []
        for j in range(1, SPAN - 1):
            for k in range(j + 1, SPAN):
                n = len(c) - k
                total = a[:n] + b[j : j + n] + d[k:]
                size[:n] += (total < 3 * TRIPLES) * np.float32(DECAY ** (2 * k - 4))
                places.append(np.flatnonzero(self.met[total]))
                seqs.append(total[places[-1]] % TRIPLES)
                weights.append(np.full(len(places[-1]), DECAY ** (k - 2)))
        got = self._shared(owner[np.concatenate(places)], np.concatenate(seqs), np.concatenate(weights), len(start)).max(1)
        far = short[got < 0.999 * FLOOR * np.sqrt(np.add.reduceat(size, start)) + 1e-12]
        return np.delete(np.arange(len(words)), far)

    def evidence(self, words: list[str]) -> np.ndarray:
        """The power of the kernel values, which the sentence kernel adds up."""
        out, near = np.zeros((len(words), len(self.landmarks))), self.near(words)
        k = np.minimum(self.kernel([words[i] for i in near]), 1)
        out[near] = np.where(k < FLOOR, 0, k**POWER)
        return out

    def describe(self, parts: list[list[str]], row: dict[str, int], kept: np.ndarray) -> np.ndarray:
        """Kernel values of a document's sentences with the landmarks.

        Each word that has evidence counts as a sentence too; sentences without
        any share one row of zeros. ``row`` numbers the words in ``kept``; 0 is
        a word without evidence.
        """
        rows, empty = [], not parts
        for s in parts:
            found = [k for w in s if (k := row[w])]
            if found:
                rows.append(kept[found].sum(0))
                rows += list(kept[sorted(set(found))]) if len(found) > 1 else []
            else:
                empty = True
        return np.array(rows + [np.zeros(len(self.landmarks))] * empty)

    def decide(self, z: np.ndarray) -> np.ndarray:
        """Signed distance of sentences from the border."""
        return (z @ self.white) @ self.weight + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        """Calibrated score of a document's worst margin.

        Mostly the share of toxic training documents near that margin, made
        monotone; a little of a logistic curve keeps margins apart.
        """
        smooth = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))
        return smooth if self.knots is None else 0.9 * np.interp(margin, *self.knots) + 0.1 * smooth

    def train(self, docs: list[tuple[list[list[str]], int]], rates: tuple[float, float] = (1.0, 1.0), rounds: int = 4) -> None:
        """Fit machine and calibration on labelled documents.

        ``rates``: the shares of other and of toxic documents that were drawn.
        """
        row, kept = {}, [np.zeros((1, len(self.landmarks)))]
        words = list(dict.fromkeys(w for d, _ in docs for s in d for w in s))
        for i in range(0, len(words), TURN):
            z = self.evidence(words[i : i + TURN])
            some = np.cumsum(z.any(1))
            row.update(zip(words[i : i + TURN], np.where(z.any(1), some + sum(map(len, kept)) - 1, 0).tolist(), strict=True))
            kept.append(z[z.any(1)])
        kept = np.concatenate(kept)
        described = [self.describe(d, row, kept) @ self.white for d, _ in docs]
        y = np.array([t for _, t in docs])
        if y.min(initial=1) == y.max(initial=0) or not len(self.landmarks):
            self.offset = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
            return
        share = np.where(y == 1, 1 / rates[1], 1 / rates[0])
        share *= len(y) / share.sum()
        clean = np.unique(np.concatenate([x for x, t in zip(described, y, strict=True) if not t]).round(5), axis=0)
        toxic = [x for x, t in zip(described, y, strict=True) if t]
        chosen = np.array([x[np.linalg.norm(x, axis=1).argmax()] for x in toxic])
        weighed = np.ones(len(chosen))
        for _ in range(rounds):
            x = np.concatenate([chosen, clean])
            t = np.r_[np.ones(len(chosen)), -np.ones(len(clean))]
            cost = np.r_[0.5 * weighed / weighed.sum(), np.full(len(clean), 0.5 / len(clean))]
            w = np.zeros(x.shape[1] + 1)
            full = np.c_[x, np.ones(len(x))]
            for _ in range(30):  # Newton steps of the squared hinge
                out = 1 - t * (full @ w)
                on = out > 0
                a = (full[on].T * cost[on]) @ full[on] + RIDGE * np.diag(np.r_[np.ones(len(w) - 1), 1e-6])
                step = np.linalg.solve(a, (full[on].T * cost[on]) @ t[on]) - w
                w += step
                if np.abs(step).max() < 1e-8:
                    break
            self.weight, self.bias = w[:-1], float(w[-1])
            # The worst sentence of each toxic document, and those that few
            # sentences of other documents reach.
            above = np.quantile(clean @ self.weight, 0.99)
            taken = [np.unique(np.r_[(m := x @ self.weight).argmax(), np.flatnonzero(m > above)]) for x in toxic]
            chosen = np.concatenate([x[k] for x, k in zip(toxic, taken, strict=True)])
            weighed = np.concatenate([np.full(len(k), 1 / len(k)) for k in taken])
        margin = np.array([(x @ self.weight).max() + self.bias for x in described])
        slope, offset = 1.0, 0.0
        design = np.c_[margin, np.ones(len(margin))]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ [slope, offset], -30, 30)))
            h = (design.T * (share * p * (1 - p))) @ design + 1e-3 * np.eye(2)
            d = np.linalg.solve(h, design.T @ (share * (y - p)) - 1e-3 * np.array([slope, offset]))
            slope, offset = slope + d[0], offset + d[1]
        self.slope, self.offset = max(0.0, float(slope)), float(offset)
        self.knots = _monotone(margin, y, share)

    def forget(self) -> None:
        """Let go of the words met so far."""
        self._known.clear()
        self._told.clear()

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Score of each whole text.

        Features are sums over words, so each word adds one number to the
        margin of its sentence.
        """
        known, told, out = self._known, self._told, np.zeros(len(texts))
        toward = self.white @ self.weight
        for i in range(0, len(texts), 256):
            docs = [sentences(t) for t in texts[i : i + 256]]
            words = set().union(*(s for d in docs for s in d))
            new = words.difference(known)
            if len(known) + len(new) > CACHE:
                self.forget()
                new = words
            known |= new
            new = list(new)
            for k in range(0, len(new), TURN):
                part = new[k : k + TURN]
                z = self.evidence(part)
                some = np.flatnonzero(z.any(1))
                told.update(zip([part[j] for j in some], (z[some] @ toward).tolist(), strict=True))
            none, get = told.keys().isdisjoint, told.get
            out[i : i + 256] = [max((0.0 if none(s) else sum(get(w, 0.0) for w in s) for s in d), default=0.0) for d in docs]
        return self.probability(out + self.bias)


def _monotone(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising share of ``y`` over ``x`` by pooling adjacent violators.

    ``share``: how many rows each row stands for.
    """
    blocks: list[list[float]] = []  # sum of x, sum of y, size
    for k in np.argsort(x, kind="stable"):
        blocks.append([x[k] * share[k], y[k] * share[k], share[k]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.1) / (b[2] + 0.2) for b in blocks])


def choose_landmarks(docs: list[tuple[list[list[str]], int]], n: int = LANDMARKS) -> list[str]:
    """Words that differ most between toxic and other documents."""
    of = [Counter(), Counter()]
    size = [0, 0]
    bare: dict[str, str] = {}
    for d, t in docs:
        size[t] += 1
        found = {w for s in d for w in s}
        bare.update((w, "".join(c for c in w if _code(c))) for w in found if w not in bare)
        of[t].update({bare[w] for w in found})
    if not all(size):
        return []
    rank = {}
    for w in set(of[1]):
        a, b = of[1][w] / size[1], of[0][w] / size[0]
        if 3 <= len(w) <= MAX_WORD and of[1][w] > 2 and a > b:
            p = (of[1][w] + of[0][w]) / (size[0] + size[1])
            rank[w] = (a - b) / math.sqrt(p * (1 - p) * (1 / size[0] + 1 / size[1]) + 1e-12)
    return sorted((w for w in rank if rank[w] >= LEAST_Z), key=lambda w: (-rank[w], w))[:n]


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = (SAMPLE_TOXIC, SAMPLE_CLEAN)) -> Machine:
    """A machine learned from labelled documents, about ``sample`` of each label.

    Documents are drawn by a hash of the id, so the sample does not depend on
    the order of rows. A document that is labelled more than once counts as
    toxic if any label says so; of several texts of one id the smallest
    teaches. Null labels and null ids teach nothing; without labels of both
    kinds, every text gets one score.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("__toxic").count().collect()}
    share = F.lit(0)
    for label, most in ((1, sample[0]), (0, sample[1])):
        share = F.when(F.col("__toxic") == label, F.lit(int(min(1.0, most / max(1, counts.get(label, 0))) * 10**12))).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(10**12)) < share)
    # About sum(sample) rows of two numbers: small at any size of input.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("__toxic").alias("__toxic")).collect()
    found = sorted((sentences(r["text"]), int(r["__toxic"] == 1)) for r in rows)
    machine = Machine(choose_landmarks(found))
    machine.train(found, tuple(min(1.0, most / max(1, counts.get(label, 0))) for label, most in ((0, sample[1]), (1, sample[0]))))
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score and predicted of each row.

    Null texts count as empty, long ones are scored whole, repeated rows are
    scored alike and kept; an empty table gives no rows. Other columns are left
    out, whatever their names.
    """
    ddl = "doc_id long, score double, predicted int"
    schema = shared.pa_schema(docs.sparkSession, ddl)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(shared.tidied(run, lambda: sent.value.forget()), ddl)


def score_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from documents whose remainder modulo 4 is not 2, score all."""
    machine = fit(docs.filter(shared.remainder("doc_id", 4) != 2), labels.filter(shared.remainder("doc_id", 4) != 2))
    return score(docs, machine).select("doc_id", (shared.remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
