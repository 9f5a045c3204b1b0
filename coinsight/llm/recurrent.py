"""Document log-likelihood by a gated recurrent language model.

Tokens are the words of the lower-cased text and one end. A count of every
token over all training documents gives the smoothed unigram score, the
model's vocabulary and the weights inside its output classes. The model is a
gated recurrent unit with a class-factored softmax, trained in numpy by
truncated backpropagation on all training documents, a share of them in each
round: every task trains a copy on its documents, and the copies are averaged by
their tokens. Scoring runs windows of steps over whole documents and carries
each document's state from window to window.

Words outside the vocabulary fall into buckets by their last two characters.
A bucket is a token of the model, and inside it words follow their smoothed
counts, so probabilities sum to one over all words and one unseen word per
bucket.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

END = b"\n"  # holds white space, so it is no word
VOCABULARY = 1024
BUCKETS = 62
CLASSES = 32
HIDDEN = 12
HEAD_WORDS = 1 << 17  # at most so many words' counts are known to every task; others are joined
ROUNDS = 2  # shares of the training documents, copies averaged after each
CACHE = 150_000  # words whose model token a task keeps
TRAIN_TOKENS = 400_000  # held by a task at once in training
WINDOW = 128
CHUNK_TOKENS = 4_000_000
STREAMS = 256  # sequences trained side by side
_ONES = np.ones(1 << 14, np.float32)  # a product with it adds up faster than sum


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, in UTF-8; split at ASCII white space."""
    return text.encode().lower().split() if text else []


def bucket(word: bytes) -> int:
    """The class of words that end alike."""
    return zlib.crc32(word.decode("utf-8", "replace")[-2:].encode()) % BUCKETS


def count_tokens(docs: DataFrame) -> DataFrame:
    """token and c of every word, and of the end, in ``docs`` (text column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
                counts[END] += 1
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(shared.tidied(run), "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Network:
    """A gated recurrent unit over token ids with a class-factored softmax."""

    def __init__(self, weight: np.ndarray, seed: int = 11):
        """``weight``: a positive count of each token id."""
        rnd = np.random.default_rng(seed)
        n, h = len(weight), HIDDEN
        self.width = -(-n // CLASSES)
        order = np.argsort(-weight, kind="stable")
        self.class_of = np.empty(n, np.int64)
        self.place_of = np.empty(n, np.int64)
        self.class_of[order] = np.arange(n) // self.width
        self.place_of[order] = np.arange(n) % self.width
        inner = np.full((CLASSES, self.width), -1e9, np.float32)
        total = np.bincount(self.class_of, weight, CLASSES)
        inner[self.class_of, self.place_of] = np.log(weight / total[self.class_of])
        self.p = {
            "x": rnd.normal(0, 0.1, (n, 3 * h)),
            "u": rnd.normal(0, 0.2, (h, 2 * h)),
            "un": rnd.normal(0, 0.2, (h, h)),
            "b": np.r_[np.ones(h), np.zeros(2 * h)],
            "c": np.zeros((h, CLASSES)),
            "cb": np.log(np.maximum(total / total.sum(), 1e-30)),
            "w": np.zeros((CLASSES, h, self.width)),
            "wb": inner,
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, h: np.ndarray, ids: np.ndarray):
        """The next state, and what backpropagation needs."""
        p, k = self.p, HIDDEN
        x = p["x"][ids]
        x += p["b"]
        g = h @ p["u"]
        g += x[:, : 2 * k]
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        z, r = g[:, :k], g[:, k:]
        n = (r * h) @ p["un"]
        n += x[:, 2 * k :]
        np.tanh(n, out=n)
        return n + z * (h - n), (h, z, r, n)

    def log_probs(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log probability of each id after its state, class by class."""
        p, out = self.p, np.empty(len(ids), np.float32)
        for at in range(0, len(ids), 1 << 14):
            y = ids[at : at + (1 << 14)]
            order, edges = self._by_class(y)
            s, place = h[at : at + (1 << 14)][order], self.place_of[y[order]]
            logits = s @ p["c"]
            logits += p["cb"]
            got = logits[np.arange(len(y)), self.class_of[y[order]]]
            got -= np.log(np.exp(logits, out=logits) @ _ONES[:CLASSES])
            for k, a, b in edges:
                inner = s[a:b] @ p["w"][k]
                inner += p["wb"][k]
                got[a:b] += inner[np.arange(b - a), place[a:b]]
                got[a:b] -= np.log(np.exp(inner, out=inner) @ _ONES[: self.width])
            out[at + order] = got
        return out

    def _by_class(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order by output class, and where each class that occurs stands."""
        c = self.class_of[ids].astype(np.uint8)
        order = np.argsort(c, kind="stable")
        ends = np.cumsum(np.bincount(c, minlength=CLASSES)).tolist()
        return order, [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]

    def _gradients(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray):
        """Loss gradients of one window (steps x streams) and the last state."""
        p, k = self.p, HIDDEN
        states, kept = [], []
        for ids in inputs:
            h, x = self.step(h, ids)
            states.append(h)
            kept.append(x)
        # Rows are taken class by class; ``turn`` brings them back.
        y = targets.reshape(-1)
        order, edges = self._by_class(y)
        turn = np.empty_like(order)
        turn[order] = np.arange(len(y))
        s, place, c = np.concatenate(states)[order], self.place_of[y[order]], self.class_of[y[order]]
        g = {n: np.zeros_like(v) for n, v in p.items()}
        d = s @ p["c"]
        d += p["cb"]
        np.exp(d, out=d)
        d /= (d @ _ONES[:CLASSES])[:, None]
        d[np.arange(len(y)), c] -= 1
        g["c"], g["cb"], ds = s.T @ d, _ONES[: len(d)] @ d if len(d) <= len(_ONES) else d.sum(0), d @ p["c"].T
        for m, a, b in edges:
            e = s[a:b] @ p["w"][m]
            e += p["wb"][m]
            np.exp(e, out=e)
            e /= (e @ _ONES[: self.width])[:, None]
            e[np.arange(b - a), place[a:b]] -= 1
            g["w"][m], g["wb"][m] = s[a:b].T @ e, e.sum(0)
            ds[a:b] += e @ p["w"][m].T
        ds = ds[turn].reshape(len(inputs), -1, k)
        back = np.zeros_like(h)
        full = np.empty((*inputs.shape, 3 * k), np.float32)
        for t in range(len(inputs) - 1, -1, -1):
            h0, z, r, n = kept[t]
            back = back + ds[t]
            keep = 1 - z
            dn, now = full[t, :, 2 * k :], full[t]
            np.multiply(back * keep, 1 - n * n, out=dn)
            drh = dn @ p["un"].T
            np.multiply(back * (h0 - n), z * keep, out=now[:, :k])
            np.multiply(drh * h0, r * (1 - r), out=now[:, k : 2 * k])
            back = back * z + drh * r + now[:, : 2 * k] @ p["u"].T
        full = full.reshape(-1, 3 * k)
        h0 = np.concatenate([x[0] for x in kept])
        g["b"], g["u"] = full.sum(0), h0.T @ full[:, : 2 * k]
        g["un"] = (np.concatenate([x[2] for x in kept]) * h0).T @ full[:, 2 * k :]
        x = inputs.reshape(-1)
        order = np.argsort(x.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])
        g["x"][x[order[first]]] = np.add.reduceat(full[order], first)
        return g, h

    def train(self, stream: np.ndarray, epochs: int = 2, streams: int = 64, steps: int = 24, rate: float = 0.01, state: dict | None = None) -> None:
        """Adam over windows of ``steps``; states pass on, gradients do not.

        ``state`` keeps the moments from one call to the next.
        """
        streams = min(streams, max(1, len(stream) // (2 * steps)))
        long = (len(stream) - 1) // streams
        if long < 2:
            return
        x = stream[: long * streams].reshape(streams, long).T
        y = stream[1 : long * streams + 1].reshape(streams, long).T
        state = {} if state is None else state
        m = state.setdefault("m", {n: np.zeros_like(v) for n, v in self.p.items()})
        v = state.setdefault("v", {n: np.zeros_like(q) for n, q in self.p.items()})
        at = begun = state.get("at", 0)
        total = epochs * -(-long // steps)
        for _ in range(epochs):
            h = np.zeros((streams, HIDDEN), np.float32)
            for t in range(0, long, steps):
                at += 1
                g, h = self._gradients(h, x[t : t + steps], y[t : t + steps])
                scale = 1 / (streams * min(steps, long - t))
                now = rate * (1 - 0.9 * (at - begun) / total)
                for n, d in g.items():
                    if n == "wb":  # counts over all documents stay as they are
                        continue
                    d *= scale
                    m[n] += 0.1 * (d - m[n])
                    v[n] += 0.01 * (d * d - v[n])
                    self.p[n] -= (now / (1 - 0.9**at)) * m[n] / (np.sqrt(v[n] / (1 - 0.99**at)) + 1e-6)
        state["at"] = at


class Scorer:
    """The model with what tasks need to score documents."""

    def __init__(self, words: list[str], counts: np.ndarray, total: int, distinct: int, in_bucket: dict[int, tuple[int, int]]):
        """``words``, ``counts``: the most frequent tokens, most frequent first.

        ``in_bucket``: by bucket, count and number of tokens over all training
        documents, the end left out.
        """
        self.total, self.distinct = total, distinct
        mass, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for b, (c, n) in in_bucket.items():
            mass[b], kinds[b] = c, n
        self.row = {w.encode(): i for i, w in enumerate(words)}
        self.end_count = int(counts[self.row[END]]) if END in self.row else 0
        own = [w for w in self.row if w != END][: VOCABULARY - BUCKETS - 1]
        self.token = np.zeros(len(words) + 1, np.int32)
        weight = [1.0] * (BUCKETS + 1)
        weight[BUCKETS] = self.end_count + 1.0
        chosen = {w: BUCKETS + 1 + k for k, w in enumerate(own)}
        for w, i in self.row.items():
            b = bucket(w)
            self.token[i] = BUCKETS if w == END else chosen.get(w, b)
            if w in chosen:
                mass[b] -= counts[i]
                kinds[b] -= 1
                weight.append(float(counts[i]))
        weight[:BUCKETS] = mass + 1
        self.bucket_log = np.log10(mass + kinds + 1)
        self.flat_log = np.log10(total + distinct + 1)
        self.base = np.log10(np.asarray(counts, float) + 1) - self.flat_log
        inside = self.token[: len(words)] < BUCKETS
        self.rest = np.where(inside, np.log10(np.asarray(counts, float) + 1) - self.bucket_log[np.minimum(self.token[: len(words)], BUCKETS - 1)], 0.0)
        self.net = Network(np.array(weight))

    def ids(self, words: list[bytes], known: dict[bytes, int] | None = None) -> np.ndarray:
        """Model tokens of a document, the end last. ``known`` keeps them by word."""
        known = {} if known is None else known

        def learn(w: bytes) -> int:
            if len(known) >= CACHE:
                known.clear()
            known[w] = found = (int(self.token[i]) if (i := self.row.get(w)) is not None else bucket(w)) + 1
            return found

        get = known.get
        out = np.array([get(w) or learn(w) for w in words], np.int32) - 1
        return np.append(out, np.int32(BUCKETS))

    def likelihoods(self, docs: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each document's model tokens."""
        out = np.zeros(len(docs))
        if not docs:
            return out
        length = np.array([len(d) for d in docs])
        order = np.argsort(-length, kind="stable")
        flat = np.concatenate([docs[i] for i in order])
        length = length[order]
        first = np.r_[0, np.cumsum(length)[:-1]]
        h = np.zeros((len(docs), HIDDEN), np.float32)
        net, got = self.net, np.zeros(len(docs))
        h, _ = net.step(h, np.full(len(docs), BUCKETS))  # a document follows an end
        for start in range(0, int(length[0]), WINDOW):
            states, targets, owners = [], [], []
            for t in range(start, min(start + WINDOW, int(length[0]))):
                n = int(np.searchsorted(-length, -t, side="left"))
                now = flat[first[:n] + t]
                states.append(h[:n])
                targets.append(now)
                owners.append(n)
                h, _ = net.step(h[:n], now)
                if sum(owners[-64:]) > 1 << 20:
                    self._add(got, states, targets, owners)
            self._add(got, states, targets, owners)
        out[order] = got / np.log(10)
        return out

    def _add(self, got, states, targets, owners) -> None:
        if targets:
            rows = np.concatenate([np.arange(n) for n in owners])
            got += np.bincount(rows, self.net.log_probs(np.concatenate(states), np.concatenate(targets)), len(got))
            states.clear(), targets.clear(), owners.clear()


PARTIAL = "row long, doc_id long, n_tokens long, n_known long, base double, score double, tail array<string>, times array<int>"


def _partials(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """What a task can say of each document, and its words of unknown count."""
    schema = shared.pa_schema(docs.sparkSession, PARTIAL)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s: Scorer = sent.value
        at, get = TaskContext.get().partitionId() << 40, s.row.get
        held: list[tuple] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush():
            found = s.likelihoods(ids)
            rows = [(*r[:5], r[5] + f, *r[6:]) for r, f in zip(held, found, strict=True)]
            held.clear(), ids.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                words.append(END)
                rows = np.array([get(w, -1) for w in words], np.int64)
                known = rows[rows >= 0]
                lost = np.flatnonzero(rows < 0)
                unknown = [words[k] for k in lost.tolist()]
                tail = Counter(unknown)
                token = s.token[rows]
                if tail:
                    of = {w: bucket(w) if w != END else BUCKETS for w in tail}
                    token[lost] = [of[w] for w in unknown]
                beyond = token[lost]
                n = len(lost)
                held.append((at, doc_id, len(words), len(known), float(s.base[known].sum() - n * s.flat_log), float(s.rest[known].sum() - s.bucket_log[beyond[beyond < BUCKETS]].sum()), [w.decode() for w in tail if w != END], [c for w, c in tail.items() if w != END]))
                ids.append(token.astype(np.int32))
                at += 1
                size += len(words)
                if size >= CHUNK_TOKENS:
                    yield flush()
                    size = 0
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(shared.tidied(run), PARTIAL)


def train_everywhere(docs: DataFrame, scorer: Scorer, rounds: int = ROUNDS) -> int:
    """Train the scorer's network on all ``docs``; the number of tokens.

    Each document serves in one round, equal texts in the same one. Copies are
    stored as they come and added up in a few tasks, so the driver receives a
    bounded number of them.
    """
    spark, names = docs.sparkSession, sorted(scorer.net.p)
    n_tokens = 0
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(scorer)

        def train(batches: Iterator[pa.RecordBatch], sent=sent, rate=0.01 / (k + 1)) -> Iterator[pa.RecordBatch]:
            s, state, held, size, total, known = copy.copy(sent.value), {}, [], 0, 0, {}
            s.net = copy.deepcopy(s.net)
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    held.append(s.ids(tokens(text), known))
                    size += len(held[-1])
                    if size >= TRAIN_TOKENS:
                        s.net.train(np.concatenate(held).astype(np.int64), epochs=1, streams=STREAMS, rate=rate, state=state)
                        total, size = total + size, 0
                        held.clear()
            if held:
                # A short rest takes fewer streams, so that it has windows enough.
                s.net.train(np.concatenate(held).astype(np.int64), epochs=1, streams=max(1, min(STREAMS, size // 1500)), rate=rate, state=state)
                total += size
            if total:
                flat = np.concatenate([s.net.p[n].ravel() for n in names]).astype(np.float64) * total
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["n", "p"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, flat = 0, 0.0
            for batch in batches:
                for i in range(batch.num_rows):
                    n, flat = n + batch.column(0)[i].as_py(), flat + batch.column(1)[i].values.to_numpy()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["n", "p"])

        own = docs.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k).select("text")
        copies = shared.stored(own.mapInArrow(shared.tidied(train), "n long, p array<double>"), "network-copies")
        parts = copies.coalesce(16).mapInArrow(add, "n long, p array<double>").toArrow()
        sent.unpersist()
        now = sum(parts["n"].to_pylist())
        n_tokens += now
        if not now:
            continue
        flat = sum(x.values.to_numpy() for x in parts["p"]) / now
        for n in names:
            p = scorer.net.p[n]
            scorer.net.p[n], flat = flat[: p.size].reshape(p.shape).astype(np.float32), flat[p.size :]
    return n_tokens


def fit(docs: DataFrame) -> tuple[Scorer, DataFrame]:
    """The model of ``docs`` and the stored count of each token."""
    counts = shared.stored(count_tokens(docs), "token-counts")
    end = F.col("token") == END.decode()
    by_bucket = counts.groupBy(end.alias("end"), (F.crc32(F.substring("token", -2, 2).cast("binary")) % BUCKETS).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    # Tokens of the largest counts: whole classes of counts, as many as fit.
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    left, least = HEAD_WORDS, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        left -= r["n"]
        if left < 0:
            break
        least = r["level"]
    head = counts.filter(level >= (F.lit(1 << 60) if least is None else least)).select("token", "c").toArrow().sort_by([("c", "descending"), ("token", "ascending")])
    scorer = Scorer(
        head["token"].to_pylist(),
        head["c"].to_numpy(),
        sum(r["c"] for r in by_bucket),
        sum(r["n"] for r in by_bucket),
        {r["b"]: (r["c"], r["n"]) for r in by_bucket if not r["end"]},
    )
    train_everywhere(docs, scorer)
    return scorer, counts


def score(docs: DataFrame, scorer: Scorer, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row.

    Null texts count as empty and hold one end; long ones are scored whole.
    Repeated rows are kept and scored alike. Words beyond the broadcast head get
    their counts from a join on the word, added up per document. Other columns
    are left out; an empty table gives no rows, and without training documents
    every token has the same base probability.
    """
    part = shared.stored(_partials(docs, scorer), "partial-scores")
    tail = part.select("row", F.explode(F.arrays_zip("tail", "times")).alias("e")).select("row", F.col("e.tail").alias("token"), F.col("e.times").alias("times"))
    hit = tail.join(counts, "token")
    extra = hit.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    return part.join(extra, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(scorer.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def score_corpus(docs: DataFrame) -> DataFrame:
    """Learn from documents whose remainder modulo 7 is not 2, score all."""
    scorer, counts = fit(docs.filter(shared.remainder("doc_id", 7) != 2))
    out = score(docs, scorer, counts)
    return out.select("doc_id", (shared.remainder("doc_id", 7) == 2).alias("held_out"), *out.columns[1:])
