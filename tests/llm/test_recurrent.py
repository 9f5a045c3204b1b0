import math
from collections import Counter

import numpy as np
import pytest

from coinsight.llm import recurrent, shared


@pytest.fixture(scope="module")
def scored(spark):
    docs = [(i, " ".join(f"w{(i * k) % 37} The the" for k in range(1 + i % 9))) for i in range(120)] + [(900, None), (901, ""), (5, "The\x0bthe the\x1cx"), (5, "The\x0bthe the\x1cx")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return docs, recurrent.score_corpus(frame).collect()


def test_counts_and_base_score_match_brute_force(scored):
    docs, got = scored
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]
    c = Counter(w for d, t in docs if shared.py_remainder(d, 7) != 2 for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((d, shared.py_remainder(d, 7) == 2, len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t in docs)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_scores_are_log_probabilities(scored):
    _, got = scored
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_network_sums_to_one_and_learns():
    weight = np.arange(1.0, recurrent.VOCABULARY + 1)
    net = recurrent.Network(weight)
    h = np.random.default_rng(1).normal(size=(1, recurrent.HIDDEN)).astype(np.float32)
    ids = np.arange(len(weight))
    assert abs(np.exp(net.log_probs(np.repeat(h, len(ids), 0), ids).astype(float)).sum() - 1) < 1e-4
    stream = np.tile(np.array([3, 700, 5, 900]), 3000)
    net.train(stream, epochs=20, streams=8)
    h = np.zeros((1, recurrent.HIDDEN), np.float32)
    for x in stream[:8]:
        h, _ = net.step(h, np.array([x]))
    assert net.log_probs(h, stream[8:9])[0] > math.log(0.5)


def test_gradient_matches_differences():
    net = recurrent.Network(np.ones(recurrent.VOCABULARY))
    net.p = {k: v.astype(np.float64) + (0 if k == "wb" else np.random.default_rng(2).normal(0, 0.05, v.shape)) for k, v in net.p.items()}
    x = np.array([[1, 2], [3, 4], [5, 6]])
    y = np.array([[3, 4], [5, 6], [7, 8]])

    def loss():
        h, total = np.zeros((2, recurrent.HIDDEN)), 0.0
        for a, b in zip(x, y, strict=True):
            h, _ = net.step(h, a)
            total -= net.log_probs(h, b).astype(float).sum()
        return total

    g, _ = net._gradients(np.zeros((2, recurrent.HIDDEN)), x, y)
    for name, at in (("u", (1, 2)), ("un", (0, 3)), ("b", (4,)), ("x", (3, 1)), ("c", (2, 5)), ("w", (int(net.class_of[7]), 1, int(net.place_of[7])))):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-3
        up = loss()
        net.p[name][at] = keep - 1e-3
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-2 * max(1, abs(g[name][at])), name


def test_long_documents_and_windows():
    words = ["a", "b", "\n"]
    s = recurrent.Scorer(words, np.array([5, 4, 3]), 12, 3, {recurrent.bucket(b"a"): (5, 1), recurrent.bucket(b"b"): (4, 1)})
    docs = [s.ids([b"a", b"b"] * n) for n in (0, 1, 300, 77)]
    together = s.likelihoods(docs)
    assert np.allclose(together, [s.likelihoods([d])[0] for d in docs], atol=1e-3)


def test_score_matches_the_model_written_out(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "HEAD_WORDS", 60)
    docs = [(i, " ".join(f"w{(i * k) % 97} x{k}" for k in range(1 + i % 30))) for i in range(200)] + [(900, None), (901, "never seen"), (902, "w1 " * 700)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    train = [t for d, t in docs if d % 3]
    scorer, counts = recurrent.fit(frame.filter("doc_id % 3 <> 0"))
    c = Counter(w for t in train for w in [*recurrent.tokens(t), recurrent.END])
    assert {r.token.encode(): r.c for r in counts.collect()} == c
    net, head = scorer.net, {w for w in scorer.row}
    own = [w for w in scorer.row if w != recurrent.END][: recurrent.VOCABULARY - recurrent.BUCKETS - 1]
    rest = [w for w in c if w not in own and w != recurrent.END]
    for r in recurrent.score(frame, scorer, counts).collect():
        total, h = 0.0, np.zeros((1, recurrent.HIDDEN), np.float32)
        h, _ = net.step(h, np.array([recurrent.BUCKETS]))
        for w in [*recurrent.tokens(dict(docs)[r.doc_id]), recurrent.END]:
            token = np.array([int(scorer.ids([w])[0]) if w != recurrent.END else recurrent.BUCKETS])
            total += float(net.log_probs(h, token)[0]) / math.log(10)
            if w != recurrent.END and w not in own:
                mates = [x for x in rest if recurrent.bucket(x) == recurrent.bucket(w)]
                total += math.log10((c[w] + 1) / (sum(c[x] for x in mates) + len(mates) + 1))
            h, _ = net.step(h, token)
        assert abs(total - r.score) < 1e-3 * max(1, abs(total)), r
    assert len(head) < len(c)


def test_every_training_document_is_learned_from(spark):
    docs = spark.createDataFrame([(i, f"left{i % 40} right{i % 40} " * 20) for i in range(4000)], "doc_id long, text string").repartition(4, "doc_id")
    scorer, _ = recurrent.fit(docs)
    assert recurrent.train_everywhere(docs, scorer, 1) == 4000 * 41
    late = " ".join(f"left{i} right{i}" for i in range(40))
    assert scorer.likelihoods([scorer.ids(recurrent.tokens(late))])[0] > -80 * math.log10(80)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert recurrent.score_corpus(empty).count() == 0
