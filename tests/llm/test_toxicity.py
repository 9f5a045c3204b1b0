import itertools
import random

import numpy as np

from coinsight.llm import shared, toxicity

SYLLABLES = ["ra", "tho", "min", "ke", "lu", "sta", "ver", "on", "di", "pa"]
INSULTS = ["idiot", "moron", "worthless"]


def brute_kernel(a, b):
    def vector(w):
        c = [toxicity.FIRST, *(toxicity._code(x) for x in w), toxicity.LAST]
        v = {}
        for i, j, k in itertools.combinations(range(len(c)), 3):
            if k - i < toxicity.SPAN and c[i] and c[j] and c[k]:
                v[c[i], c[j], c[k]] = v.get((c[i], c[j], c[k]), 0) + toxicity.DECAY ** (k - i - 2)
        return v

    x, y = vector(a), vector(b)
    norm = np.sqrt(sum(t * t for t in x.values()) * sum(t * t for t in y.values()))
    return sum(t * y.get(k, 0) for k, t in x.items()) / norm if norm else 0.0


def labelled(n, seed):
    rnd, docs = random.Random(seed), []
    word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4)))
    for _ in range(n):
        s = [[word() for _ in range(rnd.randint(3, 15))] for _ in range(rnd.randint(1, 8))]
        toxic = rnd.random() < 0.3
        if toxic:
            rnd.choice(s).insert(1, rnd.choice(INSULTS))
        docs.append((". ".join(map(" ".join, s)), int(toxic)))
    return docs


def machine():
    docs = [(toxicity.sentences(t), y) for t, y in labelled(500, 1)]
    m = toxicity.Machine(toxicity.choose_landmarks(docs))
    m.train(docs)
    return m


def test_kernel_matches_enumeration():
    words = ["idiot", "i*d*i*o*t", "moron", "aaaa", "a", "été", "worthlessness"]
    m = toxicity.Machine(INSULTS)
    want = [[brute_kernel(w, x) for x in INSULTS] for w in words]
    assert np.allclose(m.kernel(words), want, atol=2e-2)


def test_held_out_and_gapped_insults():
    m = machine()
    test = labelled(400, 2)
    got = m.score([t for t, _ in test]) >= toxicity.THRESHOLD
    y = np.array([bool(y) for _, y in test])
    assert got[y].mean() > 0.95 and got[~y].mean() < 0.05
    assert (m.score(["tho i*d*i*o*t ra", "you m o r o n there", "such a w-o-rthless thing"]) >= toxicity.THRESHOLD).all()
    assert (m.score([None, "", "tho ra min", "%% ??"]) < toxicity.THRESHOLD).all()


def test_scores_do_not_depend_on_the_cache(monkeypatch):
    m, texts = machine(), [t for t, _ in labelled(60, 5)]
    want = m.score(texts)
    monkeypatch.setattr(toxicity, "CACHE", 20)
    assert np.allclose(m.score(texts), want)


def naive(m, text):
    """Score of a text by the sentence kernel written out, pair by pair."""
    best = None
    for s in toxicity.sentences(text) or [[]]:
        z = np.array([sum(k**toxicity.POWER for w in s if (k := brute_kernel(w, x)) >= toxicity.FLOOR) for x in m.landmarks])
        margin = z @ m.white @ m.weight + m.bias
        best = margin if best is None else max(best, margin)
    return float(m.probability(np.array([best]))[0])


def test_query_matches_the_kernel_written_out(spark):
    m, texts = machine(), [t for t, _ in labelled(40, 6)] + [None, "", "tho i.d.i.o.t! ra", "idiot " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], [naive(m, t) for t in texts], atol=0.03)


def test_scores_keep_their_meaning_when_clean_labels_are_thinned():
    docs = sorted((toxicity.sentences(t), y) for t, y in labelled(1500, 7))
    test = [t for t, _ in labelled(300, 8)]
    thin = [d for k, d in enumerate(docs) if d[1] or k % 4 == 0]
    scores = []
    for sample, rates in ((docs, (1.0, 1.0)), (thin, (0.25, 1.0))):
        m = toxicity.Machine(INSULTS)
        m.train(sample, rates)
        scores.append(m.score(test))
    assert np.abs(scores[0] - scores[1]).mean() < 0.05


def test_rows(spark):
    texts = labelled(300, 3)
    docs = spark.createDataFrame([(i, t, 0.5) for i, (t, _) in enumerate(texts)] + [(900, None, 0.1), (900, None, 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_corpus(docs, labels).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.held_out == (shared.py_remainder(r.doc_id, 4) == 2) for r in got)
    assert toxicity.score_corpus(docs.limit(0), labels).count() == 0
    assert toxicity.score_corpus(docs, labels.limit(0)).count() == 302


def test_kernel_is_spared_words_without_evidence(monkeypatch):
    m = machine()
    words = list({w for t, _ in labelled(100, 9) for s in toxicity.sentences(t) for w in s})
    words += ["", "%%", "a", "aaaa", "i*d*i*o*t", "𝔦diot", "idiöt", "idiotidiotidiot", "x" * 90, "x" * 70 + "moron", "x" * 64]
    k = np.minimum(m.kernel(words), 1)
    want = np.where(k < toxicity.FLOOR, 0, k**toxicity.POWER)
    seen, kernel = [], m.kernel
    monkeypatch.setattr(m, "kernel", lambda w: seen.extend(w) or kernel(w))
    assert (m.evidence(words) == want).all() and want.any()
    assert len(seen) < len(words) / 2


def test_both_ways_to_split_agree():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab.!?\n\r\t  \x85") for _ in range(30)) for _ in range(5000)]
    assert all(toxicity.PLAIN.split(t) == toxicity.SENTENCE.split(t) for t in texts)
