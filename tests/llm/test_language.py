import itertools
import random

import numpy as np

from coinsight.llm import language as lang
from coinsight.llm import shared

STEMS = {"aa": ["bor", "gron", "tul", "dor"], "bb": ["ñie", "asé", "llí", "ció"], "cc": ["sch", "ung", "eit", "pfl"]}


def text(rnd, language, n):
    return " ".join("".join(rnd.choice(STEMS[language]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def trained():
    rnd = random.Random(1)
    field = lang.Field(sorted(STEMS))
    field.train([(lang.words(text(rnd, k, 60)), i) for i, k in enumerate(sorted(STEMS)) for _ in range(40)])
    return field


def test_posteriors_match_enumeration():
    field = lang.Field(["x", "y"])
    rnd = np.random.default_rng(3)
    field.weights = rnd.normal(size=field.weights.shape).astype(np.float32)
    field.transitions, field.start = rnd.normal(size=(2, 2)).astype(np.float32), rnd.normal(size=2).astype(np.float32)
    docs = [["ab", "cde", "f", "gh"], ["zz"]]
    for doc, got in zip(docs, field.means(docs), strict=True):
        s, total, mean = field.scores(doc), 0.0, np.zeros(2)
        for path in itertools.product(range(2), repeat=len(doc)):
            p = np.exp(field.start[path[0]] + sum(s[i, k] for i, k in enumerate(path)) + sum(field.transitions[a, b] for a, b in itertools.pairwise(path)))
            total += p
            mean += p * np.bincount(path, minlength=2) / len(doc)
        assert np.allclose(got, mean / total, atol=1e-4)


def test_switches_inside_a_text():
    field, rnd = trained(), random.Random(9)
    mixed = lang.words(text(rnd, "aa", 30) + " " + text(rnd, "cc", 30))
    m = field.means([mixed])[0]
    assert 0.35 < m[0] < 0.65 and 0.35 < m[2] < 0.65
    names, scores = lang._predictor(field)([text(rnd, "bb", 5), None, "", "12 %% _", "²"])
    assert names == ["bb", "und", "und", "und", "und"] and scores[0] > 0.9 and scores[1:] == [0.0] * 4


def test_corpus_accuracy_and_kept_columns(spark):
    rnd = random.Random(4)
    rows = [(i, text(rnd, k, rnd.randint(3, 80)), k, 1.5) for i, k in enumerate(rnd.choices(sorted(STEMS), k=240))] + [(500, None, "aa", 1.0), (501, "...", None, 1.0), (3, "bor", None, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = lang.predict_corpus(docs).collect()
    truth = {i: k for i, _, k, _ in rows[:240]}
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert held and all(r.held_out == (shared.py_remainder(r.doc_id, 4) == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95 and len(got) == len(rows)
    kept = lang.known_language(docs.withColumnRenamed("score", "lang_pred"))
    assert kept.columns[-1] == "lang_pred" and {500, 501}.isdisjoint(r.doc_id for r in kept.collect())
    kept = lang.known_language(docs)
    assert kept.columns == docs.columns and {500, 501}.isdisjoint(r.doc_id for r in kept.collect())
    assert lang.predict_corpus(docs.limit(0)).count() == 0


def naive(field, text):
    """Language and score by forward-backward written out, word by word."""
    w = lang.words(text)
    if not w:
        return "und", 0.0
    e = field.scores(w).astype(float)
    n = len(field.languages)
    f, b = [np.exp(field.start + e[0] - e[0].max())], [np.ones(n)]
    for row in e[1:]:
        x = np.array([sum(f[-1][i] * np.exp(field.transitions[i, j]) for i in range(n)) * np.exp(row[j] - row.max()) for j in range(n)])
        f.append(x / x.sum())
    for row in e[:0:-1]:
        x = np.array([sum(np.exp(field.transitions[i, j] + row[j] - row.max()) * b[0][j] for j in range(n)) for i in range(n)])
        b.insert(0, x / x.sum())
    mean = np.mean([x * y / (x * y).sum() for x, y in zip(f, b, strict=True)], 0)
    return field.languages[int(mean.argmax())], float(mean.max())


def test_query_matches_forward_backward_written_out(spark):
    field, rnd = trained(), random.Random(11)
    texts = [" ".join(text(rnd, rnd.choice(sorted(STEMS)), rnd.randint(1, 40)) for _ in range(rnd.randint(1, 3))) for _ in range(60)] + [None, "", "123 ...", text(rnd, "aa", 6000)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, lang_pred int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang.predict(docs, field).collect()}
    for k, t in enumerate(texts):
        name, score = naive(field, t)
        assert got[k][0] == name and abs(got[k][1] - score) < 1e-3
