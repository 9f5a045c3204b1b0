import math
import random
from collections import Counter

import pytest

from coinsight.llm import decontaminate as d


def items(rnd, n=150):
    return [(k, " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.choice((1, 1, 2)) for _ in range(rnd.randint(6, 30)))) for k in range(n)]


def test_search_matches_scoring_every_item(monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 4)
    rnd = random.Random(1)
    index = d.ItemIndex(items(rnd))
    for _ in range(300):
        terms = sorted(rnd.sample(range(1, len(index.docs)), rnd.randint(1, 30)))
        for threshold in (0.3, 0.5, 0.8):
            scores = Counter()
            for t in terms:
                for k, x in zip(index.docs[t], index.impacts[t], strict=True):
                    scores[k] += x
            want = {k: round(v, 9) for k, v in scores.items() if v >= threshold - 1e-9}
            assert {k: round(v, 9) for k, v in index.search(terms, threshold)} == want


def test_planted_items_are_found_and_others_left():
    rnd = random.Random(2)
    syllables = ["ra", "tho", "min", "ke", "lu", "sta", "ver", "on", "di", "pa"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    tests = [(k, " ".join(word() for _ in range(rnd.randint(15, 50)))) for k in range(60)]
    index = d.ItemIndex(tests)
    for k, text in tests:
        before, after = (" ".join(word() for _ in range(rnd.randint(0, 300))) for _ in range(2))
        assert k in index.leaks(f"{before} {text.upper()}. {after}")
        w = text.split()
        w[len(w) // 2] = "changed"
        assert k in index.leaks(f"{before} {' '.join(w)} {after}")
        assert not index.leaks(before)
        assert not index.leaks(" ".join(w[: len(w) // 2]) + " " + after)


def test_near_whole_items_are_found_wherever_they_differ():
    rnd = random.Random(5)
    syllables = ["ra", "tho", "min", "ke", "lu", "sta", "ver", "on", "di", "pa"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    tests = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate(range(15, 61, 3))]
    index = d.ItemIndex(tests)
    before, after = (" ".join(word() for _ in range(80)) for _ in range(2))
    for k, text in tests:
        w = text.split()
        for at in range(len(w)):
            assert k in index.leaks(" ".join([before, *w[:at], "changed", *w[at + 1 :], after])), (len(w), at)
            assert k in index.leaks(" ".join([before, *w[:at], *w[at + 1 :], after])), (len(w), at)
        for share in (0.83, 0.85, 0.88):
            assert k in index.leaks(" ".join([before, *w[: int(len(w) * share + 0.999)], after]))
            assert k in index.leaks(" ".join([before, *w[-int(len(w) * share + 0.999) :], after]))
        assert not index.leaks(" ".join([before, *w[: len(w) // 2], after]))
        rnd.shuffle(w)
        assert not index.leaks(" ".join([before, *w, after]))


def test_rows(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota"
    tests = spark.createDataFrame([(7, text), (8, None), (9, ""), (None, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"intro {text} end", 3.0), (1, f"intro {text} end", 3.0), (2, None, 1.0), (3, "", 1.0), (4, "alpha beta clean", 1.0)], "doc_id long, text string, score double")
    assert [(r.doc_id, r.item_id) for r in d.find_leaks(docs, tests).collect()] == [(1, 7), (1, 7)]
    kept = d.without_leaks(docs, tests)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert d.find_leaks(docs, tests.limit(0)).count() == 0 and d.find_leaks(docs.limit(0), tests).count() == 0


def brute_leaks(text, tests):
    """Leaked items: every passage against every item, no index and no bounds."""
    kept = [(k, w) for k, t in tests if (w := d.words(t))]
    n, mean, longest = len(kept), sum(len(w) for _, w in kept) / len(kept), max(len(w) for _, w in kept)
    df = Counter(t for _, w in kept for t in set(w))
    w, out = d.words(text), {}
    for start in range(0, max(len(w), 1), longest):
        inside = w[start : start + 2 * longest]
        grams = d.trigrams(inside)
        for k, item in kept:
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (d.K1 + 1) / (c + d.K1 * (1 - d.B + d.B * len(item) / mean)) for t, c in Counter(item).items()}
            score = sum(x for t, x in impact.items() if t in inside) / sum(impact.values())
            if score < d.SHARE - 1e-9:
                continue
            cut = -(-2 * len(item) // 3)
            q, a, whole = (len(d.trigrams(x) & grams) / max(1, len(d.trigrams(x))) for x in (item[:cut], item[cut:], item))
            a = a if item[cut:] else 1.0
            if q >= d.OVERLAP and a >= d.OVERLAP or whole >= d.WHOLE or whole and d.aligned(item, inside) >= d.ALIGNED * len(item):
                out[k] = max(out.get(k, (0.0,)), (round(score, 9),))
    return {k: v[0] for k, v in out.items()}


@pytest.mark.parametrize("chars", [d.MAX_INDEX_CHARS, 400])
def test_query_matches_every_passage_against_every_item(spark, monkeypatch, chars):
    monkeypatch.setattr(d, "MAX_INDEX_CHARS", chars)
    rnd = random.Random(9)
    tests = items(rnd, 60) + [(400, None), (401, "..."), (402, "one two"), (403, "same words here again"), (404, "same words here again")]
    texts = [None, "", "one two", "said one two three", "same words here again"] + [" ".join(t for _, t in items(rnd, rnd.randint(1, 6))) for _ in range(40)]
    for k, t in tests[:60]:
        w = t.split()
        w[rnd.randrange(len(w))] = "other"
        texts.append(" ".join([texts[5 + k % 40], *(w if k % 2 else t.split()), texts[6 + k % 38]]))
    texts.append(" ".join(t or "" for t in texts) * 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = spark.createDataFrame(tests, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in d.find_leaks(docs, frame).collect()}
    want = {(k, i): x for k, t in enumerate(texts) for i, x in brute_leaks(t, tests).items()}
    assert len(want) > 60 and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in got)
    assert sorted(r.doc_id for r in d.without_leaks(docs, frame).collect()) == sorted(set(range(len(texts))) - {k for k, _ in want})
