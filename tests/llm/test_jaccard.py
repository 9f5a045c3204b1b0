import random

import numpy as np
import pytest

from coinsight.llm import jaccard


def brute(docs):
    """Component of each document by comparing every pair of sets."""
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3)
    texts = [[word() for _ in range(rnd.randint(0, 60))] for _ in range(60)]
    passage = [word() for _ in range(30)]
    for _ in range(120):
        t = list(rnd.choice(texts))
        for _ in range(rnd.randint(0, 3)):
            if t:
                t[rnd.randrange(len(t))] = word()
        if rnd.random() < 0.2:
            t += t[-rnd.randint(1, 9) :]
        texts.append(t)
    texts += [passage + [word() for _ in range(rnd.randint(0, 12))] for _ in range(60)]
    rnd.shuffle(texts)
    docs = [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]
    return docs + [(1000, None), (1001, ""), (1002, "One two"), (1003, "one\x0bTWO"), (1004, " \t ")]


@pytest.mark.parametrize(("frequent", "rest"), [(1024, {}), (3, {"HOT": 2, "BATCH_DOCS": 40, "BLOCK": 4}), (1, {"BATCH_TOKENS": 200, "PARTS": 4})])
def test_components_match_brute_force(spark, monkeypatch, frequent, rest):
    for name, value in {"FREQUENT": frequent, **rest}.items():
        monkeypatch.setattr(jaccard, name, value)
    docs = corpus(frequent) + [(2000 + k, " ".join(f"w{i}" for i in range(k, 9000))) for k in range(3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_components(frame).collect()}
    want = brute(docs)
    assert len({c for _, c in want.values()}) < len(docs) - 20
    assert got == want


def test_units_of_any_size_match_every_pair():
    rnd = np.random.default_rng(3)
    base = np.unique(rnd.integers(0, 1 << 60, 80).astype(np.uint64))
    sets = [np.unique(np.r_[rnd.permutation(base)[: rnd.integers(55, 78)], rnd.integers(0, 1 << 60, rnd.integers(0, 12)).astype(np.uint64)]) for _ in range(70)]
    sets.sort(key=len)
    n, ids = np.array([len(s) for s in sets]), np.arange(70)

    def joined(links):
        label = list(range(70))
        for u, v in links:
            label = [label[u] if x == label[v] else x for x in label]
        return [label.index(x) for x in label]

    pairs = [(i, j) for i in ids for j in ids[i + 1 :] if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (n[i] + n[j] - c)]
    assert 20 < len(pairs) and joined(jaccard.group_links(ids, n, ids * 0, sets)) == joined(pairs)
    few = jaccard.group_links(ids[:4], n[:4], ids[:4] * 0, sets[:4])
    assert joined(few) == joined([p for p in pairs if p[1] < 4])
    block = ids % 2
    assert joined(jaccard.group_links(ids, n, block, sets)) == joined([p for p in pairs if block[p[0]] != block[p[1]]])


def test_similar_sets_share_an_entry():
    rnd = random.Random(4)
    for _ in range(400):
        size = rnd.randint(2, 90)
        a = sorted(rnd.sample(range(120), size))
        b = sorted({*rnd.sample(a, max(1, size - rnd.randint(0, size // 4))), *rnd.sample(range(120), rnd.randint(0, size // 8))})
        common = len({*a} & {*b})
        if 100 * common < 75 * (len(a) + len(b) - common) or a == b:
            continue
        rare = rnd.randint(0, 120)
        entries = []
        for s in (a, b):
            shared = np.array(s, np.uint64)
            entries.append(jaccard.index_entries(len(s), shared, int((shared < rare).sum()))[0])
        assert len(np.intersect1d(*entries)), (a, b, rare)


def test_repeated_rows_clashing_columns_and_empty(spark):
    docs = [(1, "a b c d e f", 5), (1, "a b c d e f", 5), (2, "a b c d e f", 6), (None, "a b c d e f", 7), (3, None, 8)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, component_id long")
    got = sorted(jaccard.linked_components(frame).collect(), key=str)
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.n_shingles) == [(False, 1), (False, 1), (False, 1), (True, None)]
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "None"]
    assert jaccard.linked_components(frame.limit(0)).count() == 0
