import re

from coinsight.llm import licenses as lic


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in lic.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    own, best = set(labels), 0.0
    index = lic.index()
    for n, (label, _, key) in enumerate(lic.TEMPLATES):
        votes = {}
        for i, w in enumerate(words):
            for k, at in index.get(w, ()):
                if k == n:
                    votes[i - at] = votes.get(i - at, 0) + 1
        size = sum(k == n for p in index.values() for k, _ in p)
        share = max(votes.values(), default=0) / size if f" {key} " in f" {' '.join(words)} " else 0.0
        own |= {label} if share >= lic.LEAST else set()
        best = max(best, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(own)), round(min(best, 1.0), 9)


def test_matches_brute_force(spark):
    texts = [t for _, t, _ in lic.TEMPLATES] + [
        None, "", "The MIT  License, the mit-license; MIT licenses", "General\nPublic\tLicense general public license", "word " * 50 + lic.TEMPLATES[6][1].upper() + " tail",
        "é MIT License É", "redistribution", lic.TEMPLATES[0][1].replace("granted", "given"), "Licensed under CC BY-NC 4.0.", "apache apache license license", "cc", "x" * 5000 + " license",
    ]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string, score double")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in lic.scan(docs).collect()}
    for i, t in enumerate([*texts, texts[2]]):
        assert got[i] == brute(t), t
    assert lic.scan(docs.limit(0)).count() == 0
    plan = lic.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
