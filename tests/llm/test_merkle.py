import hashlib
import random
import re

from coinsight.llm import merkle


def tree(text):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    sections = [s.split("\n") for s in text.split("\n\n")]
    nodes = [[md5(p) for p in s] for s in sections]
    tops = [md5("".join(n)) for n in nodes]
    blocks = [[md5(b)[:8] for b in re.findall(merkle.BLOCK, p)] for s in sections for p in s]
    flat = [p for n in nodes for p in n]
    return ";".join([md5("".join(tops)), ",".join(f"{t[:8]}:{len(n)}" for t, n in zip(tops, nodes, strict=True)), ",".join(f"{p[:8]}:{len(b)}" for p, b in zip(flat, blocks, strict=True)), ",".join(x for b in blocks for x in b)])


def alike(a, b):
    if a.split(";")[0] == b.split(";")[0]:
        return 1.0
    x, y = ({v for v in f.split(";")[3].split(",") if v} for f in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 7)
    rnd = random.Random(4)
    parts = ["word", "é", "😀", " ", "\n", "\n\n", "x\ty", "end."]
    docs = {i * rnd.choice((1, 1, 1000)) + i: "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for i in range(1, 90)}
    docs |= {-5: "", -6: None, -7: "a"}
    rows = list(docs.items())
    rnd.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, near_next double").repartition(4)
    got = {r.doc_id: r for r in merkle.fingerprints(frame).collect()}
    order = sorted(docs, reverse=True)
    for i, d in enumerate(order):
        text, after = docs[d] or "", docs[order[(i + 1) % len(order)]] or ""
        k = len(text) // 2
        edited = text[: len(text) - k] + after[:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (tree(text), tree(edited))
        assert abs(r.near_edited - alike(tree(text), tree(edited))) < 1e-12 and abs(r.near_next - alike(tree(text), tree(after))) < 1e-12


def test_repeated_single_and_empty(spark):
    schema = "doc_id long, text string"
    twice = merkle.fingerprints(spark.createDataFrame([(1, "ab"), (1, "ab"), (None, "cd"), (None, None)], schema)).collect()
    assert len(twice) == 4
    only = merkle.fingerprints(spark.createDataFrame([(3, "abcd")], schema)).collect()
    assert only[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and only[0].near_next == 1.0
    assert merkle.fingerprints(spark.createDataFrame([], schema)).count() == 0


def test_edits_are_located(spark):
    df = spark.createDataFrame([("a\nb\n\nc\nd", "a\nb\n\nc\nX")], "x string, y string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "x", "fx"), "y", "fy")
    r = merkle.changed_sections(df, "fx", "fy").first()
    assert (r.changed_sections, r.changed_paragraphs) == ([1], [3])
