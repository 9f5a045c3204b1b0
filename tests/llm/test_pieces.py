import hashlib
import random

import public_tokenizers
import sentencepiece

from coinsight.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "e", "th", " ", "  ", "\n", "é", "😀", "▁", "the ", "ing", "0", "\x00", "ß", " \n", "\t", "한", "word", "==", "aaaa", "    ", "☃", "%%%", "."]


def test_equals_library_on_random_texts():
    own, library, rnd = pieces.piece_table(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 15)))
        ids = own.encode(text)
        assert ids == library.encode(text) + [library.eos_id()], text
        assert own.decode(ids) == library.decode(ids)


def test_long_and_hostile_texts():
    own, library = pieces.piece_table(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ("a" * 5000, " " * 3000, "ab" * 4000 + "\n" * 50, "é" * 999, "\U0010ffff" * 20, "x" * 31 + "." * 400):
        assert own.encode(text)[:-1] == library.encode(text)
        assert own.decode(own.encode(text)) == library.decode(library.encode(text))


def test_rows_are_kept(spark):
    docs = spark.createDataFrame([(1, "one two", 7), (1, "one two", 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, n_tokens long")
    got = sorted(tuple(r) for r in pieces.digests(docs, PATH).collect())
    assert [(r[0], r[1]) for r in got] == [(1, 3), (1, 3), (2, 1), (3, 1)]
    assert got[0][2] == got[1][2] and got[2][2] == got[3][2]
    ids = pieces.encode(docs, PATH).collect()
    assert len(ids) == 4 and set(docs.columns) < set(pieces.encode(docs, PATH).columns)
    assert pieces.digests(docs.limit(0), PATH).count() == 0


def test_digests_equal_the_library(spark):
    library, rnd = sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(8)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + [None, "", " ", "x" * 20_000, "one two " * 4000]
    got = {r.doc_id: tuple(r)[1:] for r in pieces.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()}
    for k, t in enumerate(texts):
        ids = [*library.encode(t or ""), library.eos_id()]
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert got[k] == want, t
