import sys
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from coinsight.llm import decontaminate, language, secrets, shared  # noqa: E402

from .test_jaccard import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_stage_and_whole_run_match_brute_force(spark):
    docs = shared.table(spark, SF, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    field = language.fit(docs.filter(shared.remainder("doc_id", 4) != 2))
    names, scores = language._predictor(field)([r.text for r in rows.values()])
    kept = {d for d, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= 0.4}
    assert len(kept) >= 0.95 * len(rows)
    groups = brute([(d, rows[d].text) for d in kept])
    kept = {d for d in kept if groups[d][1] == d}
    items = [set(zip(*(decontaminate.words(r.text)[i:] for i in range(8)), strict=False)) for r in shared.table(spark, SF, "benchmark").collect()]
    grams = {d: set(zip(*(decontaminate.words(rows[d].text)[i:] for i in range(8)), strict=False)) for d in kept}
    kept = {d for d in kept if not any(len(i & grams[d]) >= 0.5 * max(1, len(i)) for i in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == kept
    for d, r in got.items():
        clean = secrets.redact(rows[d].text)
        assert r.text == clean and r.n_chars == len(clean) and r.lang == rows[d].lang
        assert r.token_ids == [*library.encode(clean), library.eos_id()] and r.n_tokens == len(r.token_ids)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_on_odd_rows(spark):
    base = [r for r in shared.table(spark, SF, "documents").limit(60).collect()]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 5) for r in base] + [(base[0].doc_id, base[0].text, base[0].lang, base[0].source, base[0].n_chars, 5)]
    long = " ".join(base[k % 60].text for k in range(200) if base[k % 60].lang == base[0].lang)
    rows += [(None, base[1].text, None, None, None, 6), (9001, None, None, None, None, 7), (9002, "", "en", None, 0, 7), (9003, long, base[0].lang, "s", len(long), 8), (9004, " \n ", None, "s", 3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert set(docs.columns) <= set(out.columns)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert None in ids and (base[0].doc_id not in ids or ids.count(base[0].doc_id) == 2), name
        assert ({9001, 9002, 9004} <= set(ids)) == (name != "language identification")
        assert {r.score for r in out.filter("doc_id = 9003").collect()} <= {8}
