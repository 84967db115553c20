"""The whole pipeline against plain versions of its stages."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from loomspark.llm import pii, toxicity
from loomspark.llm.queries import tokenizer_path
from tests.llm import helpers, test_decontaminate, test_jaccard, test_text_models

tokenizers = pytest.importorskip("tokenizers")


def test_run_equals_plain_stages(spark, tmp_path):
    toxic = [(2000 + i, t, "en", "t", len(t)) for i, t, _ in test_text_models.toxic_rows(400)]
    near = [(i, t, "en", "n", len(t)) for i, t in test_jaccard.near_copies()]
    private = [(3000, helpers.sentence(900, 30) + " a@b.co and 4111111111111111", "en", "p", 1), (3001, helpers.sentence(901, 20) + " " + helpers.sentence(3, 14), "en", "p", 1)]
    rows = toxic + near + private
    folder = str(tmp_path)
    spark.createDataFrame(rows, helpers.SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(2000 + i, 1, b) for i, _, b in test_text_models.toxic_rows(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(test_decontaminate.ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard join", "decontamination", "pii", "bpe"]

    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    kept = [r for r, s in zip(rows, scorer.scores([r[1] for r in rows])) if s < 0.5]
    assert 0 < len(rows) - len(kept) < 200
    group = {d: c for d, _, c in test_jaccard.brute([(r[0], r[1]) for r in kept])}
    kept = [r for r in kept if group[r[0]] == r[0]]
    kept = [r for r in kept if not test_decontaminate.brute(r[1])[1]]
    detector, library = pii.Detector(), tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {}
    for doc_id, text, *_ in kept:
        clean = pii.redacted(text, detector.spans([text])[0][1])
        want[doc_id] = library.encode(clean, add_special_tokens=False).ids
    assert 3000 in want and 3001 not in want

    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.ids for r in got} == want
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_keep_columns_and_bear_awkward_rows(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(test_decontaminate.ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (helpers.awkward(spark), helpers.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
