import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_helpers import ODD, sentence
from test_counts_and_secrets import brute_base, brute_spans
from test_simhash import brute_kept

import corpus_pipeline
from marlstone.llm import decontaminate, pieces, ranker, secret_scan, stages

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def run_rows(spark):
    return {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}


def test_run_equals_brute_force(spark, run_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    model = ranker.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where(~ranker.held_out()))
    good = model.scores(np.array([ranker.features(t) for t in docs.text])) >= ranker.CUT
    docs = docs[good]
    kept = brute_kept(docs.doc_id, docs.text)
    docs = docs[docs.doc_id.isin(kept)]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    (index,) = decontaminate.shards(spark.read.parquet(f"{SF}/benchmark.parquet"))
    hit = np.array([bool(decontaminate.find(index, t)) for t in docs.text])
    assert all(hit[i] for i, t in enumerate(docs.text) if any(b in t for b in items.text))
    docs = docs[~hit]
    assert set(run_rows) == set(docs.doc_id)
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(brute_redacted(t))
        assert list(run_rows[d].ids) == ids and run_rows[d].n_pieces == len(ids)


def brute_redacted(text):
    """Every character in a span, by the spans' definition, is gone; each run of them is one mark."""
    spans = [tuple(map(int, x.split(":")[1:])) for x in brute_base(text) + brute_spans(text)]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_secrets_are_gone(run_rows):
    v = pieces.load("piece_bpe_32k.model")
    for r in run_rows.values():
        (text,) = v.decode(np.array(r.ids, np.int32), np.array([len(r.ids)]))
        assert secret_scan.base_spans(text) == []


def test_stages_keep_columns_and_take_odd_rows(spark, make_docs, clashing, draw, tmp_path):
    texts = [*ODD, *[sentence(draw, 80) for _ in range(5)], 'password = "hunter2hunter2"']
    docs = make_docs(texts, extra=clashing)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make_docs([]), SF).count() == 0


def test_secret_stage_counts_characters_anew(spark, make_docs):
    out = stages.secrets_stage(spark, make_docs(["x token=abcdefgh y", None]), SF).orderBy("doc_id").collect()
    assert out[0].text == "x [SECRET] y" and out[0].n_chars == 12
    assert out[1].text is None and out[1].n_chars is None
