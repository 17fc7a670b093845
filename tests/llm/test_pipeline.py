import test_jaccard
import test_linedup
import test_packing
import test_suffixes

import corpus_pipeline
from docflow.llm.packing import SEQUENCE_TOKENS
from docflow.llm.toxicity import fit_labels, score

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_against_its_plain_version(spark, folder):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{len(frames)}")
        docs = spark.read.parquet(f"{folder}/{len(frames)}")
        frames.append(docs)
    assert all(f.columns == columns for f in frames[:-1])
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames[:-1]]
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}

    model = fit_labels(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    clean = {r.doc_id for r in score(spark.read.parquet(f"{FOLDER}/documents.parquet"), model).collect() if r.score < 0.5}
    assert texts[0] == {i: t for i, t in given.items() if i in clean}

    want = {i: t for (i, _), (t, _, gone) in test_linedup.expected(list(texts[0].items())).items() if not gone or t.strip()}
    assert texts[1] == want

    classes = {j for _, j, _ in test_jaccard.expected(list(texts[1].items()))}
    assert texts[2] == {i: t for i, t in texts[1].items() if i in classes}

    cut = test_suffixes.expected_passages(list(texts[2].items()), 51)
    assert texts[3] == {i: kept for i, kept, gone in cut if not gone or kept.strip()}
    assert all(r.n_chars == len(r.text) for f in frames[1:-1] for r in f.collect())
    test_packing.check(list(texts[3].items()), frames[4].collect(), SEQUENCE_TOKENS)


def test_run_and_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
