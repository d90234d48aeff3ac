import random

import corpus_pipeline
import pytest
from starcellar.llm.tables import stored
from tests.llm.conftest import sentence


@pytest.fixture(scope="module")
def folder_of_tables(spark, make_docs, tmp_path_factory):
    draw = random.Random(21)
    folder = str(tmp_path_factory.mktemp("corpus"))
    item = f"{sentence(draw, 20)}? {sentence(draw, 9)}"
    rows = [(i, sentence(draw, 60)) for i in range(200)]
    rows = [(i, t + " blarg" * 3 if i % 10 == 0 else t) for i, t in rows]
    rows += [(300, rows[7][1]), (301, rows[7][1]), (301, rows[7][1]), (302, f"{sentence(draw, 30)} {item} {sentence(draw, 30)}"),
             (303, "password = abcdefghijklmnop " + sentence(draw, 30)), (304, None), (305, ""), (None, sentence(draw, 50))]
    make_docs(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, folder_of_tables):
    docs = spark.read.parquet(f"{folder_of_tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder_of_tables), "test-stage")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    clean = {i for i in range(200) if i % 10}
    assert set(seen["toxicity"]) == clean | {300, 301, 302, 303, 304, 305, None}
    assert set(seen["simhash near-dedup"]) == clean | {302, 303, 304, None}  # 304 and 305 have no words
    assert set(seen["benchmark decontamination"]) == clean | {303, 304, None}
    assert seen["secret scans"][303].text.startswith("[secret] ")
    assert seen["secret scans"][303].n_chars == len(seen["secret scans"][303].text)
    assert set(seen["byte-level bpe"]) == clean | {303, 304, None}
    run = {tuple(r) for r in corpus_pipeline.run(spark, folder_of_tables).collect()}
    assert run == {tuple(r) for r in seen["byte-level bpe"].values()}


def test_empty_tables(spark, no_docs, tmp_path):
    folder = str(tmp_path)
    no_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
