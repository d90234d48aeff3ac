import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from starcellar.llm.quality import (
    FEATURES, Block, blocks_of, exact, features, inexact, learn, learn_blocks, ordered, quality, smallest,
)
from tests.llm.conftest import sentence


def labelled(spark, make_docs, n=500):
    draw = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good, text = i % 4 > 0, sentence(draw, draw.randint(20, 150))
        if not good:
            text = draw.choice([lambda t: t.replace(" ", "### "), str.upper, lambda t: (t.split()[0] + " ") * 60])(text)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(n, None), (n + 1, ""), (None, "some text"), (0, rows[0][1])]
    return make_docs(rows), spark.createDataFrame([*labels, (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, make_docs):
    docs, labels = labelled(spark, make_docs)
    rows = quality(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 500 and r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.predicted == (r.doc_id % 4 > 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    again = quality(docs.repartition(5), labels.repartition(2)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)


def test_a_score_does_not_depend_on_the_rows_beside_it():
    draw = np.random.default_rng(1)
    rows = draw.random((500, len(FEATURES)))
    ranking = learn(rows, (rows[:, 2] > 0.4).astype(int))
    alone = [ranking.score(rows[i:i + 1])[0] for i in range(len(rows))]
    assert alone == ranking.score(rows).tolist() == np.concatenate([ranking.score(rows[:7]), ranking.score(rows[7:])]).tolist()


def test_labels_of_one_kind_and_none(spark, docs, no_docs, texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality(no_docs, none).collect() == []
    for value in (0, 1):
        one = spark.createDataFrame([(i, value, 0) for i in range(40)], none.schema)
        rows = quality(docs, one).collect()
        assert len(rows) == len(texts) and {r.predicted for r in rows} == {value}
    assert {r.predicted for r in quality(docs, none).collect()} == {1}


def test_pairs_teach_the_direction():
    draw = np.random.default_rng(0)
    rows = draw.random((400, len(FEATURES)))
    good = (rows[:, 3] + 0.05 * draw.standard_normal(400) > 0.5).astype(int)
    ranking = learn(rows, good)
    score = ranking.score(rows)
    assert ((score >= 0.7) == good).mean() > 0.9
    assert np.corrcoef(ranking.rank(rows), rows[:, 3])[0, 1] > 0.9


def test_features():
    assert features("") == features(" \n ") == [0.0] * len(FEATURES)
    assert len(features("a b\nc")) == len(FEATURES)
    assert dict(zip(FEATURES, features("A a a $")))["repeated neighbours"] == 0.25


def examples_of(spark, n, poor):
    draw = np.random.default_rng(4)
    rows = [(i, int(i not in poor), draw.random(len(FEATURES)).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "sample_id long, label int, features array<double>")


def test_every_labelled_document_is_learnt_from(spark):
    """Twenty-one thousand labels, more than a block: none is left out, however the rows are dealt."""
    rows, examples = examples_of(spark, 21_000, set(range(0, 21_000, 7)))
    total = blocks_of(examples)
    count, sums = lambda b: np.array([len(b.rows), b.own.sum()]), lambda b: b.rows.sum(axis=0)
    assert total(count).tolist() == [21_000, 21_000]
    assert np.allclose(total(sums), np.sum([r[2] for r in rows], axis=0), rtol=1e-12)
    assert total(lambda b: np.array([max(len(b.rows), 0) > 20_000])).tolist() == [0]
    again = blocks_of(examples.repartition(7))
    assert again(sums).tolist() == total(sums).tolist()
    assert learn_blocks(total) == learn_blocks(again)


def test_labels_beyond_the_first_blocks_decide(spark, make_docs):
    """What is poor shows in few documents, so it matters that no labelled document is left out."""
    docs, labels = labelled(spark, make_docs, 400)
    few = quality(docs, labels, block_rows=60).collect()
    again = quality(docs.repartition(5), labels.repartition(3), block_rows=60).collect()
    assert sorted(map(tuple, few), key=repr) == sorted(map(tuple, again), key=repr)
    held = [r for r in few if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 > 0) for r in held) / len(held) > 0.95


def test_a_rare_class_is_in_every_block_and_counted_once(spark):
    _, examples = examples_of(spark, 600, {5})
    total = blocks_of(examples, 50)
    assert total(lambda b: np.array([1, (b.good == 0).sum(), (b.own & (b.good == 0)).sum(), b.own.sum()])).tolist() == [12, 12, 1, 600]
    assert blocks_of(examples.where(F.lit(False))) is None


def test_one_block_is_learnt_as_before(spark):
    rows, examples = examples_of(spark, 300, set(range(0, 300, 3)))
    kept = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    order = np.lexsort((*kept[0].T, kept[1]))
    want, found = learn(kept[0][order], kept[1][order]), learn_blocks(blocks_of(examples))
    assert np.allclose(found.weights, want.weights, rtol=1e-9) and np.isclose(found.middle, want.middle, rtol=1e-9)


def test_values_by_their_place():
    draw = np.random.default_rng(3)
    values = np.concatenate([draw.standard_normal(50), np.repeat([0.0, -0.0, 1e-300, -7.5, 1e300], 3)])
    assert (np.argsort(ordered(values), kind="stable") == np.argsort(values + 0.0, kind="stable")).all()
    parts = [Block(values[i::3], np.zeros(0), np.zeros(0)) for i in range(3)]
    total = lambda f: inexact([sum(x) for x in zip(*(exact(f(b)) for b in parts), strict=True)])
    assert [smallest(total, lambda b: b.rows, i) for i in range(len(values))] == sorted(values.tolist())
