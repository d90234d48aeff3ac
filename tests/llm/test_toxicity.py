import hashlib
import random
import zlib

import pytest

from starcellar.llm.toxicity import (
    COVER, Lexicon, bounded_sample, explaining, fold, lexicon_from, score_toxicity, toxicity, weight_of, without_toxic,
)
from tests.llm.conftest import sentence

LEXICON = Lexicon(((" idiot ", 3.0), (" idio", 1.0), (" scum", 2.0)), ("pond scum", "trash can"), (-5.0, 2.0))


def test_folding():
    assert fold("Idiot") == fold("1D10T") == fold("іdіоt") == fold("ídiót")
    assert fold("$cum") == " scum " and fold("a_b-c\n d") == " a b c d "
    assert fold("") == "  "
    assert fold("\U0001d408\U0001d403\U0001d408\U0001d40e\U0001d413") == fold("\u2111dio\u0054") == fold("idiot")
    assert fold("id\u200biot") == fold("i\u00addi\u2060ot") == fold("idiot")


@pytest.mark.parametrize(("text", "weight", "words"), [
    ("", 0.0, 0), ("an idiot", 3.0, 2), ("idiots", 1.0, 1), ("1d1ot!! scummy", 3.0, 2), ("the pond scum", 0.0, 3),
    ("pond scum and scum", 2.0, 4), ("xidiot", 0.0, 1), ("idiot idiot", 6.0, 2),
])
def test_weights(text, weight, words):
    assert weight_of(text, LEXICON) == (weight, words)


def test_brute_force_matching():
    draw = random.Random(1)
    for _ in range(200):
        text = " ".join(draw.choice(["idiot", "Idio", "scum", "pond", "scums", "trash", "can", "x1"]) for _ in range(draw.randint(0, 12)))
        words = text.lower().replace("1", "i").split()
        want = 0.0
        for n, w in enumerate(words):
            if w.startswith("scum") and n and words[n - 1] == "pond" and w == "scum":
                continue
            want += 3.0 if w == "idiot" else 1.0 if w.startswith("idio") else 2.0 if w.startswith("scum") else 0.0
        assert weight_of(text, LEXICON) == (want, len(words))


def labelled(spark, draw, make_docs, n=600):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = sentence(draw, draw.randint(5, 200)).split()
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words.insert(draw.randrange(len(words) + 1), draw.choice(["blarg", "BL4RG", "grunkleh", "grunkles", "grunklex"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "blarg blarg"), (n + 2, "\n\n")]
    return make_docs(rows), spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None), (3, 0, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, make_docs):
    docs, labels = labelled(spark, random.Random(2), make_docs)
    rows = toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert next(r for r in rows if r.doc_id is None).predicted == 1
    assert {r.predicted for r in rows if r.doc_id in (600, 601, 602)} == {0}
    kept = without_toxic(docs, lexicon_from(docs, labels))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_labels_held_out_are_not_learnt(spark, make_docs):
    docs, labels = labelled(spark, random.Random(2), make_docs)
    turned = labels.rdd.map(lambda r: (r.doc_id, r.quality, 1 - r.toxic if r.toxic is not None and r.doc_id is not None
                                       and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.toxic)).toDF(labels.schema)
    assert lexicon_from(docs, labels) == lexicon_from(docs, turned)


def test_without_labels_or_documents(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity(no_docs, none).collect() == []
    assert {r.score for r in toxicity(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(40)], none.schema)
    assert {r.predicted for r in toxicity(docs, one).collect()} == {0}


def test_same_scores_however_dealt(spark, make_docs):
    docs, labels = labelled(spark, random.Random(3), make_docs)
    once = sorted(map(tuple, toxicity(docs, labels).collect()), key=repr)
    assert sorted(map(tuple, toxicity(docs.repartition(7), labels.repartition(3)).collect()), key=repr) == once


def test_the_sample_is_bounded_where_ids_repeat(spark, make_docs):
    docs = make_docs([(1, f"copy {i}") for i in range(3000)] + [(1, "copy 5"), (2, "b"), (2, None), (3, None), (None, "x")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = bounded_sample(labels, docs, "toxic", lambda i: i > 0, 100).collect()
    first = min((f"copy {i}" for i in range(3000)), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert sorted((r.sample_id, r.label) for r in rows) == [(1, 0), (2, 1), (3, 1)]
    assert next(r.text for r in rows if r.sample_id == 1) == first
    assert bounded_sample(labels, docs, "toxic", lambda i: i > 0, 2).count() == 2


def test_choice_of_entries_against_plain_greedy():
    """Each time the term that explains most, counted anew for all terms."""
    draw = random.Random(8)
    for _ in range(60):
        terms = sorted({" " + "".join(draw.choice("ab") for _ in range(draw.randint(1, 4))) for _ in range(9)})
        documents = [sorted(draw.sample(range(len(terms)), draw.randint(0, len(terms)))) for _ in range(30)]
        clean = [draw.randint(0, 3) for _ in terms]
        needs, want = [COVER] * len(documents), []
        while True:
            gains = [(sum(needs[d] > 0 for d, held in enumerate(documents) if n in held) - 2 * clean[n], n)
                     for n in range(len(terms))
                     if not any(terms[n].startswith(terms[c]) or terms[c].startswith(terms[n]) for c in want)]
            best = max(gains, key=lambda g: (g[0], [-ord(c) for c in terms[g[1]]] + [0]), default=(0, 0))
            if best[0] < 3:
                break
            top = [n for gain, n in gains if gain == best[0]]
            n = min(top, key=lambda i: terms[i])
            want.append(n)
            for d, held in enumerate(documents):
                needs[d] -= n in held
        assert explaining(documents, terms, clean, 3) == want


def test_repeated_rows(docs, texts):
    assert score_toxicity(docs, LEXICON).count() == len(texts)
