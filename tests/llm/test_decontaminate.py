import random
from collections import Counter

import pytest
from pyspark import Broadcast, SparkContext

from starcellar.llm.decontaminate import (
    Index, contaminated_passages, contamination, leaks, overlap, parts_of, question_and_answer, without_leaks, words_of,
)
from tests.llm.conftest import sentence


@pytest.fixture(scope="module")
def items():
    draw = random.Random(12)
    rows = [(i, f"{sentence(draw, draw.randint(8, 30)).capitalize()}. {sentence(draw, draw.randint(3, 12))}.") for i in range(150)]
    return rows + [(200, f"{sentence(draw, 150)}? {sentence(draw, 20)}"), (201, "too short"), (202, None), (None, rows[0][1]),
                   (203, ""), rows[3], (204, sentence(draw, 20))]


def index_of(items):
    held = sorted({(i, t) for i, t in items if i is not None and t and len(words_of(t)) >= 8})
    found_in = Counter(w for _, t in held for w in set(words_of(t)))
    return Index(held, found_in, len(held), sum(len(words_of(t)) for _, t in held) / len(held)), held


def test_wand_finds_what_scoring_all_items_finds(items):
    index, held = index_of(items)
    draw = random.Random(1)
    for _ in range(300):
        passage = sentence(draw, draw.randint(0, 60)).split()
        words = words_of(draw.choice(held)[1])
        passage += words[:draw.randint(0, len(words))]
        want = {}
        for at in range(len(held)):
            score = sum(p.impacts[p.items.index(at)] for w in set(passage) if (p := index.postings.get(w)) and at in p.items)
            if score >= index.threshold:
                want[at] = score
        assert dict(index.search(passage)) == pytest.approx(want)


def test_no_passage_is_passed_over(items):
    index, held = index_of(items)
    draw = random.Random(2)
    texts = []
    for _ in range(60):
        words = words_of(draw.choice(held)[1])
        words = [w if draw.random() > 0.15 else "zzz" for w in words]
        texts.append(" ".join([sentence(draw, draw.randint(0, 700)), *words, sentence(draw, draw.randint(0, 300))]))
    step, want = index.passage // 2, set()
    for n, text in enumerate(texts):
        words = words_of(text)
        for start in range(0, len(words), step):
            passage = words[start:start + index.passage]
            for item, _ in index.search(passage):
                if min(overlap(p, passage) for p in index.parts[item]) >= 0.6:
                    want.add((n, index.ids[item], start))
    got = {row[:3] for row in leaks(texts, index)}
    assert got <= want
    assert {row[:2] for row in got} == {row[:2] for row in want}


@pytest.mark.parametrize("part_bytes", [1 << 20, 2_000])
def test_planted_items(spark, make_docs, items, part_bytes):
    draw = random.Random(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    _, held = index_of(items)
    planted = {n: held[n * 5 % len(held)] for n in range(30)}
    rows = [(n, f"{sentence(draw, draw.randint(0, 400))}\n{t.upper() if n % 3 else t}\n{sentence(draw, draw.randint(0, 90))}")
            for n, (_, t) in planted.items()]
    rows += [(100 + i, sentence(draw, 300)) for i in range(30)] + [(None, None), (200, ""), (0, rows[0][1])]
    docs = make_docs(rows)
    found = contamination(docs, bench, part_bytes=part_bytes).collect()
    assert {(n, i) for n, (i, _) in planted.items()} == {(r.doc_id, r.item_id) for r in found}
    assert all(r.score >= 0.6 and r.question_overlap >= 0.6 and r.answer_overlap >= 0.6 for r in found)
    kept = without_leaks(docs, bench, part_bytes=part_bytes)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted([*range(100, 130), 200, -1])


def test_long_items_leave_short_ones_as_they_are(spark, make_docs):
    draw = random.Random(7)
    short, long = sentence(draw, 20), " ".join(f"w{i}" for i in range(2_000))
    words = short.split()
    far = " ".join(" ".join([*words[i:i + 4], *["yyy"] * 60]) for i in range(0, 20, 4))
    docs = make_docs([(1, far), (2, f"yyy {short} yyy"), (3, f"{'yyy ' * 900}{long}")])
    for bench in ([(1, short)], [(1, short), (2, long)]):
        items = spark.createDataFrame(bench, "item_id long, text string")
        for part_bytes in (1 << 20, 100):
            found = contamination(docs, items, part_bytes=part_bytes).collect()
            assert {(r.doc_id, r.item_id) for r in found} == {(2, 1), (3, 2)} & {(i + 1, i) for i, _ in bench}


def test_short_items_stand_word_for_word(spark, make_docs, items):
    short = [(301, "Who wrote Hamlet? William Shakespeare"), (302, "Forty-two!"), (303, "zebra"), (304, "?!")]
    bench = spark.createDataFrame([*items[:20], *short], "item_id long, text string")
    filler = " ".join(["yyy"] * 62)
    rows = [(1, f"{filler} who wrote hamlet, william SHAKESPEARE? {filler}"), (2, f"{filler} {filler} the forty two"),
            (3, f"william shakespeare wrote hamlet who {filler}"), (4, "forty of two"), (5, "A Zebra."), (6, "zebras ?!")]
    found = contamination(make_docs(rows), bench).collect()
    assert {(r.doc_id, r.item_id, r.question_overlap, r.answer_overlap) for r in found} == {
        (1, 301, 1.0, 1.0), (2, 302, 1.0, 1.0), (5, 303, 1.0, 1.0)}
    assert sorted(r.doc_id for r in without_leaks(make_docs(rows), bench).collect()) == [3, 4, 6]


def test_indexes_of_parts_are_given_up(spark, make_docs, monkeypatch):
    draw = random.Random(8)
    bench = spark.createDataFrame([(i, sentence(draw, 30)) for i in range(12)], "item_id long, text string")
    docs = make_docs([(r.item_id, f"{r.text} yyy") for r in bench.collect()] + [(20, "yyy"), (21, None)])
    live, most = set(), []
    broadcast, destroy = SparkContext.broadcast, Broadcast.destroy

    def sending(self, value):
        sent = broadcast(self, value)
        live.add(id(sent))
        most.append(len(live))
        return sent

    monkeypatch.setattr(SparkContext, "broadcast", sending)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (live.discard(id(self)), destroy(self, *a))[1])
    found = contamination(docs, bench, part_bytes=800)
    kept = without_leaks(docs, bench, part_bytes=800)
    assert len(most) > 4 and max(most) == 1 and not live
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(12)}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [20, 21]


def test_without_items_or_documents(spark, docs, no_docs, items, texts):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame(items, none.schema)
    assert contaminated_passages(docs, none).collect() == []
    assert without_leaks(docs, none).count() == len(texts)
    assert contamination(no_docs, bench).collect() == []


def test_questions_and_answers():
    assert question_and_answer("What is it? A cat.") == (["what", "is", "it"], ["a", "cat"])
    assert question_and_answer("One two. Three four.") == (["one", "two"], ["three", "four"])
    assert question_and_answer("one two three") == (["one", "two"], ["three"])
    assert question_and_answer("") == ([], [])
    assert overlap("a b c d".split(), "x a b c y".split()) == 0.75
    assert overlap([], ["a"]) == 1.0


def test_near_copies_with_replaced_and_cut_off_words():
    draw = random.Random(6)
    ends = [". Two words.", ". And three words.", "? Two words.", "? One"]
    held = [(i, f"{sentence(draw, 24).capitalize()}{ends[i % 4]}") for i in range(40)]
    held += [(40 + i, f"{sentence(draw, 20)}? {sentence(draw, 12)}") for i in range(10)]
    index, held = index_of(held)
    for i, text in held:
        words = words_of(text)
        for at in range(len(words)):  # any word replaced
            copy = [*words[:at], "zzz", *words[at + 1:]]
            assert i in {row[1] for row in leaks([" ".join(["yyy"] * 90 + copy + ["yyy"] * 90)], index)}, (i, at)
        assert i in {row[1] for row in leaks([" ".join(["yyy"] * 90 + words[:-3] + ["yyy"] * 90)], index)}, i
        assert not leaks([" ".join(words[:len(words) // 2])], index)
    assert not leaks([" ".join(words_of(t)[:20]) for i, t in held if i >= 40], index)  # long answers must be there


def test_parts_that_are_judged():
    long = "one two three four five six seven eight"
    assert parts_of(f"{long}? {long}") == (long.split(), long.split())
    assert parts_of(f"{long}? {long[4:]}") == ((long + " " + long[4:]).split(),)
    assert parts_of(f"{long}. {long}.") == parts_of(f"{long} {long}?") == ((long + " " + long).split(),)
