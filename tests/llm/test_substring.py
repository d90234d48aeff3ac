import random

import pytest

from starcellar.llm import substring
from starcellar.llm.substring import remove_repeats
from tests.llm.conftest import bag


def expected(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for at in range(len(w) - 12):
            run = tuple(w[at:at + 13])
            if i is not None:
                first[run] = min(i, first.get(run, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for at in range(len(w) - 12):
            if i is not None and first[tuple(w[at:at + 13])] < i:
                gone[at:at + 13] = [True] * 13
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 3_000])
def test_against_all_windows(docs, texts, block_bytes):
    got = remove_repeats(docs, block_bytes=block_bytes).drop("factors").collect()
    assert bag(got) == bag(expected(texts))


def test_few_words_many_repeats(make_docs, monkeypatch):
    monkeypatch.setattr(substring, "CROWD", 2)
    monkeypatch.setattr(substring, "SLICE", 400)
    monkeypatch.setattr(substring, "PIECE", 64)
    draw = random.Random(2)
    base = [draw.choice("ab") for _ in range(60)]
    rows = []
    for i in range(60):  # passages of two words, so anchors are crowded and stretches differ
        at = draw.randint(0, 30)
        rows.append((i * 3 % 61, " ".join([draw.choice("abc") for _ in range(draw.randint(0, 9))] + base[at:at + draw.randint(5, 30)]
                                          + [draw.choice("abc") for _ in range(draw.randint(0, 9))])))
    rows += [(100, "of " * 40), (101, "of " * 30), (99, "of " * 13), (98, "of " * 12)]
    got = remove_repeats(make_docs(rows), block_bytes=700).drop("factors").collect()
    assert bag(got) == bag(expected(rows))


def assert_greedy(rows, parsed):
    """Each text's factors against a parse that tries all places of the references which the factors name."""
    words = [(i, (t or "").split()) for i, t in rows]
    holders, by_id = {}, dict(words)
    for i, w in words:
        for at in range(len(w) - 12):
            if i is not None:
                holders.setdefault(tuple(w[at:at + 13]), set()).add(i)

    def match(own, other, at, place):
        n = 0
        while at + n < len(own) and place + n < len(other) and own[at + n] == other[place + n]:
            n += 1
        return n

    parsed = dict(parsed)
    for i, w in words:
        factors, at = iter(parsed[i]), 0
        while i is not None and at <= len(w) - 13:
            earlier = {j for j in holders[tuple(w[at:at + 13])] if j < i}
            if not earlier:
                at += 1
                continue
            start, size, reference, place = next(factors)
            assert start == at and reference in earlier
            other = by_id[reference]
            assert (size, -place) == max((match(w, other, at, p), -p) for p in range(len(other)))
            at += size - 12
        assert next(factors, None) is None


def factors_of(docs, **options):
    return [(r.doc_id, [tuple(f) for f in r.factors]) for r in remove_repeats(docs, **options).collect()]


def rows_of_two_words(n, draw):
    """Passages of few words, so that a window stands at many places and matches run over each other."""
    base = [draw.choice("ab") for _ in range(80)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(draw.randint(1, 4)):
            at = draw.randint(0, 60)
            parts += base[at:at + draw.randint(5, 30)] + [draw.choice("abc") for _ in range(draw.randint(0, 3))]
        rows.append((i * 7 % 101, " ".join(parts)))
    return rows + [(200, "of " * 60), (201, "of " * 300), (202, "of " * 13 + "off " + "of " * 45), (203, "of " * 12)]


@pytest.mark.parametrize("block_bytes", [1 << 24, 700])
def test_greedy_factors(make_docs, monkeypatch, block_bytes):
    monkeypatch.setattr(substring, "PLACES", 50)
    monkeypatch.setattr(substring, "SLICE", 900)
    rows = rows_of_two_words(90, random.Random(5))
    assert_greedy(rows, factors_of(make_docs(rows), block_bytes=block_bytes))


def test_greedy_factors_of_the_corpus(make_docs, texts):
    rows = list(dict(texts).items())
    assert_greedy(rows, factors_of(make_docs(rows), block_bytes=3_000))


def test_a_passage_across_two_references(make_docs):
    draw = random.Random(3)
    a, b, c = ([f"w{draw.randint(0, 10**6)}" for _ in range(30)] for _ in range(3))
    rows = [(1, a), (2, b), (3, a[10:] + b[:20]), (4, a[20:] + b[:10] + c), (5, a + b)]
    got = dict(factors_of(make_docs([(i, " ".join(w)) for i, w in rows])))
    assert got[3] == [(0, 20, 1, 10), (20, 20, 2, 0)]
    assert got[4] == [(0, 20, 3, 10)]
    # the windows over the end of the factor stand in the third document alone, then the second goes on
    assert got[5] == [(0, 30, 1, 0), (18, 32, 3, 8), (38, 22, 2, 8)]


def test_lent_to_many_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(substring, "ASKERS", 3)
    text = " ".join(f"word{n}" for n in range(50))
    rows = [(i, f"{text} own{i}") for i in range(40)]
    got = dict(factors_of(make_docs(rows), block_bytes=500))
    assert got == {0: [], **{i: [(0, 50, 0, 0)] for i in range(1, 40)}}


def test_factors_are_found_in_their_reference(docs, texts):
    words = {}
    for i, t in texts:
        words.setdefault(i, []).append((t or "").split())
    for r in remove_repeats(docs).where("n_removed > 0").collect():
        own = next(w for w in words[r.doc_id] if len(w) == r.n_words)
        covered = set()
        for f in r.factors:
            assert f.words >= 13 and f.reference < r.doc_id
            part = own[f.start:f.start + f.words + 1]
            others = [w[f.place:f.place + f.words + 1] for w in words[f.reference]]
            assert any(w[:f.words] == part[:f.words] and (len(part) == f.words or w != part) for w in others)
            covered.update(range(f.start, f.start + f.words))
        assert len(covered) == r.n_removed


def test_ids_of_all_sizes(make_docs):
    text = " ".join(f"word{n}" for n in range(20))
    rows = [(i, text) for i in (2**63 - 1, -2**63, 0, -1, 7)] + [(5, f"{text} more")]
    got = remove_repeats(make_docs(rows), block_bytes=100).drop("factors").collect()
    assert bag(got) == bag(expected(rows))


def test_empty(no_docs):
    assert remove_repeats(no_docs).collect() == []
