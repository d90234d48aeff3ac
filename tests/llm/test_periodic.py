import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starcellar.llm import periodic
from starcellar.llm.periodic import best_run, candidates, periodic_runs, run_text, runs_of, stretched
from starcellar.llm.queries import op11_periodic_runs
from starcellar.llm.recompression import Grammar
from tests.llm.conftest import bag


def all_runs(words):
    """Every maximal stretch by comparing all neighbours at all periods."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                body = words[start:start + length]
                if all(body[d:] != body[:length - d] for d in range(1, q)):
                    found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made(draw):
    letters, words = draw.choice([1, 2, 3, 10]), []
    for _ in range(draw.randint(0, 6)):
        unit = [draw.randrange(letters) for _ in range(draw.randint(1, 7))]
        words += (unit * 8)[:draw.randint(1, 8 * len(unit))] if draw.random() < 0.5 else unit
    return words


@pytest.mark.parametrize("rounds", [8, 0])
def test_runs_against_all_stretches(rounds, monkeypatch):
    monkeypatch.setattr(periodic, "ROUNDS", rounds)
    monkeypatch.setattr(periodic, "GRID", 50)
    monkeypatch.setattr(periodic, "QUERIES", 7)
    draw = random.Random(1)
    for _ in range(150):
        texts = [made(draw) for _ in range(draw.randint(1, 6))]
        words = np.array([w for t in texts for w in t], dtype=np.int64)
        got = runs_of(words, np.array([len(t) for t in texts]))
        assert [tuple(r) for r in got.tolist()] == [(n, *r) for n, t in enumerate(texts) for r in all_runs(t)]


def test_extensions_against_comparison():
    draw = random.Random(5)
    for letters in (1, 2, 5):
        unit = [draw.randrange(letters) for _ in range(9)]
        inner = [draw.randrange(letters) for _ in range(80)] + unit * 12 + [draw.randrange(letters) for _ in range(80)]
        sequence = np.array([100, *inner, 200])
        pairs = np.array([(a, b) for a in range(len(sequence)) for b in range(len(sequence)) if a != b])
        want = []
        for a, b in pairs.tolist():
            n = 0
            while max(a, b) + n < len(sequence) and sequence[a + n] == sequence[b + n]:
                n += 1
            want.append(n)
        assert Grammar(sequence).common(pairs[:, 0], pairs[:, 1]).tolist() == want


def test_equal_words_on_a_grid_alone_are_no_candidates():
    words = np.arange(4000)
    words[::2] = 5000
    assert len(candidates(words, np.array([0]), np.array([len(words)]))) == 0


def test_every_document(spark, docs, texts, make_docs):
    draw = random.Random(2)
    more = [(200 + i, " ".join(f"w{w}" for w in made(draw))) for i in range(60)]
    more += [(300, "a b c " * 30_000), (301, "x " * 7), (302, "x y " * 5), (303, "\n\tz" * 6)]
    df = docs.unionByName(make_docs(more)).repartition(5)
    rows = periodic_runs(df).collect()
    want = []
    for i, text in [*texts, *more]:
        words = words_of(text)
        runs = all_runs(words) if i != 300 and len(words) < 5000 else [(0, 90_000, 3)] if i == 300 else []
        want.append((i, runs, dropped(words, runs)))
    assert bag((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in rows) == bag(want)


def test_best_run_and_texts(spark):
    rows = spark.createDataFrame(
        [(1, [(0, 9, 2), (20, 12, 3), (40, 8, 2), (60, 18, 4)]), (2, []), (3, [(5, 8, 2), (5, 16, 4)])],
        f"doc_id long, runs {periodic.RUNS}")
    got = {r.doc_id: (r.best and tuple(r.best), r.t) for r in rows.select(
        "doc_id", best_run(F.col("runs")).alias("best"), run_text(F.col("runs")).alias("t")).collect()}
    assert got == {1: ((0, 9, 2), "0,9,2\n20,12,3\n40,8,2\n60,18,4\n"), 2: (None, ""), 3: ((5, 8, 2), "5,8,2\n5,16,4\n")}


def repeated(doc_id, text):
    words = words_of(text)
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_stretched(docs, texts):
    assert bag((r.doc_id, words_of(r.text)) for r in stretched(docs).collect()) == bag(
        (i, repeated(i, t)) for i, t in texts)


def test_query(spark, folder):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        words = repeated(*row)
        runs = all_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        want.append((row.doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
                     sha(dropped(words, runs))))
    assert bag(op11_periodic_runs(spark, folder).collect()) == bag(want)


def test_empty(no_docs):
    assert periodic_runs(no_docs).collect() == []
    assert stretched(no_docs).collect() == []
