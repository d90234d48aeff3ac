import hashlib
import math
import random
from collections import Counter

import numpy as np

from starcellar.llm.queries import op12_vector_codes
from starcellar.llm.vector_codes import REACH, Balls, squares, vector_codes
from tests.llm.conftest import bag

SCHEMA = "vec_id long, embedding array<float>, label int, code string, place long, vector string, of int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, n, "c", 1, "v", 2) for i, v, n in rows], SCHEMA)


def coded(rows, entries=256):
    """Rows (vec_id, code, error, label_error, digest) by comparing every part with every entry."""
    kept = [(i, [math.floor(float(np.float32(x)) * 1024) for x in v], n) for i, v, n in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4)
    kept = sorted(((i, v + [0] * (4 * width - len(v)), n) for i, v, n in kept),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = [[v[p * width:(p + 1) * width] for _, v, _ in kept] for p in range(4)]
    books = [[list(x) for x in part[:entries]] for part in parts]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))
    for _ in range(4):
        for part, book in zip(parts, books):
            of = [nearest(x, book)[1] for x in part]
            for n in set(of):
                held = [x for x, o in zip(part, of) if o == n]
                book[n] = [sum(column) // len(held) for column in zip(*held)]
    found = [[nearest(part[k], book) for part, book in zip(parts, books)] for k in range(len(kept))]
    label_error = Counter()
    for (_, _, n), f in zip(kept, found):
        label_error[n] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for _, c in f), sum(d for d, _ in f), label_error[n], digest)
            for (i, _, n), f in zip(kept, found)]


def vectors(size, width, draw, spread=0.2):
    return [(i, [draw.gauss(draw.choice([-1, 0, 1]), spread) for _ in range(width)], draw.choice([None, 1, 2])) for i in range(size)]


def test_against_every_entry(spark):
    draw = random.Random(4)
    rows = vectors(300, 8, draw)
    rows += [(1000, None, 1), (1001, [None] * 8, 1), (1002, [math.nan] * 8, 2), (1003, [math.inf] * 8, None)]
    rows += [(None, rows[0][1], 1), (None, rows[1][1], None), (7, rows[9][1], 2), (7, rows[9][1], 2), (1004, [0.5], 1), (1005, [], 1)]
    rows += [(2000 + i, rows[3][1], 1) for i in range(100)]
    for entries in (256, 5):
        assert bag(vector_codes(frame(spark, rows).repartition(4), entries=entries).collect()) == bag(coded(rows, entries))


def test_lengths_that_the_parts_do_not_divide(spark):
    rows = vectors(40, 6, random.Random(1))
    assert bag(vector_codes(frame(spark, rows), entries=9).collect()) == bag(coded(rows, 9))


def test_equal_entries_go_to_the_lower(spark):
    rows = [(i, [float(i % 2)] * 4, None) for i in range(12)]
    got = vector_codes(frame(spark, rows), entries=6).collect()
    assert bag(got) == bag(coded(rows, 6)) and {r.code for r in got} == {"00000000", "01010101"}


def test_few_empty_and_no_vectors(spark):
    assert vector_codes(frame(spark, [])).collect() == []
    assert vector_codes(frame(spark, [(1, None, 1)])).collect() == []
    assert bag(vector_codes(frame(spark, [(1, [0.1, 0.2, 0.3, 0.4], 3)])).collect()) == bag(coded([(1, [0.1, 0.2, 0.3, 0.4], 3)]))
    assert sorted(tuple(r)[:4] for r in vector_codes(frame(spark, [(1, [], 3), (2, [], 3)])).collect()) == [
        (1, "00000000", 0, 0), (2, "00000000", 0, 0)]


def test_large_components(spark):
    rows = [(i, [1e4 * (i % 7), 3e38 if i % 3 else -3e38, 0.5, float(i)], 1) for i in range(30)]
    got = vector_codes(frame(spark, rows), entries=4).collect()
    cut = [(i, [max(-REACH, min(REACH, math.floor(float(np.float32(x)) * 1024))) / 1024 for x in v], n) for i, v, n in rows]
    assert bag(got) == bag(coded(cut, 4))


def test_balls_agree_with_all_entries():
    draw = np.random.default_rng(3)
    for top in (40, 1 << 25):
        points = draw.integers(-top, top, (500, 3))
        entries = np.concatenate([draw.integers(-top, top, (30, 3)), points[:5], points[:5]])
        far = squares(points, entries)
        assert (far == ((points[:, None] - entries[None]) ** 2).sum(axis=2)).all()
        for home in (np.zeros(500, np.int64), draw.integers(0, len(entries), 500)):
            code, own = Balls(entries, None).assign(points, home)
            assert (code == far.argmin(axis=1)).all() and (own == far.min(axis=1)).all()
        after = entries.copy()
        after[3] += 2
        code, own = Balls(after, entries).assign(points, far.argmin(axis=1))
        assert (code == squares(points, after).argmin(axis=1)).all() and (own == squares(points, after).min(axis=1)).all()


def test_stable_balls_are_skipped(monkeypatch):
    entries = np.array([[0, 0], [100, 0], [0, 100]])
    points = np.array([[1, 1], [99, 0], [1, 99], [52, 0]])
    home = squares(points, entries).argmin(axis=1)
    ball, seen = Balls(entries, entries), []
    monkeypatch.setattr("starcellar.llm.vector_codes.squares", lambda a, b: seen.append(len(a)) or squares(a, b))
    code, own = ball.assign(points, home)
    assert code.tolist() == home.tolist() and not seen
    assert own.tolist() == squares(points, entries).min(axis=1).tolist()


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert bag(op12_vector_codes(spark, folder).collect()) == bag(coded(rows))
