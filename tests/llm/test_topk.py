import math
import random

import numpy as np
import pytest

from starcellar.llm import topk
from starcellar.llm.topk import cover_tree, dual_search, top_k
from tests.llm.conftest import bag


def expected(rows, k=5, every=50):
    valid = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            valid.append((i, tuple(math.floor(256 * x) for x in v)))
    valid = sorted(set(valid))
    out = []
    for q, a in valid:
        if q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in valid if i != q and len(b) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block", [4096, 37])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    draw = random.Random(block)
    centers = [[draw.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + draw.gauss(0, 0.1) for x in draw.choice(centers)]) for i in range(400)]
    rows += [(500 + i, [0.5] * 8) for i in range(12)] + [(600, [0.5] * 8), (600, [0.5] * 8), (650, [0.1] * 8), (650, [0.2] * 8)]
    rows += [(700, None), (None, [0.5] * 8), (750, [0.1] * 7 + [None]), (800, [math.nan] + [0.1] * 7), (850, [math.inf] * 8)]
    rows += [(900, [1.0, 2.0]), (901, [3.0, 4.0]), (950, []), (1000, [0.1])]
    frame = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<double>, id long, rank int, score double")
    assert bag(top_k(frame).collect()) == bag(expected(rows))


def test_large_components():
    draw = np.random.default_rng(4)
    points = draw.integers(-(10**12), 10**12, (60, 3))
    scores, ids = dual_search(points[:5], np.arange(5), points, np.arange(60), 4)
    for q in range(5):
        want = sorted((-int(sum(int(x) * int(y) for x, y in zip(points[q], p))), i) for i, p in enumerate(points) if i != q)[:4]
        assert [(-int(s), int(i)) for s, i in zip(scores[q], ids[q])] == want


def test_tree_covers_its_points():
    points = np.random.default_rng(2).standard_normal((900, 5))
    seen, todo = [], [cover_tree(points)]
    while todo:
        node = todo.pop()
        assert np.linalg.norm(points[node.members] - node.center, axis=1).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.members for c in node.children])) == sorted(node.members)
        else:
            seen += node.members.tolist()
        todo += node.children
    assert sorted(seen) == list(range(900))


def test_clustered_points():
    draw = np.random.default_rng(5)
    centers = draw.standard_normal((20, 16)) * 100
    points = np.rint(centers[draw.integers(20, size=3000)] + draw.standard_normal((3000, 16))).astype(np.int64)
    scores, _ = dual_search(points[:50], np.arange(50), points, np.arange(3000), 5)
    every = points[:50] @ points.T
    every[np.arange(50), np.arange(50)] = -(1 << 60)
    assert (scores == -np.sort(-every, axis=1)[:, :5]).all()


def test_empty(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
