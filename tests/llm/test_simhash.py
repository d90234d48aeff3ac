import itertools
import random

import numpy as np
import pytest
import xxhash

from starcellar.llm.components import components
from starcellar.llm.simhash import Linker, bucket_keys, near_links, one_of_each, simhash_groups, stars
from tests.llm.conftest import bag


def fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            parent[top(a)] = top(b)
    return {n: top(n) for n in nodes}


def near(a, b, radius=3):
    return (a ^ b).bit_count() <= radius


def test_against_all_pairs(docs, texts):
    prints = [fingerprint(t) for _, t in texts]
    root = roots(set(prints), near)
    least = {}
    for (i, _), p in zip(texts, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = [(i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(texts, prints)]
    assert bag(simhash_groups(docs).select("doc_id", "fingerprint", "component_id").collect()) == bag(want)


def test_one_of_each(docs, texts):
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    prints = [fingerprint(r.text) for r in rows]
    root = roots({fingerprint(t) for _, t in texts}, near)
    assert len(rows) == len(set(root.values())) == len({root[p] for p in prints})
    for r, p in zip(rows, prints):  # the smallest id of its component
        assert r.doc_id == min((i for i, t in texts if i is not None and root[fingerprint(t)] == root[p]), default=None)


def test_empty(no_docs):
    assert simhash_groups(no_docs).collect() == []
    assert one_of_each(no_docs).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_linker_finds_all_within_the_radius(radius):
    draw = np.random.default_rng(radius)
    centers = draw.integers(0, 2**64, 12, dtype=np.uint64)
    prints = {int(c) ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 6), replace=False)) for c in centers for _ in range(25)}
    prints = np.array(sorted(prints), dtype=np.uint64)
    groups = [(prints[:1], prints[:1]), (prints[:70], prints[:70]), (prints[70:], prints[70:]), (prints[:65], prints[100:])]
    got = {(int(a), int(b)) for x, y in Linker(radius).links(groups) for a, b in zip(x, y)}
    want = {(int(a), int(b)) for q, c in groups for a in q for b in c if near(int(a), int(b), radius)}
    assert got == want


def test_a_crowded_bucket_is_cut_into_blocks(spark):
    draw = random.Random(5)
    prints, at = set(), 0x0123456789ABCDEF
    for _ in range(300):  # a path of neighbours
        at ^= 1 << draw.randrange(20)
        prints.add(at)
    prints |= {draw.getrandbits(63) for _ in range(50)}
    nodes = spark.createDataFrame([(p,) for p in prints], "bits long")
    for block in (7, 10_000):
        links = near_links(nodes, block=block)
        found = {r.node: r.root for r in components(links).collect()}
        want = roots(prints, near)
        for a, b in itertools.combinations(prints, 2):
            assert (found.get(a, a) == found.get(b, b)) == (want[a] == want[b])


def test_keys_of_near_fingerprints_meet(spark):
    draw = random.Random(1)
    pairs = []
    for _ in range(200):
        a = draw.getrandbits(64)
        b = a ^ sum(1 << i for i in draw.sample(range(64), draw.randint(0, 3)))
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    rows = df.select(bucket_keys(df["a"], 3).alias("x"), bucket_keys(df["b"], 3).alias("y")).collect()
    assert all(set(r.x) & set(r.y) for r in rows)
    assert {len(set(r.x)) for r in rows} == {10}


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 140)] + [(300, 301), (301, 302), (302, 300)]
    links += [(400, 400), (None, 3), (5, 4), (-7, -3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in [*range(100, 140), 200]} | {i: 300 for i in (300, 301, 302)} | {-7: -7, -3: -7}
    assert got == want


def test_stars_hold_parts_together():
    nodes, least = stars(np.array([9, 4, 7], np.uint64), np.array([4, 2, 8], np.uint64))
    assert dict(zip(nodes.tolist(), least.tolist())) == {2: 2, 4: 2, 9: 2, 7: 7, 8: 7}
