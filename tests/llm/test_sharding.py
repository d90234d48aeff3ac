import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from starcellar.llm import sharding, tables
from starcellar.llm.sharding import least_loaded, shard_documents


def checked(rows, texts, shards=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert {(r.law, r.grown_shard) for r in rows} <= {("bytes", None)}
    slots, load = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(load) <= set(range(shards))
    of_text = defaultdict(set)
    for r in rows:
        of_text[(r.size, r.text_crc32) if r.size > 1 else "empty"].add(r.shard)
    assert all(len(s) == 1 for t, s in of_text.items() if t != "empty")
    return load


@pytest.mark.parametrize("bins", [4096, 3])
def test_edge_cases(docs, texts, bins):
    checked(shard_documents(docs, bins=bins).collect(), texts)


def test_balance_with_a_hot_text(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 64)
    draw = random.Random(3)
    rows = [(i, "w " * draw.randint(0, 60)) for i in range(800)] + [(2000 + i, "hot " * 3) for i in range(300)]
    rows += [(5000, "same row")] * 200
    rows = [(i, t + (f" {i}" if i < 2000 else "")) for i, t in rows]
    load = checked(shard_documents(make_docs(rows)).collect(), rows)
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values())


def planned(texts, shards=8, bins=4096):
    """Shards by the schedule over the whole list of groups: heavy ones alone, the others by the bin of their digest."""
    group, total = Counter(), 0
    for _, text in texts:
        group["" if text is None else hashlib.sha256(text.encode()).hexdigest()] += len((text or "").encode()) + 1
    total = sum(group.values())
    units, unit_of = Counter(), {}
    for digest, size in group.items():
        unit_of[digest] = digest if size > total / bins else f"bin {hashed(digest) % bins:08d}"
        units[unit_of[digest]] += size
    load, shard_of = [0] * shards, {}
    for unit, size in sorted(units.items(), key=lambda x: (-x[1], x[0])):
        shard_of[unit] = load.index(min(load))
        load[shard_of[unit]] += size
    return {digest: shard_of[unit] for digest, unit in unit_of.items()}


def hashed(text):
    value = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize(("bins", "cell"), [(4096, 65536), (5, 16)])
def test_shards_and_slots_against_the_whole_list(docs, texts, bins, cell, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", cell)
    want = planned(texts, bins=bins)
    cells = max(1, -(-len(texts) // cell))
    got = shard_documents(docs, bins=bins).collect()
    expected = Counter((i, want["" if t is None else hashlib.sha256(t.encode()).hexdigest()],
                        len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.shard, r.size, r.text_crc32) for r in got) == expected
    if cells == 1:  # slots follow id, size and crc32 within a shard
        for shard in range(8):
            rows = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
            order = [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows]
            assert order == sorted(order) and [r.slot for r in rows] == list(range(len(rows)))


def test_a_hot_row_unfolds_in_steps(make_docs, monkeypatch):
    monkeypatch.setattr(tables.unfolded, "__defaults__", (50,))
    rows = [(1, "hot")] * 730 + [(i, f"text {i}") for i in range(60)]
    checked(shard_documents(make_docs(rows)).collect(), rows)


def test_longest_first():
    assert least_loaded({"a": 3, "b": 3, "c": 2, "d": 2, "e": 2}, 2) == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 0}
    sizes = {str(i): random.Random(i).randint(1, 1000) for i in range(500)}
    load = Counter()
    for unit, shard in least_loaded(sizes, 7).items():
        load[shard] += sizes[unit]
    assert max(load.values()) <= (4 / 3) * sum(sizes.values()) / 7


def test_empty(no_docs):
    assert shard_documents(no_docs).collect() == []


def test_same_result_however_dealt(docs):
    take = lambda df: sorted(map(tuple, shard_documents(df).collect()), key=repr)
    assert take(docs) == take(docs.repartition(7, "n_chars"))
