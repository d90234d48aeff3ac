"""SimHash near duplicates: fingerprints compared bit-sliced inside blocks that agree on some of their bits."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcellar.llm.components import components
from starcellar.llm.tables import binaries, portions, slices, stored

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 3
BLOCK = 16_384  # fingerprints of one block; a larger bucket is compared block by block
PAIRS = 1 << 17  # (fingerprint, word of 64 fingerprints) pairs compared at once
LANES = np.uint64(0x0001000100010001)  # one bit of each 16-bit lane
LANE_ROWS = 65_535  # rows a 16-bit lane can count
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words; of all words where there are fewer; nothing without words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space alone
    if len(words) < size:
        runs, n = [b" ".join(words)], int(bool(words))
    else:
        runs, n = map(b" ".join, zip(*(words[i:] for i in range(size)))), len(words) - size + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, itertools.repeat(SEED)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the bits set in over half of them; no bits for an empty run."""
    out = np.zeros(len(counts), dtype=np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    sizes, ends = counts[rows], np.cumsum(counts[rows])
    parts = -(-sizes // LANE_ROWS)  # pieces of at most as many rows as a lane can count
    owner = np.repeat(np.arange(len(rows)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = (ends - sizes)[owner] + nth * LANE_ROWS
    first = np.cumsum(parts) - parts
    for shift in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, starts)
        for lane in range(4):
            held = np.add.reduceat(((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64), first)
            out[rows] |= (2 * held > sizes).astype(np.uint64) << np.uint64(16 * lane + shift)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row (doc_id, digest, bits) for each document; ``digest`` is the text's MD5, NULL for a missing text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.col(text).cast("binary")).alias("digest"),
                       F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = binaries(batch.column(2))
            found = []
            for begin, end in slices(np.array([len(t) for t in texts]), 1 << 22):
                hashes = [shingle_hashes(t, shingle) for t in texts[begin:end]]
                found.append(majority(np.concatenate(hashes), np.array([len(h) for h in hashes])))
            bits = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bits, pa.int64())], ["doc_id", "digest", "bits"])

    return rows.mapInArrow(describe, f"doc_id {kind}, digest string, bits long")


def bucket_keys(bits: Column, radius: int) -> Column:
    """Keys of which fingerprints within ``radius`` share at least one: two of ``radius`` + 2 groups of bits.

    At most ``radius`` of the groups can hold a differing bit, so two agree.  The number of the choice stands above
    the bits, so keys of different choices never meet.
    """
    groups = radius + 2
    edges = [BITS * i // groups for i in range(groups + 1)]
    part = [F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in itertools.pairwise(edges)]
    width = [b - a for a, b in itertools.pairwise(edges)]
    return F.array(*(
        F.shiftleft(F.lit(n).cast("long"), width[i] + width[j])
        .bitwiseOR(F.shiftleft(part[i], width[j])).bitwiseOR(part[j])
        for n, (i, j) in enumerate(itertools.combinations(range(groups), 2))
    ))


class Linker:
    """Bit-sliced comparison: bit planes stand upright, 64 distances are counted by one machine word.

    The planes of the candidates are words of 64 fingerprints.  A query's distance to all 64 is kept in vertical
    counters, to which each plane is added by half adders.  The counters start so that they overflow just beyond the
    radius; what has overflowed stays so, and a word whose 64 distances all have is abandoned.
    """

    def __init__(self, radius: int):
        self.radius = radius
        self.counters = max(1, radius.bit_length())
        self.start = (1 << self.counters) - 1 - radius

    def links(self, groups: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked fingerprints (two equally long arrays) of (queries, candidates) groups, some at a time."""
        queries = np.concatenate([q for q, _ in groups])
        padded = [np.concatenate([c, np.zeros(-len(c) % 64, np.uint64)]) for _, c in groups]
        candidates = np.concatenate(padded)
        valid = np.concatenate([np.arange(len(p)) < len(c) for p, (_, c) in zip(padded, groups)])
        valid = np.packbits(valid.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
        common = np.bitwise_and.reduce(np.concatenate([queries, *(c for _, c in groups)]))
        anywhere = np.bitwise_or.reduce(np.concatenate([queries, *(c for _, c in groups)]))
        varying = [b for b in range(BITS) if int(common ^ anywhere) >> b & 1]
        planes = [
            np.packbits(((candidates >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).reshape(-1, 64), axis=1,
                        bitorder="little").view(np.uint64).ravel() for b in varying
        ]
        masks = [(np.uint64(0) - ((queries >> np.uint64(b)) & np.uint64(1))) for b in varying]
        first_query = np.cumsum([0, *(len(q) for q, _ in groups)])
        first_word = np.cumsum([0, *(len(p) // 64 for p in padded)])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for g in range(len(groups)):
            words = np.arange(first_word[g], first_word[g + 1])
            step = max(1, PAIRS // max(1, len(words)))
            for at in range(first_query[g], first_query[g + 1], step):
                rows = np.arange(at, min(at + step, first_query[g + 1]))
                held.append((np.repeat(rows, len(words)), np.tile(words, len(rows))))
                size += len(rows) * len(words)
                if size >= PAIRS:
                    yield from self._compare(held, planes, masks, valid, queries, candidates)
                    held, size = [], 0
        if size:
            yield from self._compare(held, planes, masks, valid, queries, candidates)

    def _compare(self, held, planes, masks, valid, queries, candidates) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        query, word = (np.concatenate(x) for x in zip(*held))
        counters = [np.full(len(query), FULL if self.start >> i & 1 else 0, np.uint64) for i in range(self.counters)]
        over = ~valid[word]
        for n, (plane, mask) in enumerate(zip(planes, masks)):
            carry = plane[word] ^ mask[query]
            for i in range(self.counters):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            over |= carry
            if n % 8 == 7:
                alive = np.flatnonzero(over != FULL)
                if len(alive) < 0.8 * len(over):
                    query, word, over = query[alive], word[alive], over[alive]
                    counters = [c[alive] for c in counters]
                    if not len(alive):
                        return
        rows = np.flatnonzero(over != FULL)
        hits = np.unpackbits((~over[rows]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pair, lane = np.nonzero(hits)
        yield queries[query[rows[pair]]], candidates[word[rows[pair]] * 64 + lane]


def stars(a: np.ndarray, b: np.ndarray, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reachable) of the nodes linked by the rows of ``a`` and ``b``."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, label[left], low)
        np.minimum.at(after, label[right], low)
        after = after[after]
        if (after == label).all():
            return nodes, nodes[label]
        label = after


def near_links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column ``bits``) within ``radius`` of each other.

    Of the links inside a task's groups a spanning star is returned for each connected part, so the result is at most
    as long as the groups.  A bucket of more than ``block`` fingerprints is cut into blocks by a hash; each pair of
    its blocks is a task of its own.
    """
    keyed = nodes.select("bits", F.explode(bucket_keys(F.col("bits"), radius)).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int")
    members = (
        keyed.join(crowded, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "bits")
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker = Linker(radius)
        for groups in _gathered(batches):
            left, right = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            for a, b in linker.links(groups):  # what is known so far stays a star, however many links there are
                apart = a != b
                left, right = stars(np.concatenate([left, a[apart]]), np.concatenate([right, b[apart]]))
            apart = left != right
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[apart].view(np.int64), pa.int64()) for x in (left, right)], ["a", "b"])

    return (
        members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        .mapInArrow(link, "a long, b long").distinct()
    )


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """(queries, candidates) groups of the sorted rows (key, i, j, own, bits), some thousand rows at a time."""
    rest: list[np.ndarray] = [np.zeros((0, 5), np.int64)]
    for batch in batches:
        rest.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]))
        if sum(map(len, rest)) < 4 * BLOCK:
            continue
        rows = np.concatenate(rest)
        last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))  # rows before the group still arriving
        end = int(last[-1]) + 1 if len(last) else 0
        if end:
            yield _groups(rows[:end])
        rest = [rows[end:]]
    rows = np.concatenate(rest)
    if len(rows):
        yield _groups(rows)


def _groups(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]))
    groups = []
    for begin, end in itertools.pairwise([*starts.tolist(), len(rows)]):
        part = rows[begin:end]
        bits = part[:, 4].astype(np.int64).view(np.uint64)
        groups.append((bits, bits) if part[0, 1] == part[0, 2] else (bits[part[:, 3] == part[0, 1]], bits[part[:, 3] == part[0, 2]]))
    return groups


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                   radius: int = RADIUS) -> DataFrame:
    """One row (doc_id, digest, fingerprint, component_id, root) for each document.

    Words are runs of other than ASCII white space with A-Z lower-cased; the fingerprint has a bit where over half of
    the hashes of all runs of ``shingle`` words have it.  A text of fewer words is one run; a missing text or one
    without words has fingerprint 0 and is linked like any other.  Documents are linked when their fingerprints
    differ in at most ``radius`` bits; ``component_id`` is the smallest id reachable, the document's own included,
    and NULL only where no document reachable has an id.  ``root`` names the component by one of its fingerprints,
    ``digest`` is the text's MD5, NULL for a missing text.

    Equal fingerprints are compared once, however many documents have them.  Repeated rows come back as often as
    given; other columns are not looked at.  Texts are read once: ids and fingerprints go to the shared folder.
    """
    prints = stored(fingerprints(docs, doc_id, text, shingle), "simhash")
    nodes = prints.groupBy("bits").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(nodes.select("bits"), radius))
    rooted = nodes.join(roots, nodes["bits"] == roots["node"], "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.join(groups, "root").select("bits", "component_id", "root")
    return prints.join(members, "bits").select(
        "doc_id", "digest", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """The documents, with all their columns, reduced to one of each component.

    The document with the smallest id stays; ids that are NULL come last, ties go by the text's digest.  Of rows equal
    in id and text one stays.  The chosen ids and digests are joined to the documents, so texts are shuffled once.
    """
    chosen = (
        simhash_groups(docs, doc_id, text, shingle, radius).groupBy("root", "doc_id", "digest")
        .agg(F.count("*").alias("copies")).groupBy("root")
        .agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", F.isnull("digest").alias("untold"), "digest",
                            "copies")).alias("first"))
        .select(F.col("first.doc_id").alias("chosen id"), F.col("first.digest").alias("chosen digest"),
                F.col("first.copies").alias("chosen copies"))
    )
    chosen = stored(chosen, "simhash-chosen")
    kept = docs.withColumn("own digest", F.md5(F.col(text).cast("binary"))).join(
        chosen, F.col(doc_id).eqNullSafe(F.col("chosen id")) & F.col("own digest").eqNullSafe(F.col("chosen digest")))
    once = kept.where(F.col("chosen copies") == 1).select(*docs.columns)
    return once.union(kept.where(F.col("chosen copies") > 1).dropDuplicates([doc_id, "own digest"]).select(*docs.columns))
