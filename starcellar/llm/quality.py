"""Quality by Bradley-Terry ranking: document scores learnt from preference pairs, cut at a score quantile."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcellar.llm.logistic import newton, sigmoid
from starcellar.llm.tables import crc_remainder, portions, stored

BLOCK_ROWS = 20_000  # labelled documents that meet each other; all blocks of them are learnt from
LEAST = 64  # documents of the rarer class in a block, by copies if there are too few
CHUNK = 8_192  # pairs of a block looked at together
PAIRS = 5  # rivals of each preferred document
THRESHOLD = 0.7  # score at the quantile that parts good from poor
SIGNS = "$%&*#@|!?.,;:"

FEATURES = (
    "words", "word length", "letters only", "upper case", "title case", "distinct words", "repeated neighbours",
    "commonest word", "distinct lines", "words a line", "digits", *(f"sign {c}" for c in SIGNS),
)


def features(text: str) -> list[float]:
    """Shares and logarithms, so that no feature grows with the text but the logarithm of its length."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, counts = len(words), Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        math.log1p(n),
        sum(map(len, words)) / n / 10,
        sum(map(str.isalpha, words)) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        math.log(len(counts)) / math.log(n) if n > 1 else 1.0,
        sum(map(eq, words, words[1:])) / n,
        max(counts.values()) / n,
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        sum(map(text.count, "0123456789")) / n,
        *(min(1.0, text.count(c) / n) for c in SIGNS),
    ]


def expanded(rows: np.ndarray) -> np.ndarray:
    """Features with their squares, so that too much of something can count as well as too little."""
    return np.hstack([rows, rows**2])


@dataclass(frozen=True)
class Ranking:
    """``weights`` of the scaled features; ``steep`` and ``middle`` bring a rank score to 0..1."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    middle: float
    steep: float

    def rank(self, rows: np.ndarray) -> np.ndarray:
        """A row is summed by itself in a fixed order, so that its score does not depend on the rows beside it."""
        terms = (expanded(rows) - np.array(self.mean)) / np.array(self.scale) * np.array(self.weights)
        return np.fromiter(map(math.fsum, terms), dtype=float, count=len(terms))

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = self.steep * (self.rank(rows) - self.middle) + math.log(THRESHOLD / (1 - THRESHOLD))
        return np.fromiter((1 / (1 + math.exp(-min(max(x, -500.0), 500.0))) for x in z), dtype=float, count=len(z))


@dataclass(frozen=True)
class Block:
    """Labelled documents that meet each other, in a fixed order; ``own`` ones are not copies of another block's."""

    rows: np.ndarray
    good: np.ndarray
    own: np.ndarray
    number: int = 0

    def pairs(self, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of (better, worse); each document meets ``pairs`` rivals of the other class, drawn with a fixed seed."""
        better, worse = np.flatnonzero(self.good == 1), np.flatnonzero(self.good == 0)
        if not len(better) or not len(worse):
            return better[:0], worse[:0]
        draw = np.random.default_rng([seed, self.number] if self.number else seed)
        size = pairs * max(len(better), len(worse))
        left = np.resize(draw.permutation(better), size)
        right = np.resize(draw.permutation(worse), size)
        return left, right[draw.permutation(size)]


# Adds up what a function makes of each block, exactly, so that no sum depends on how blocks are dealt to tasks.
Total = Callable[[Callable[[Block], np.ndarray]], np.ndarray]
EXACT = 60  # binary digits after the point of numbers that are added up


def exact(values: np.ndarray) -> list[int]:
    return [int(x) for x in np.rint(np.ldexp(values, EXACT)).tolist()]


def inexact(sums: list[int]) -> np.ndarray:
    return np.array([x / (1 << EXACT) for x in sums])


def added(left: list[int], right: list[int]) -> list[int]:
    return [a + b for a, b in zip(left, right, strict=True)] if left else right


def learn(rows: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 7) -> Ranking:
    """The ranking of one block of documents."""
    block = Block(rows, good, np.ones(len(rows), dtype=bool))
    return learn_blocks(lambda f: inexact(exact(f(block))) if len(rows) else np.zeros(0), pairs, ridge, seed)


def learn_blocks(total: Total, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 7) -> Ranking:
    """Weights by logistic loss on feature differences of (better, worse) pairs; the cut by the quantile of scores.

    The middle of the scores at the share of poor documents is where ``THRESHOLD`` lies.  With documents of one class
    only, no pair exists: every weight is 0, and all documents get the class they were seen in.  Everything taken from
    the documents are sums over blocks, so no more than a block is looked at in one place.
    """
    size = 2 * len(FEATURES)
    found = total(lambda b: np.array([b.own.sum(), (b.own & (b.good == 0)).sum(), *expanded(b.rows)[b.own].sum(axis=0)]))
    n, poor = (int(found[0]), int(found[1])) if len(found) else (0, 0)
    mean = found[2:] / n if n else np.zeros(size)
    spread = total(lambda b: ((expanded(b.rows)[b.own] - mean) ** 2).sum(axis=0)) / n if n else np.zeros(size)
    scale = np.maximum(np.sqrt(spread), 1e-6)
    if poor in (0, n):
        return Ranking(tuple(mean), tuple(scale), (0.0,) * size, 0.5 if poor else -0.5, 1.0)
    upper = np.triu_indices(size)

    def slopes(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def of(b: Block) -> np.ndarray:
            wide, (left, right) = expanded(b.rows) / scale, b.pairs(pairs, seed)
            gradient, hessian = np.zeros(size), np.zeros((size, size))
            for begin in range(0, len(left), CHUNK):
                difference = wide[left[begin:begin + CHUNK]] - wide[right[begin:begin + CHUNK]]
                p = sigmoid(difference @ beta)
                gradient += difference.T @ (1 - p)
                hessian += (difference * (p * (1 - p))[:, None]).T @ difference
            return np.concatenate([gradient, hessian[upper]])

        sums = 2 * total(of)  # each pair counts from both sides, which are alike
        hessian = np.zeros((size, size))
        hessian[upper] = sums[size:]
        return sums[:size], hessian + np.triu(hessian, 1).T

    weights = newton(slopes, size, ridge)
    ranks = lambda b: ((expanded(b.rows[b.own]) - mean) / scale) @ weights
    middle = (smallest(total, ranks, poor - 1) + smallest(total, ranks, poor)) / 2

    def steepness(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def of(b: Block) -> np.ndarray:
            x, y = ranks(b) - middle, b.good[b.own]
            p = sigmoid(x * beta[0])
            return np.array([x @ (y - p), (x * x) @ (p * (1 - p))])

        sums = total(of)
        return sums[:1], sums[1:, None]

    steep = newton(steepness, 1, 1.0)[0]
    return Ranking(tuple(mean), tuple(scale), tuple(weights), float(middle), float(max(steep, 1e-3)))


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = (np.asarray(values, dtype=float) + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-1 << 63)).view(np.uint64)


def smallest(total: Total, values: Callable[[Block], np.ndarray], place: int) -> float:
    """The value at a place of all in order: its digits one after the other, by how many values go on with each."""
    known = 0
    for shift in (52, 40, 28, 16, 4, 0):
        width = 12 if shift else 4

        def counts(b: Block, shift: int = shift, width: int = width, known: int = known) -> np.ndarray:
            number = ordered(values(b))
            if shift + width < 64:
                number = number[number >> np.uint64(shift + width) == np.uint64(known)]
            digits = (number >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            return np.bincount(digits.astype(np.int64), minlength=1 << width).astype(float)

        upto = np.cumsum(total(counts))
        digit = int(np.searchsorted(upto, place, side="right"))
        place -= int(upto[digit - 1]) if digit else 0
        known = known << width | digit
    bits = np.array([known], dtype=np.uint64).view(np.int64)
    return float(np.where(bits < 0, bits ^ np.int64(-1 << 63), ~bits).view(float)[0])


def blocks_of(examples: DataFrame, block_rows: int = BLOCK_ROWS) -> Total | None:
    """Rows (sample_id, label, features) dealt to stored blocks of about ``block_rows`` by the hash of the id, or None
    without rows.

    Where a class is so rare that blocks could be without it, its documents are copied to several, and counted in one.
    """
    sizes = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    if not sizes:
        return None
    blocks = -(-sum(sizes.values()) // block_rows)
    copies = {label: min(blocks, max(1, -(-LEAST * blocks // size))) if blocks > 1 else 1 for label, size in sizes.items()}
    first = F.pmod(F.xxhash64("sample_id"), F.lit(blocks))
    wanted = F.coalesce(*(F.when(F.col("label") == label, F.lit(c)) for label, c in copies.items()))
    dealt = examples.withColumn("copy", F.explode(F.sequence(F.lit(0), wanted - 1)))
    dealt = dealt.withColumn("block", F.pmod(first + F.col("copy"), F.lit(blocks)))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        features = np.array(rows["features"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
        good, own = rows["label"].to_numpy().astype(np.int8), rows["copy"].to_numpy() == 0
        order = np.lexsort((*features.T, good, own))
        arrays = [np.ascontiguousarray(x[order]).tobytes() for x in (features, good, own.astype(np.int8))]
        return pa.table({"block": [key[0].as_py()], **dict(zip(("features", "good", "own"), ([a] for a in arrays), strict=True))})

    kept = stored(dealt.select("block", F.col("label").cast("int").alias("label"), "copy", "features").groupBy("block")
                  .applyInArrow(packed, "block long, features binary, good binary, own binary"), "blocks")

    def total(f: Callable[[Block], np.ndarray]) -> np.ndarray:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: list[int] = []
            for batch in batches:
                for row in range(batch.num_rows):
                    number, features, good, own = (batch.column(c)[row].as_py() for c in range(4))
                    rows = np.frombuffer(features).reshape(-1, len(FEATURES))
                    flags = [np.frombuffer(x, dtype=np.int8) for x in (good, own)]
                    sums = added(sums, exact(f(Block(rows, flags[0].astype(int), flags[1] == 1, number))))
            yield pa.RecordBatch.from_pydict({"sums": pa.array([[str(x) for x in sums]], pa.list_(pa.string()))})

        sums: list[int] = []
        for r in kept.mapInArrow(summed, "sums array<string>").collect():
            sums = added(sums, [int(x) for x in r["sums"]]) if r["sums"] else sums
        return inexact(sums)

    return total


def _featured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, digest, features): the digest tells apart several texts of one id."""
    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(F.coalesce(body, F.lit("")).cast("binary"), 256)).alias("digest"),
                       body.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = [features(body or "") for body in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "digest", "features"])

    return rows.mapInArrow(describe, f"doc_id {kind}, digest binary, features array<double>")


def _scored(featured: DataFrame, ranking: Ranking) -> DataFrame:
    rows = featured.select("doc_id", "features")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = np.array(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ranking.score(found), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, block_rows: int = BLOCK_ROWS,
            doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for all documents.

    Labels of rows whose crc32 of the id modulo ``folds`` is ``held_out`` are never learnt from, all others are.  An id
    labelled more than once counts with its smallest label, one with several texts with the text of the smallest digest.
    Documents are described once and stored; labelled ones meet in blocks of about ``block_rows``, and only sums over
    the blocks come to the driver.  ``predicted`` is 1 from a score of 0.7, where the quantile of the scores lies.

    Missing and empty texts and texts without words have features of 0 and a score like any other.  Repeated rows
    are scored each; other columns are not looked at.  With labels of one kind all documents are predicted that kind;
    without labels, all are predicted 1.
    """
    featured = stored(_featured(docs, doc_id, text), "features")
    known = labels.select(F.col(doc_id).alias("sample_id"), F.col(label).alias("label")).where(
        F.col("sample_id").isNotNull() & F.col("label").isin(0, 1) & (crc_remainder(F.col("sample_id"), folds) != held_out))
    known = known.groupBy("sample_id").agg(F.min("label").alias("label"))
    first = F.min(F.struct("digest", "features")).alias("first")
    examples = featured.join(known, F.col("doc_id") == F.col("sample_id")).groupBy("sample_id", "label").agg(first)
    examples = stored(examples.select("sample_id", "label", "first.features"), "examples")
    total = blocks_of(examples, block_rows)
    ranking = learn_blocks(total or (lambda f: np.zeros(0)))
    return _scored(featured, ranking).select(
        "doc_id", (crc_remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_quality(docs: DataFrame, ranking: Ranking, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, score) for each document."""
    return _scored(_featured(docs, doc_id, text), ranking)
