"""Product codes of vectors by ball k-means: balls and their neighbours leave each part few entries to be compared with."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcellar.llm.tables import portions, stored

PARTS = 4  # stretches that a vector is cut into
ENTRIES = 256  # of each part's codebook
ROUNDS = 4  # times that entries move
SCALE = 1024
REACH = 1 << 26  # whole components beyond this are cut to it, so that squared distances fit a long
TOGETHER = 256  # parts of one ball compared at a time
FLOATS = 1 << 53  # whole numbers below this are exact in a float


def whole_components(vector: Column) -> Column:
    """floor(SCALE * x) of each component, computed in doubles."""
    return F.transform(vector, lambda x: F.least(F.greatest(
        F.floor(x.cast("double") * F.lit(float(SCALE))), F.lit(-REACH)), F.lit(REACH)).cast("int"))


def usable(vector: Column) -> Column:
    """Whether the vector and its components are there and finite."""
    x = F.transform(vector, lambda c: c.cast("double"))
    return vector.isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


class Balls:
    """The entries of one part as balls: to each entry the others by rising distance, and which have moved."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None):
        self.entries = entries
        gaps = squares(entries, entries)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        self.moved = np.ones(len(entries), bool) if before is None else (entries != before).any(axis=1)

    def assign(self, parts: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, ties to the lower one, and its squared distance; ``home`` is where it was.

        An entry further than twice the part's distance d from its home entry cannot be nearer than d.  So a ball's
        neighbours are the entries within twice its radius; parts within half the gap to the nearest of them, the
        stable core, stay; and a part in a ring between two half gaps is compared with the neighbours up to its ring.
        A ball that has not moved, nor any of its neighbours, keeps its parts.
        """
        code, own = home.copy(), ((parts - self.entries[home]) ** 2).sum(axis=1)
        members = np.argsort(home, kind="stable")
        bounds = np.searchsorted(home[members], np.arange(len(self.entries) + 1))
        for ball in np.flatnonzero(np.diff(bounds)).tolist():
            inside = members[bounds[ball]:bounds[ball + 1]]
            ring = np.searchsorted(self.gaps[ball], 4 * own[inside], "right")
            if not self.moved[self.order[ball, :max(int(ring.max()), 1)]].any() and not self.moved[ball]:
                continue
            shell = ring > 1  # the ball's own entry, at gap 0, is the first
            inside, ring = inside[shell], ring[shell]
            by_ring = np.argsort(ring, kind="stable")
            inside, ring = inside[by_ring], ring[by_ring]
            for begin in range(0, len(inside), TOGETHER):
                some = inside[begin:begin + TOGETHER]
                rivals = np.sort(self.order[ball, :ring[begin:begin + TOGETHER][-1]])
                far = squares(parts[some], self.entries[rivals])
                best = far.argmin(axis=1)
                code[some], own[some] = rivals[best], far[np.arange(len(some)), best]
        return code, own


def squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors, by floats where all sums stay exact in them."""
    top = max(int(np.abs(left).max(initial=0)), int(np.abs(right).max(initial=0)))
    if 4 * top * top * max(left.shape[1], 1) < FLOATS:
        a, b = left.astype(np.float64), right.astype(np.float64)
        return ((a**2).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b**2).sum(axis=1)).astype(np.int64)
    return np.stack([((left - entry) ** 2).sum(axis=1) for entry in right], axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` components, shorter ones continued by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    rows = np.zeros((len(sizes), width), np.int64)
    rows[np.arange(width) < sizes[:, None]] = flat
    return rows


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                 vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row (vec_id, code, error, label_error, codebooks_sha256) for each usable vector.

    A vector is cut into ``parts`` equal stretches of whole numbers, each coded by its nearest codebook entry.  The
    first entries are the parts of the vectors with the smallest ids; ``rounds`` times all parts are assigned and
    entries move to the floor of their parts' mean, entries without parts stay; then all are assigned again.  Distances
    are exact, ties go to the lower entry.  ``error`` is the sum of the squared distances to the final entries,
    ``label_error`` the sum of it over equal labels.

    Vectors that are missing, or hold a missing or infinite component or NaN, are left out.  Shorter vectors count as
    continued by zeros, up to the longest and to a length that the parts divide.  Components beyond 2**26 after scaling
    are cut to that.  Repeated rows take part each; equal ids are ordered by their vectors, a missing id comes last.
    With fewer vectors than ``entries`` the codebooks are as short.  Other columns are not looked at; an empty table
    gives an empty result.

    The assignment of each round is written with the vectors and read by the next, so a round continues from the balls
    of the one before; a lost task repeats its own files.  A task returns sums by entry, and the driver holds the
    codebooks alone, ``entries`` vectors.
    """
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(usable(F.col("vector")))
    state = stored(rows.select(
        "vec_id", "label", whole_components(F.col("vector")).alias("vector"),
        F.array_repeat(F.lit(0), parts).alias("code"), F.lit(0).cast("long").alias("error")), "vectors")
    width = state.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-width // parts) * parts
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    books = np.zeros((parts, len(first), width // parts), np.int64)
    for n, row in enumerate(first):
        whole = np.zeros(width, np.int64)
        whole[:len(row["vector"])] = row["vector"]
        books[:, n] = whole.reshape(parts, -1)
    if not len(first):
        return state.select("vec_id", F.lit("").alias("code"), "error", F.col("error").alias("label_error"),
                            F.lit("").alias("codebooks_sha256"))
    before = None
    for _ in range(rounds):
        state = stored(assigned(state, books, before), "vector-codes")
        before, books = books, moved(state, books)
    final = stored(assigned(state, books, before).select("vec_id", "label", "code", "error"), "vector-codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = final.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    return final.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def assigned(state: DataFrame, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The rows with each part's nearest entry and the distances, from the balls that the rows' codes name."""
    parts, _, width = books.shape

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(book, None if before is None else before[n]) for n, book in enumerate(books)]
        for batch in portions(batches):
            whole, home = _matrix(batch.column(2), parts * width), _codes(batch.column(3), parts)
            error = np.zeros(len(whole), np.int64)
            for n, part in enumerate(np.split(whole, parts, axis=1)):
                home[:, n], own = balls[n].assign(part, home[:, n])
                error += own
            offsets = pa.array(np.arange(len(home) + 1) * parts, pa.int32())
            code = pa.ListArray.from_arrays(offsets, pa.array(home.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], code, pa.array(error)], batch.schema.names)

    return state.mapInArrow(nearest, state.schema)


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with each entry at the floor of the mean of its parts; entries without parts stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((parts, entries, width + 1), np.int64)  # components, then the number of parts
        for batch in portions(batches):
            whole, code = _matrix(batch.column(0), parts * width), _codes(batch.column(1), parts)
            for n, part in enumerate(np.split(whole, parts, axis=1)):
                np.add.at(held[n], code[:, n], np.hstack([part, np.ones((len(part), 1), np.int64)]))
        place = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(held.ravel()[place])], ["place", "held"])

    rows = state.select("vector", "code").mapInArrow(sums, "place long, held long").groupBy("place").agg(F.sum("held").alias("held"))
    held = np.zeros(parts * entries * (width + 1), np.int64)
    for row in rows.collect():
        held[row["place"]] = row["held"]
    held = held.reshape(parts, entries, width + 1)
    count = held[:, :, -1:]
    return np.where(count > 0, held[:, :, :-1] // np.maximum(count, 1), books)
