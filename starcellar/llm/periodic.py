"""Periodic runs of words: candidates on harmonic grids, extended exactly by queries to a recompression grammar."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcellar.llm.recompression import Grammar
from starcellar.llm.tables import binaries, portions, slices

EXPONENT = 4  # periods that a run holds at least
LENGTH = 6  # words that a run holds at least
GRID = 1 << 19  # grid points looked at together
ROUNDS = 8  # times that only the first hit left of a chain is extended
QUERIES = 1 << 16  # extensions asked for together
RUNS = "array<struct<start:long,length:long,period:long>>"


def candidates(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, period, position): words a period apart are equal at four points of the period's grid.

    The grid of period q lies on every q-th word of a text, so all grids together have about n log n points.  A run of
    four periods covers four neighbouring points of its grid, which hold the same word; some words between the first
    two points must repeat as well.
    """
    periods = sizes // EXPONENT
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (sizes[text] - 1) // period - EXPONENT + 2
    found = []
    for begin, end in slices(points, GRID):
        held = np.repeat(np.arange(begin, end), points[begin:end])
        before = np.cumsum(points[begin:end]) - points[begin:end]
        at = np.arange(len(held)) - before[held - begin]
        q = period[held]
        place = starts[text[held]] + at * q
        for n in range(1, EXPONENT):
            hit = words[place] == words[place + n * q]
            held, q, place = held[hit], q[hit], place[hit]
        for n in range(8):
            between = place + np.maximum(n * q // 8, 1)
            hit = words[between] == words[between + q]
            held, q, place = held[hit], q[hit], place[hit]
        found.append(np.column_stack([text[held], q, place]))
    return np.concatenate([*found, np.zeros((0, 3), np.int64)])


def extended(sequence: np.ndarray, period: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the longest stretches with these periods around these positions.

    ``place`` rises within a period and text.  A stretch covers all hits of its period in it, so at first one hit of
    each chain is extended and those it covers are passed over; what is left after some rounds is extended hit by hit.
    """
    ahead, behind = Grammar(sequence), Grammar(sequence[::-1])
    found, n = [], 0
    while len(place):
        first = np.ones(len(place), bool)
        if n < ROUNDS:
            first[1:] = (period[1:] != period[:-1]) | (place[1:] != place[:-1] + period[1:])
        chain, end = np.cumsum(first) - 1, np.zeros(0, np.int64)
        for begin in range(0, int(first.sum()), QUERIES):
            q, x = period[first][begin:begin + QUERIES], place[first][begin:begin + QUERIES]
            start = x - behind.common(len(sequence) - x, len(sequence) - x - q)
            reach = x + ahead.common(x, x + q)
            found.append(np.column_stack([start, reach + q - start, q]))
            end = np.append(end, reach)
        left = ~first & (place >= end[chain])
        period, place, n = period[left], place[left], n + 1
    return np.concatenate([*found, np.zeros((0, 3), np.int64)])


def runs_of(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) by text, start and period; ``words`` are the numbered words of all texts.

    Only texts with a candidate enter the grammar.  Words that occur once part them and end them on both sides, so no
    extension leaves its text.
    """
    starts = np.cumsum(sizes) - sizes
    seeds = candidates(words, starts, sizes)
    if not len(seeds):
        return np.zeros((0, 4), np.int64)
    kept, text = np.unique(seeds[:, 0], return_inverse=True)
    begins = np.cumsum(sizes[kept] + 1) - sizes[kept]  # of the kept texts, each behind a word of its own
    sequence = np.arange(begins[-1] + sizes[kept[-1]] + 1) + (int(words.max()) + 1)
    for n, begin in zip(kept.tolist(), begins.tolist()):
        sequence[begin:begin + sizes[n]] = words[starts[n]:starts[n] + sizes[n]]
    rows = extended(sequence, seeds[:, 1], seeds[:, 2] - starts[seeds[:, 0]] + begins[text])
    rows = rows[rows[:, 1] >= np.maximum(LENGTH, EXPONENT * rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a stretch found for several periods has the smallest as its own, which divides the others
    own = np.ones(len(rows), bool)
    own[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[own]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    at = np.searchsorted(begins, rows[:, 0], "right") - 1
    return np.column_stack([kept[at], rows[:, 0] - begins[at], rows[:, 1:]])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, runs, collapsed) for each document.

    Words are maximal stretches without white space (blank, tab to carriage return), numbered from 0.  ``runs`` holds
    (start, length, period) of every maximal stretch of words with smallest period q that holds at least four periods
    and six words, by start, then period.  ``collapsed`` is the text of the words that no run holds behind its first
    period, joined by one blank.

    A missing, empty or blank text has no runs and collapses to an empty text.  Repeated rows are looked at each, other
    columns are not looked at; an empty table gives an empty result.  Texts are not shuffled: a task names the words
    of about 2 MB of texts, or of one longer text, and finds the runs of all of them together.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = [body.split() for body in binaries(batch.column(1))]  # bytes split at ASCII white space alone
            number = defaultdict(itertools.count().__next__)
            words = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(texts)), dtype=np.int64)
            runs = runs_of(words, np.fromiter(map(len, texts), np.int64, len(texts)))
            offsets = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
            collapsed = [
                b" ".join(body if a == b else _collapsed(body, runs[a:b]))
                for body, a, b in zip(texts, offsets.tolist(), offsets[1:].tolist())
            ]
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(runs[:, n]) for n in (1, 2, 3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), found, pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(find, f"doc_id {kind}, runs {RUNS}, collapsed string")


def _collapsed(words: list[bytes], runs: np.ndarray) -> Iterator[bytes]:
    """The words that no run holds behind its first period."""
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, runs[:, 1] + runs[:, 3], 1)
    np.add.at(covered, runs[:, 1] + runs[:, 2], -1)
    return itertools.compress(words, (np.cumsum(covered[:-1]) == 0).tolist())


def best_run(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: the first by start, then period."""
    return F.reduce(
        runs, F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda best, run: F.when(
            best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best))


def run_text(runs: Column) -> Column:
    """``start,length,period`` of every run, each on a line of its own."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        *(part for name in ("start", "length") for part in (r[name].cast("string"), F.lit(","))),
        r["period"].cast("string"), F.lit("\n"))), "")


def stretched(docs: DataFrame, share: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text) in which one document of ``share`` repeats a stretch of its words up to its end.

    With h = crc32 of the decimal id, g = h / share and n words: where h is divisible by ``share``, words from
    a = g % n on repeat with period 1 + (n - a) / (3 + g % 8), all divisions whole.  Rows without id, and without
    words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    picked = rows.withColumn("g", F.when(h % share == 0, F.floor(h / share).cast("long")))
    cut = picked.withColumn("words", F.when(
        F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n = F.size("words")
    begun = cut.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    period = begun.withColumn("p", (F.lit(1) + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    repeated = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.col("words")[a + (i - a) % p]))
    return period.select(
        "doc_id", F.when(a.isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
