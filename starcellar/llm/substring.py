"""Repeated passages by greedy factors of documents, relative to what an index of all reference blocks knows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from starcellar.llm.tables import slices

WINDOW = 13  # words
ANCHOR = 4  # words of an anchor
BLOCK_BYTES = 8 << 20  # text of a reference block
BLOCKS_A_PARTITION = 4
PARTITIONS = 20_000  # at most; beyond, a partition has more blocks, which are still read one by one
CROWD = 16  # stretches of one anchor that a block tells the index of; with more it checks all its windows itself
SLICE = 4 << 20  # bytes of text whose words are hashed at once
PIECE = 1 << 20  # bytes whose powers are held
PLACES = 1 << 20  # places in references that are extended at once
ASKERS = 65536  # blocks that one row of a lent document names
NONE = np.iinfo(np.int64).max

STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_STEP = np.uint64(0xD6E8FEB86659FD93)
BYTE_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, step, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on, as far as there are so many."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        out = out * STEP + hashes[i:i + size]
    return mix(out)


def sums_of(hashes: np.ndarray) -> np.ndarray:
    """Sums of the first words' hashes, the n-th word weighing ``STEP`` to the n."""
    return np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers(STEP, len(hashes)), dtype=np.uint64)])


class Words:
    """Word hashes of some documents: ``hashes`` and each word's ``owner`` (row number)."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        space = (data == 32) | ((data >= 9) & (data <= 13))
        cut = np.zeros(len(data) + 1, dtype=bool)  # a document's end also ends its last word
        cut[ends] = True
        before = np.concatenate([[True], space[:-1]]) if len(data) else np.zeros(0, bool)
        after = np.concatenate([space[1:], [True]]) if len(data) else np.zeros(0, bool)
        starts = np.flatnonzero(~space & (before | cut[:-1]))
        stops = np.flatnonzero(~space & (after | cut[1:])) + 1
        self.owner = np.searchsorted(ends, starts, side="right").astype(np.int64)
        self.hashes = np.empty(len(starts), dtype=np.uint64)
        first = 0
        while first < len(starts):  # pieces that begin and end with a word
            last = max(first + 1, int(np.searchsorted(stops, starts[first] + PIECE, side="right")))
            a, b = starts[first:last] - starts[first], stops[first:last] - starts[first]
            part = data[starts[first]:stops[last - 1]].astype(np.uint64) + np.uint64(1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(part * self._table(BYTE_STEP, len(part)), dtype=np.uint64)])
            value = (sums[b] - sums[a]) * self._table(BYTE_INVERSE, len(part))[a]
            self.hashes[first:last] = mix(value + (b - a).astype(np.uint64) * STEP)
            first = last

    _tables: dict[int, np.ndarray] = {}

    @classmethod
    def _table(cls, step: np.uint64, n: int) -> np.ndarray:
        held = cls._tables.get(int(step))
        if held is None or len(held) < n:
            held = powers(step, max(n, PIECE))
            if n <= PIECE:
                cls._tables[int(step)] = held
        return held[:n]

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on, as far as there are so many."""
        return grams(self.hashes, n)


class Stretches:
    """Runs of windows that share an anchor, the words under them being one stretch of a document.

    A window's anchor is the run of ``ANCHOR`` words with the smallest hash inside it, the first such.  It depends on
    the window's own words alone, so equal windows of two documents have equal anchors at the same place in them.
    """

    def __init__(self, words: Words):
        h, owner = words.hashes, words.owner
        choices = WINDOW - ANCHOR + 1
        size = max(0, len(h) - WINDOW + 1)
        anchors = words.grams(ANCHOR)
        best, at = anchors[:size].copy(), np.zeros(size, dtype=np.int64)
        for i in range(1, choices):
            other = anchors[i:i + size]
            less = other < best
            best[less] = other[less]
            at[less] = i
        place = at + np.arange(size)
        inside = owner[:size] == owner[WINDOW - 1:] if size else np.zeros(0, bool)
        rows = np.flatnonzero(inside)
        place = place[rows]
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1] + 1)
        first = np.flatnonzero(fresh)
        self.begin = rows[first]  # first window
        self.end = self.begin + np.diff(np.concatenate([first, [len(rows)]]))  # beyond the last window
        self.owner = owner[self.begin]
        self.key = anchors[place[first]]
        last = self.end + WINDOW - 1
        sums = sums_of(h)
        value = (sums[last] - sums[self.begin]) * powers(STEP_INVERSE, len(h) + 1)[self.begin]
        shape = ((last - self.begin) * 64 + (place[first] - self.begin)).astype(np.uint64)
        self.extent = mix(value + shape * BYTE_STEP)

    def windows(self, rows: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Windows of the stretches numbered ``rows``: the stretch and the first word of each."""
        sizes = self.end[rows] - self.begin[rows]
        stretch = np.repeat(rows, sizes)
        nth = np.arange(len(stretch)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return stretch, self.begin[stretch] + nth


def marks(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One number for a pair, as a signed long."""
    return mix(key + value * STEP).view(np.int64)


def _combined(columns: list[np.ndarray], ids: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of ``columns`` with the smallest and the largest id of each."""
    order = np.lexsort((ids, *columns[::-1]))
    sorted_columns, ids = [c[order] for c in columns], ids[order]
    fresh = np.zeros(len(ids), dtype=bool)
    fresh[:1] = True
    for c in sorted_columns:
        fresh[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(ids)]])[:len(first)] - 1
    return [*(c[first] for c in sorted_columns), ids[first], ids[last]]


def _crowded(keys: np.ndarray, extents: np.ndarray) -> np.ndarray:
    """Keys with more than ``CROWD`` distinct stretches in the block."""
    key, _, _, _ = _combined([keys, extents], np.zeros(len(keys), np.int64))
    found, n = np.unique(key, return_counts=True)
    return found[n > CROWD]


def _read(block: pa.Table) -> Iterator[tuple[np.ndarray, Words, Stretches, list[bytes]]]:
    """Ids, words, stretches and texts of the block's documents, some at a time."""
    order = np.argsort(block["doc_id"].to_numpy(), kind="stable")  # one order, whatever way the rows came
    block = block.take(pa.array(order))
    ids = block["doc_id"].to_numpy()
    texts = block["text"].cast(pa.binary())
    for begin, end in slices(pc.binary_length(texts).to_numpy(), SLICE):
        part = texts.slice(begin, end - begin).to_pylist()
        words = Words(np.frombuffer(b"".join(part), np.uint8), np.cumsum([len(t) for t in part]))
        yield ids[begin:end], words, Stretches(words), part


def _table(**columns: np.ndarray) -> pa.Table:
    return pa.table({k: v.view(np.int64) if v.dtype == np.uint64 else v for k, v in columns.items()})


# A span is the smallest document's number, exclusive or the largest's: mostly zero, so it presses well.
INDEX = "key long, extent long, block int, least long, span long"
ASKED = "key long, window long, block int, least long, span long"


def _index(block: pa.Table) -> pa.Table:
    """The block's stretches, each with its smallest and largest document; of a crowded anchor the first few."""
    keys, extents, ids = [], [], []
    for doc, _, found, _ in _read(block):
        keys.append(found.key)
        extents.append(found.extent)
        ids.append(doc[found.owner])
    keys, extents, ids = (np.concatenate(x) for x in (keys, extents, ids))
    key, extent, least, most = _combined([keys, extents], ids)
    start = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
    nth = np.arange(len(key)) - np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
    told = nth < CROWD + 1
    return _table(key=key[told], extent=extent[told], block=np.full(told.sum(), block["block"][0].as_py(), np.int32),
                  least=least[told], span=(most ^ least)[told])


class Answers:
    """What the index said to a block: the smallest document of a stretch or window, by its mark."""

    def __init__(self, rows: pa.Table):
        mark = marks(*(rows[c].to_numpy().view(np.uint64) for c in ("key", "value")))
        least, ask = (rows[c].to_numpy() for c in ("least", "ask"))
        order = np.lexsort((least, mark))
        self.mark, self.least, self.ask = mark[order], least[order], ask[order]

    def of(self, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest document, or the largest number there is, and whether the windows are to be asked for."""
        if not len(self.mark):
            return np.full(len(mark), NONE), np.zeros(len(mark), dtype=bool)
        at = np.minimum(np.searchsorted(self.mark, mark), len(self.mark) - 1)
        hit = self.mark[at] == mark
        return np.where(hit, self.least[at], NONE), hit & self.ask[at]


def _ask(block: pa.Table, answers: pa.Table) -> pa.Table:
    """Windows of the stretches that are the first of their kind and share their anchor with another stretch."""
    if not block.num_rows:
        return _table(key=np.zeros(0, np.uint64), window=np.zeros(0, np.uint64), block=np.zeros(0, np.int32),
                      least=np.zeros(0, np.int64), span=np.zeros(0, np.int64))
    known = Answers(answers)
    parts = [(doc, words, found) for doc, words, found, _ in _read(block)]
    crowded = _crowded(np.concatenate([p[2].key for p in parts]), np.concatenate([p[2].extent for p in parts]))
    keys, windows, ids = [], [], []
    for doc, words, found in parts:
        least, ask = known.of(marks(found.key, found.extent))
        own = doc[found.owner]
        rows = np.flatnonzero((least >= own) & (ask | np.isin(found.key, crowded)))
        stretch, at = found.windows(rows, words)
        keys.append(found.key[stretch])
        windows.append(words.grams(WINDOW)[at])
        ids.append(own[stretch])
    key, window, least, most = _combined([np.concatenate(keys), np.concatenate(windows)], np.concatenate(ids))
    return _table(key=key, window=window, block=np.full(len(key), block["block"][0].as_py(), np.int32), least=least, span=most ^ least)


LENT = "askers array<int>, least long, text string"


def _lend(block: pa.Table, asked: pa.Table) -> pa.Table:
    """The block's documents that blocks ask for as references, each with the numbers of those blocks."""
    schema = pa.schema([("askers", pa.list_(pa.int32())), ("least", pa.int64()), ("text", pa.string())])
    if not asked.num_rows:
        return schema.empty_table()
    asked = asked.sort_by([("least", "ascending"), ("asker", "ascending")])
    wanted, asker = asked["least"].to_numpy(), asked["asker"].to_numpy()
    ids = block["doc_id"].to_numpy()
    first, last = np.searchsorted(wanted, ids, side="left"), np.searchsorted(wanted, ids, side="right")
    rows = [(i, a, min(a + ASKERS, int(last[i])))
            for i in np.flatnonzero(first < last).tolist() for a in range(int(first[i]), int(last[i]), ASKERS)]
    lent = block.take(pa.array([i for i, _, _ in rows], pa.int64()))
    return pa.Table.from_arrays([
        pa.array([asker[a:b] for _, a, b in rows], pa.list_(pa.int32())), lent["doc_id"], lent["text"]], schema=schema)


class References:
    """Words of the documents lent to a block, and the places at which a window stands in one of them."""

    def __init__(self, lent: pa.Table):
        lent = lent.sort_by([("least", "ascending"), ("text", "ascending")])
        texts = lent["text"].cast(pa.binary()).to_pylist()
        hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for begin, end in slices(np.array([len(t) for t in texts]), SLICE):
            words = Words(np.frombuffer(b"".join(texts[begin:end]), np.uint8), np.cumsum([len(t) for t in texts[begin:end]]))
            hashes.append(words.hashes)
            owner.append(words.owner + begin)
        self.hashes, owner = np.concatenate(hashes), np.concatenate(owner)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.begin, self.end = bounds[owner], bounds[owner + 1]  # of the document that a word belongs to
        self.sums, self.powers = sums_of(self.hashes), powers(STEP, len(self.hashes) + 1)
        windows = grams(self.hashes, WINDOW)
        at = np.flatnonzero(np.arange(len(windows)) + WINDOW <= self.end[:len(windows)])
        mark = marks(windows[at], lent["least"].to_numpy()[owner[at]].view(np.uint64))
        order = np.argsort(mark, kind="stable")
        self.mark, self.at = mark[order], at[order]

    def places(self, windows: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) number in ``at`` of the places where each window stands in its reference."""
        mark = marks(windows, reference.view(np.uint64))
        return np.searchsorted(self.mark, mark, side="left"), np.searchsorted(self.mark, mark, side="right")


class Factors:
    """Greedy factors of some documents, from left to right: first word, number of words, place in the references.

    A factor starts at the first window that is not yet inside one and stands in an earlier document.  It is the
    longest match of the words from there on with any place of that window in its reference.  Windows over a factor's
    end are not inside it: the next factor starts at the first of them that stands in an earlier document, else behind.
    So all windows that stand in an earlier document are inside factors, and factors have no others.
    """

    def __init__(self, words: Words, reference: np.ndarray, known: References):
        self.words, self.known = words, known
        self.sums, self.powers = sums_of(words.hashes), powers(STEP, len(words.hashes) + 1)
        seeds = np.flatnonzero(reference != NONE)
        first, last = known.places(words.grams(WINDOW)[seeds], reference[seeds])
        seeds, first, last = (x[first < last] for x in (seeds, first, last))  # the others only shared a mark
        owner = words.owner[seeds]
        end = np.searchsorted(words.owner, owner, side="right")
        now = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])[:len(seeds)])
        found = [np.zeros((3, 0), np.int64)]
        while len(now):  # one factor of each document that is not through
            sizes = np.concatenate([np.zeros(0, np.int64), *(
                self._longest(seeds[now[a:b]], end[now[a:b]], first[now[a:b]], last[now[a:b]], found)
                for a, b in slices(last[now] - first[now], PLACES))])
            after = np.searchsorted(seeds, seeds[now] + np.maximum(sizes - WINDOW, 0) + 1)
            inside = after < len(seeds)
            inside[inside] = owner[after[inside]] == owner[now[inside]]
            now = after[inside]
        start, size, place = np.concatenate(found, axis=1)
        order = np.argsort(start, kind="stable")
        order = order[size[order] >= WINDOW]
        self.start, self.size, self.place = start[order], size[order], place[order]

    def _longest(self, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, found: list) -> np.ndarray:
        """Lengths of the longest matches of the words from ``start`` on; the matches go to ``found``."""
        counts = last - first
        of = np.repeat(np.arange(len(start)), counts)
        begin = np.cumsum(counts) - counts
        place = self.known.at[first[of] + np.arange(len(of)) - begin[of]]
        own = start[of]
        size, beyond = np.full(len(of), WINDOW), np.minimum(end[of] - own, self.known.end[place] - place) + 1
        while (beyond - size > 1).any():
            half = (size + beyond) // 2
            same = (self.sums[own + half] - self.sums[own]) * self.known.powers[place] == (
                self.known.sums[place + half] - self.known.sums[place]) * self.powers[own]
            size, beyond = np.where(same, half, size), np.where(same, beyond, half)
        longest = np.flatnonzero(size == np.maximum.reduceat(size, begin)[of])
        chosen = longest[np.unique(of[longest], return_index=True)[1]]  # the first such place
        place, size = place[chosen], size[chosen]
        of = np.repeat(np.arange(len(start)), size)  # sums can agree by chance, so the words are compared
        nth = np.arange(len(of)) - (np.cumsum(size) - size)[of]
        other = np.flatnonzero(self.words.hashes[start[of] + nth] != self.known.hashes[place[of] + nth])
        np.minimum.at(size, of[other], nth[other])
        found.append(np.stack([start, size, place]))
        return size


FACTOR = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("reference", pa.int64()), ("place", pa.int32())])
PARSED = ("doc_id long, n_words long, n_removed long, kept string, "
          "factors array<struct<start:int,words:int,reference:long,place:int>>")


def _parse(block: pa.Table, answers: pa.Table) -> pa.Table:
    """The block's documents with their factors and the words that no factor covers."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
                        ("factors", pa.list_(FACTOR))])
    if not block.num_rows:
        return schema.empty_table()
    stretches, windows, lent = (answers.filter(pc.equal(answers["kind"], n)) for n in range(3))
    stretch_answers, window_answers, known = Answers(stretches), Answers(windows), References(lent)
    tables = []
    for doc, words, found, texts in _read(block):
        size = len(words.hashes)
        reference = np.full(size, NONE)  # of the window that starts at a word
        own = doc[found.owner]
        least, _ = stretch_answers.of(marks(found.key, found.extent))
        whole = least < own
        stretch, at = found.windows(np.flatnonzero(whole), words)
        reference[at] = least[stretch]
        stretch, at = found.windows(np.flatnonzero(~whole), words)
        if len(at):
            checked, _ = window_answers.of(marks(found.key[stretch], words.grams(WINDOW)[at]))
            reference[at] = np.where(checked < own[stretch], checked, NONE)
        factors = Factors(words, reference, known)
        edge = np.zeros(size + 1, dtype=np.int64)
        np.add.at(edge, factors.start, 1)
        np.add.at(edge, factors.start + factors.size, -1)
        removed = np.cumsum(edge)[:size] > 0
        bounds = np.searchsorted(words.owner, np.arange(len(doc) + 1))
        factor_owner = words.owner[factors.start]
        factor_bounds = np.searchsorted(factor_owner, np.arange(len(doc) + 1))
        parsed = pa.StructArray.from_arrays([
            pa.array((factors.start - bounds[factor_owner]).astype(np.int32)), pa.array(factors.size.astype(np.int32)),
            pa.array(reference[factors.start]),
            pa.array((factors.place - known.begin[factors.place]).astype(np.int32))], fields=list(FACTOR))
        totals = np.concatenate([[0], np.cumsum(removed)])
        kept = []
        for i, text in enumerate(texts):
            split = text.split()
            if totals[bounds[i + 1]] > totals[bounds[i]]:
                split = [w for w, gone in zip(split, removed[bounds[i]:bounds[i + 1]].tolist()) if not gone]
            kept.append(b" ".join(split).decode())
        tables.append(pa.Table.from_arrays([
            pa.array(doc), pa.array(np.diff(bounds).astype(np.int64)), pa.array(np.diff(totals[bounds]).astype(np.int64)),
            pa.array(kept, pa.string()),
            pa.ListArray.from_arrays(pa.array(factor_bounds.astype(np.int32)), parsed).cast(pa.list_(FACTOR)),
        ], schema=schema))
    return pa.concat_tables(tables)


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without an id: nothing of them is removed, and they are nobody's reference."""
    for batch in batches:
        words = [text.split() for text in batch.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.nulls(len(words), pa.int64()), "n_words": pa.array([len(w) for w in words], pa.int64()),
            "n_removed": pa.array([0] * len(words), pa.int64()),
            "kept": pa.array([b" ".join(w).decode() for w in words], pa.string()),
            "factors": pa.array([[]] * len(words), pa.list_(FACTOR)),
        })


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (doc_id, n_words, n_removed, kept, factors) for each document.

    Words are runs of other than ASCII white space.  A window is ``WINDOW`` words one after the other.  Each document is
    parsed greedily, from left to right, relative to the documents with smaller ids: where a window stands in one, the
    factor is the longest match from there on with that document, and windows over its end are looked at again, as one
    may stand elsewhere.  ``factors`` are (start, words, reference, place): so many words from ``start`` on stand one
    after the other in the document ``reference`` from its word ``place`` on, and do not go on alike; they are at least
    a window long and may overlap by less than one.  Words in factors are removed: these are the words covered by a
    window which also starts in a document with a smaller id.  ``kept`` has the others, joined by one space.  Where
    several earlier documents hold the window, the reference is the smallest that holds the stretch (below) around it.
    In crowds of stretches it can be another of them, as the blocks fall; the removed words are the same.

    The corpus is dealt into reference blocks, and an index of all blocks tells a document the windows at which factors
    can start and an earlier document of each.  Each block is indexed by its stretches: the words under neighbouring
    windows that share an anchor.  Where a stretch stands whole in an earlier document, so do all its windows.  Factors
    begin and end in stretches that share an anchor with others without being equal; there the windows are looked up one
    by one.  What matches nowhere, the most of a corpus, is not compared any further.  Documents named as references
    are lent, once, to the blocks that name them, where the matches with their words are extended.

    A block tells the index each of its stretches once, with its smallest and largest document, and of an anchor with
    very many stretches only the first ones, checking all their windows instead.  So a passage that a third of all
    documents share is as many rows in the index as there are blocks, not as there are documents.  A block holds its
    own texts and those lent to it, at most one reference a window.  Words are compared by hashes of 64 bits.

    A missing text has no words.  Rows without an id keep all words and are no reference.  Rows of one id are judged
    each against smaller ids, not against each other, and come back as often as given.  Texts of fewer words than a
    window are kept.  Ids are whole numbers.  Other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    partitions = min(max(1, -(-blocks // BLOCKS_A_PARTITION)), PARTITIONS)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    known = rows.where("doc_id IS NOT NULL").withColumn("block", block).repartition(partitions, "block")

    most = F.col("least").bitwiseXOR(F.col("span"))
    index = known.groupBy("block").applyInArrow(_index, INDEX).repartition("key")
    stretch, anchor = Window.partitionBy("key", "extent").orderBy("least"), (
        Window.partitionBy("key").orderBy("extent", "least")  # the order that the other window needs, so one sort does
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    several = (F.min("extent").over(anchor) < F.max("extent").over(anchor)) & (
        F.min("least").over(anchor) < F.max(most).over(anchor))
    told = (
        index.withColumn("first", F.first("least").over(stretch))
        .withColumn("ask", several & (F.col("least") == F.col("first")))
        .where((F.col("first") < most) | F.col("ask"))
        .select("block", "key", F.col("extent").alias("value"), F.col("first").alias("least"), "ask",
                (F.col("first") < most).alias("found"))
    )
    stretches = told.drop("found").repartition(partitions, "block")
    asked = known.groupBy("block").cogroup(stretches.groupBy("block")).applyInArrow(_ask, ASKED)
    window = Window.partitionBy("key", "window").orderBy("least")
    windows = (
        asked.withColumn("first", F.first("least").over(window)).where(F.col("first") < most)
        .select("block", "key", F.col("window").alias("value"), F.col("first").alias("least"), F.lit(False).alias("ask"),
                F.lit(1).alias("kind"))
    )
    references = (
        told.where("found").select("block", "least").unionByName(windows.select("block", "least")).distinct()
        .select(F.pmod(F.xxhash64("least"), F.lit(blocks)).cast("int").alias("block"), "least",
                F.col("block").alias("asker"))
    )
    lent = known.groupBy("block").cogroup(references.groupBy("block")).applyInArrow(_lend, LENT)
    lent = lent.select(F.explode("askers").alias("block"), "least", "text", F.lit(2).alias("kind"))
    answers = (  # all dealt alike, so their union is
        stretches.withColumn("kind", F.lit(0)).unionByName(windows.repartition(partitions, "block"))
        .unionByName(lent.repartition(partitions, "block"), allowMissingColumns=True)
    )
    parsed = known.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_parse, PARSED)
    return parsed.unionByName(rows.where("doc_id IS NULL").select("text").mapInArrow(_plain, PARSED))
