"""Benchmark decontamination: training passages whose upper bounds reach the threshold query a BM25 index of the test
items by block-max WAND."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcellar.llm.tables import portions
from starcellar.session import scratch_path

K1, B = 1.2, 0.75
THRESHOLD = 0.6  # of the score an item has against itself
OVERLAP = 0.6  # share of the question's and of the answer's words, or of the whole item's, that must be found
PART_WORDS = 8  # a shorter question or answer is not judged by itself, as one changed word takes most of its pairs
SHINGLE = 2
MIN_WORDS = 8  # shorter items must stand word for word
PASSAGE = 128  # words, doubled until an item is no longer than half of them
BLOCK = 64  # postings of a block
PART_BYTES = 8 << 20  # item text that one index holds; more items make more indexes

_WORD = re.compile(r"\w+")
_ENDS = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words up to its last question mark and after it; else its last sentence is the answer; else its
    second half."""
    head, mark, tail = text.rpartition("?")
    question, answer = words_of(head), words_of(tail)
    if mark and question and answer:
        return question, answer
    sentences = [w for w in map(words_of, _ENDS.split(text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = words_of(text)
    return words[:(len(words) + 1) // 2], words[(len(words) + 1) // 2:]


def passage_for(words: int) -> int:
    """Words of the passages in which an item of so many words is looked for, whatever other items there are."""
    size = PASSAGE
    while size < 2 * words:
        size *= 2
    return size


def parts_of(text: str) -> tuple[list[str], ...]:
    """What must be found of an item, each by itself: its question and its answer if a question mark parts them and
    both have ``PART_WORDS`` words; else the item as a whole."""
    question, _, answer = text.rpartition("?")
    if min(len(words_of(question)), len(words_of(answer))) >= PART_WORDS:
        return question_and_answer(text)
    return (words_of(text),)


def overlap(part: list[str], passage: list[str], shingle: int = SHINGLE) -> float:
    """Share of the part's words that stand in a run of ``shingle`` words (or of all its words) of the passage too."""
    n = min(shingle, len(part))
    if not n:
        return 1.0
    there = set(zip(*(passage[i:] for i in range(n))))
    covered = [False] * len(part)
    for at, run in enumerate(zip(*(part[i:] for i in range(n)))):
        if run in there:
            covered[at:at + n] = [True] * n
    return sum(covered) / len(part)


@dataclass
class Postings:
    """Items with their impact in rising order, cut into blocks of which the largest impact is known."""

    items: list[int]
    impacts: list[float]
    block_max: list[float] = field(init=False)
    top: float = field(init=False)

    def __post_init__(self):
        self.block_max = [max(self.impacts[i:i + BLOCK]) for i in range(0, len(self.impacts), BLOCK)]
        self.top = max(self.block_max)


class Index:
    """BM25 impacts of terms, each divided by the score its item has against its own words.

    ``essential`` terms of an item are its heaviest ones, up to where the rest together stay below half of the
    threshold: an item above the threshold has at least the other half from them.
    """

    def __init__(self, items: list[tuple[int, str]], found_in: dict[str, int], total: int, mean: float,
                 threshold: float = THRESHOLD, min_words: int = MIN_WORDS):
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        self.parts = [parts_of(text) for _, text in items]
        self.shingle: list[int] = []  # words of the runs that must be common, for a short item all of its words
        self.passage = PASSAGE
        postings: dict[str, tuple[list[int], list[float]]] = {}
        heavy: dict[str, tuple[list[int], list[float]]] = {}
        self.light = np.zeros(len(items))
        for at, (_, text) in enumerate(items):
            words = words_of(text)
            self.passage = max(self.passage, passage_for(len(words)))
            self.shingle.append(SHINGLE if len(words) >= min_words else len(words))
            if len(words) < min_words:
                self.parts[at] = (words,)
            norm = K1 * (1 - B + B * len(words) / mean)
            impact = {
                w: math.log1p((total - found_in[w] + 0.5) / (found_in[w] + 0.5)) * tf * (K1 + 1) / (tf + norm)
                for w, tf in Counter(words).items()
            }
            own = sum(impact.values())
            rest = 1.0
            for w, value in sorted(impact.items(), key=lambda x: (-x[1], x[0])):
                share = value / own
                for where in (postings, heavy) if rest >= threshold / 2 else (postings,):
                    held = where.setdefault(w, ([], []))
                    held[0].append(at)
                    held[1].append(share)
                if rest < threshold / 2:
                    self.light[at] += share
                rest -= share
        self.postings = {w: Postings(*p) for w, p in postings.items()}
        self.number = {w: n for n, w in enumerate(heavy)}
        sizes = [len(p[0]) for p in heavy.values()]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.heavy_items = np.array([i for p in heavy.values() for i in p[0]], dtype=np.int64)
        self.heavy_impacts = np.array([x for p in heavy.values() for x in p[1]])

    def promising(self, terms: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Numbers of segments that begin a passage (itself and the next one) for which some item has a pivot.

        ``terms`` are numbers of essential terms, ``segment`` where they stand.  An item has a pivot only if the
        essential terms found in both segments and all its light ones reach the threshold.
        """
        if not len(terms):
            return np.zeros(0, np.int64)
        once = np.unique(segment * len(self.number) + terms)
        segment, terms = once // len(self.number), once % len(self.number)
        sizes = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        items = len(self.ids)
        pair, where = np.unique(np.repeat(segment, sizes) * items + self.heavy_items[at], return_inverse=True)
        score = np.bincount(where, weights=self.heavy_impacts[at])
        following = np.minimum(np.searchsorted(pair, pair + items), len(pair) - 1)
        beside = np.where(pair[following] == pair + items, score[following], 0.0)
        both = score + beside + self.light[pair % items] >= self.threshold - 1e-9
        alone = score + self.light[pair % items] >= self.threshold - 1e-9  # for the passage that begins before
        begin = np.concatenate([pair[both] // items, pair[alone] // items - 1])
        return np.unique(begin[begin >= 0])

    def search(self, words: list[str]) -> list[tuple[int, float]]:
        """All items whose score reaches the threshold, by block-max WAND over the postings of the passage's words."""
        lists = [self.postings[w] for w in set(words) if w in self.postings]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        found = []
        need = self.threshold - 1e-9
        while live:
            live.sort(key=lambda i: lists[i].items[at[i]])
            bound, pivot = 0.0, -1
            for n, i in enumerate(live):
                bound += lists[i].top
                if bound >= need:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]].items[at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]].items[at[live[pivot + 1]]] == item:
                pivot += 1
            blocks, ends = 0.0, []
            for i in live[:pivot + 1]:
                p = lists[i]
                block = bisect_left(p.items, item, at[i]) // BLOCK
                if block < len(p.block_max):
                    blocks += p.block_max[block]
                    ends.append(p.items[min((block + 1) * BLOCK, len(p.items)) - 1])
            if blocks < need:  # no item up to the nearest end of a block can reach it
                target = max(item, min(ends, default=item)) + 1
                if pivot + 1 < len(live):
                    target = min(target, lists[live[pivot + 1]].items[at[live[pivot + 1]]])
                target = max(target, item + 1)
                moved = live[:pivot + 1]
            elif lists[live[0]].items[at[live[0]]] == item:
                score = sum(lists[i].impacts[at[i]] for i in live[:pivot + 1])
                if score >= need:
                    found.append((item, score))
                target, moved = item + 1, live[:pivot + 1]
            else:
                target, moved = item, [i for i in live[:pivot + 1] if lists[i].items[at[i]] < item]
            for i in moved:
                at[i] = bisect_left(lists[i].items, target, at[i])
            live = [i for i in live if at[i] < len(lists[i].items)]
        return found


def _indexes(items: DataFrame, item_id: str, text: str, min_words: int, part_bytes: int,
             threshold: float) -> list[Callable[[], list[Index]]]:
    """For each part of the items what makes its indexes, one for each length of passage; the numbers in BM25 are
    those of all items."""
    rows = (
        items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
        .where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([words_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string())),
            ], ["item_id", "text", "words"])

    rows = rows.mapInArrow(listed, "item_id long, text string, words array<string>").where(F.size("words") > 0)
    total, mean, size = rows.agg(
        F.count("*"), F.avg(F.size("words")), F.sum(F.octet_length("text").cast("long"))).first()
    parts = max(1, -(-(size or 0) // part_bytes))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    found_in = rows.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(
        F.count("*").alias("n"))

    def made(part: int) -> list[Index]:
        own = rows.where(F.col("part") == part)
        held = sorted((r["item_id"], r["text"]) for r in own.select("item_id", "text").collect())
        terms = own.select(F.explode("words").alias("word")).distinct().join(found_in, "word")
        counts = {r["word"]: r["n"] for r in terms.collect()}
        alike: dict[int, list[tuple[int, str]]] = {}
        for item in held:
            alike.setdefault(passage_for(len(words_of(item[1]))), []).append(item)
        return [Index(x, counts, total, mean, threshold, min_words) for _, x in sorted(alike.items())]

    return [functools.partial(made, part) for part in range(parts if total else 0)]


def _stored_hits(spark: SparkSession, parts: list[Callable[[], list[Index]]], look: Callable[[Broadcast], DataFrame],
                 schema: str) -> DataFrame:
    """Rows that ``look`` finds with the indexes of each part, written to the shared folder; a part's indexes are given
    up before the next ones are made, so the driver and the tasks hold those of one part."""
    path = scratch_path(spark, "leaks")
    for made in parts:
        sent = spark.sparkContext.broadcast(made())
        look(sent).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(schema).parquet(path)


HITS = "doc_id {kind}, item_id long, word long, score double, question_overlap double, answer_overlap double"


def leaks(texts: list[str | None], index: Index) -> list[tuple[int, int, int, float, float, float]]:
    """Rows (number of the text, item id, first word of the passage, score, question overlap, answer overlap)."""
    step = index.passage // 2
    docs = [words_of(t or "") for t in texts]
    segments = np.array([len(w) // step + 2 for w in docs], dtype=np.int64)  # an empty one parts documents
    first = np.concatenate([[0], np.cumsum(segments)])
    terms, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, words in enumerate(docs):
        numbers = np.fromiter(map(index.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        there = np.flatnonzero(numbers >= 0)
        terms.append(numbers[there])
        places.append(first[at] + there // step)
    begins = index.promising(np.concatenate(terms), np.concatenate(places))
    owners = np.searchsorted(first, begins, side="right") - 1
    rows = []
    for owner, begin in zip(owners.tolist(), begins.tolist()):
        start = (begin - int(first[owner])) * step
        passage = docs[owner][start:start + index.passage]
        for item, score in index.search(passage):
            found = [overlap(part, passage, index.shingle[item]) for part in index.parts[item]]
            if min(found) >= OVERLAP:
                rows.append((owner, index.ids[item], start, score, found[0], found[-1]))
    return rows


def contaminated_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                          item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
                          min_words: int = MIN_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, word, score, question_overlap, answer_overlap) of passages that hold a test item.

    Words are runs of letters, digits and underscores in lower case.  Every document is read in passages of
    ``PASSAGE`` words, each beginning half a passage after the last, so an item stands whole in at least one of them;
    for items longer than half of that the length is doubled until they are not, for each item by itself.  A passage
    retrieves all items whose BM25 score is at least ``threshold`` of what the item scores against itself; it is
    reported if at least ``OVERLAP`` of the words of the item's question and of its answer stand in runs of
    ``SHINGLE`` words common to both.  An item without a question mark between them, or with fewer than ``PART_WORDS``
    words in one of them, is judged as a whole, and both overlaps are the whole item's: so a short answer may be
    changed or missing.  ``word`` is where the passage begins.  Clean documents give no row.

    The items are indexed by parts of about ``part_bytes`` of text, and each part's index is sent to the tasks; every
    document queries every part.  With several parts the hits of each are written to the shared folder at once, and its
    index is given up before the next one is made.  Before the postings are walked, one grouping over all passages of a batch finds
    those in which some item's upper bounds can reach the threshold.

    Items with fewer than ``min_words`` words are found where all their words stand one after the other; so an item of
    one word is found wherever that word is.  Items without id, text or words are left out; repeated items count once.
    Missing and empty texts have no passage.  Repeated rows are reported each, a missing id as NULL.  Without items the
    result is empty.  Other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = HITS.format(kind=rows.schema["doc_id"].dataType.simpleString())
    spark = docs.sparkSession
    parts = _indexes(items, item_id, item_text, min_words, part_bytes, threshold)

    def look(sent: Broadcast) -> DataFrame:
        def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches):
                texts = batch.column(1).to_pylist()
                columns = list(zip(*(row for index in sent.value for row in leaks(texts, index)))) or [()] * 6
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(columns[0], pa.int64())),
                    *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.int64(), *[pa.float64()] * 3))),
                ], ["doc_id", "item_id", "word", "score", "question_overlap", "answer_overlap"])

        return rows.mapInArrow(query, schema)

    if len(parts) > 1:
        return _stored_hits(spark, parts, look, schema)
    return look(spark.sparkContext.broadcast(parts[0]())) if parts else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no test item is found.

    With several parts of items the digests of the texts found with each are written to the shared folder; documents
    with such a text go.
    """
    at = docs.columns.index(text)
    spark = docs.sparkSession
    parts = _indexes(items, item_id, item_text, min_words, part_bytes, threshold)

    def leaking(texts: list[str | None], indexes: list[Index]) -> list[int]:
        return sorted({row[0] for index in indexes for row in leaks(texts, index)})

    def look(sent: Broadcast) -> DataFrame:
        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches):
                texts = batch.column(0).to_pylist()
                found = {hashlib.sha256(texts[i].encode()).hexdigest() for i in leaking(texts, sent.value)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["digest"])

        return docs.select(text).mapInArrow(digests, "digest string").distinct()

    if len(parts) > 1:
        found = _stored_hits(spark, parts, look, "digest string").distinct()
        return docs.join(found, F.sha2(docs[text].cast("binary"), 256) == found["digest"], "left_anti")
    if not parts:
        return docs
    sent = spark.sparkContext.broadcast(parts[0]())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            clean = np.ones(batch.num_rows, dtype=bool)
            clean[leaking(batch.column(at).to_pylist(), sent.value)] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row (doc_id, item_id, n_passages, score, question_overlap, answer_overlap) for each leak: the best score
    and overlaps of the document's passages with the item."""
    return contaminated_passages(docs, items, **options).groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_passages"), F.max("score").alias("score"),
        F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap"))
