"""Toxicity by a weighted lexicon: Aho-Corasick over folded texts, exception phrases, length normalisation."""

from __future__ import annotations

import functools
import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcellar.llm.logistic import fit, sigmoid
from starcellar.llm.tables import crc_remainder, portions, stored

FIT_ROWS = 20_000  # labelled documents the lexicon and the curve are fitted on at most
STEMS = (4, 5, 6, 7)  # lengths of word beginnings that may become entries, beside whole words
CANDIDATES = 20_000  # terms that entries are chosen from at most
SEEN = 3  # toxic documents that an entry must explain
SHARE = 0.002  # and which share of them
COVER = 4  # entries that a toxic document is explained by; more of its words are not looked for
RATIO = 20.0  # how much more often an entry must occur in toxic documents than in others

# Characters drawn like a Latin letter, and digits and signs written for one.  l, i, 1, | and ! are one
# letter, since 1 stands for either.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x", "ԝ": "w", "α": "a",
    "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ø": "o", "ł": "l", "đ": "d",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
# Phrases in which a word of abuse is none.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown",
    "scum on the pond", "pond scum", "idiot light", "sore loser", "stupid question",
)

_DROPPED = ("Mn", "Mc", "Me", "Cf")  # marks on letters, and characters that show nothing, as a zero-width space
_SPACED = re.compile(r"[^\w@$!|]+|_")
_FOLDS = str.maketrans({**HOMOGLYPHS, **SUBSTITUTES})


def fold(text: str) -> str:
    """Lower case, marks and invisible characters removed, homoglyphs and substitutes as letters; words apart by one space."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in _DROPPED)
    text = text.lower()
    return " " + _SPACED.sub(" ", text).translate(_FOLDS).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    """Entries are folded: `` word `` for a whole word, `` stem`` for a word's beginning; ``curve`` is (offset, slope)."""

    weights: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float] = (0.0, 1.0)


@functools.lru_cache(maxsize=4)
def automaton(lexicon: Lexicon) -> ahocorasick.Automaton | None:
    entries: dict[str, tuple[int, float | None]] = {}
    for phrase in lexicon.exceptions:
        folded = fold(phrase)
        entries[folded] = (len(folded), None)
    for entry, weight in lexicon.weights:
        entries.setdefault(entry, (len(entry), weight))
    if not entries:
        return None
    machine = ahocorasick.Automaton()
    for entry, value in entries.items():
        machine.add_word(entry, value)
    machine.make_automaton()
    return machine


def weight_of(text: str, lexicon: Lexicon) -> tuple[float, int]:
    """Weight of the matched words outside exception phrases, each word by its heaviest entry; number of words."""
    folded = fold(text)
    words = folded.count(" ") - 1 if folded != "  " else 0
    machine = automaton(lexicon)
    if machine is None or not words:
        return 0.0, words
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight) in machine.iter(folded):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if excused and best:
        best = {at: w for at, w in best.items() if not any(a <= at < b for a, b in excused)}
    return sum(best.values()), words


def feature(total: float, words: int) -> float:
    """Weight by length: a word in fifty and a word in five are told apart, and so are none and one."""
    return math.log1p(1000 * total / (words + 20))


def _terms(text: str | None) -> set[str]:
    """Whole words and word beginnings of a text, folded."""
    words = set(fold(text or "").split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) >= n}


def explaining(documents: list[list[int]], terms: list[str], clean: list[int], least: float) -> list[int]:
    """Numbers of the terms chosen, in order; ``documents`` has the terms of each toxic document, ``clean`` the number of
    clean documents of each term.

    A term that continues a chosen one, or that a chosen one continues, stands for the same words and is passed over.
    """
    inside: dict[int, list[int]] = {}
    for at, found in enumerate(documents):
        for n in found:
            inside.setdefault(n, []).append(at)
    needs, chosen, passed = [COVER] * len(documents), [], set()
    # the gain of a term only falls, so a stale one at the top is counted again and put back
    heap = [(2 * clean[n] - len(rows), terms[n], n) for n, rows in inside.items()]
    heapq.heapify(heap)
    while heap:
        negative, term, n = heapq.heappop(heap)
        if -negative < least:
            break
        if any(term.startswith(t) or t.startswith(term) for t in passed):
            continue
        gain = sum(needs[at] > 0 for at in inside[n]) - 2 * clean[n]
        if gain < -negative:
            if gain >= least:
                heapq.heappush(heap, (-gain, term, n))
            continue
        chosen.append(n)
        passed.add(term)
        for at in inside[n]:
            needs[at] -= 1
    return chosen


def learn(labelled: DataFrame, text: str, label: str, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from labelled texts, of which the caller gives a bounded number.

    Whole words and word beginnings are counted once a document, in Spark, and those much more frequent in toxic
    documents are candidates.  Entries are chosen one by one: each time the candidate that explains the most toxic
    documents not yet explained by ``COVER`` entries, less twice the clean ones it occurs in.  Chance words of a toxic
    document are left out that way, as its words of abuse explain it already.
    """
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for body, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic == 1].update(_terms(body))
            entries = list(counts[True].keys() | counts[False].keys())
            yield pa.RecordBatch.from_pydict({
                "term": pa.array(entries, pa.string()),
                "toxic": pa.array([counts[True][t] for t in entries], pa.int64()),
                "clean": pa.array([counts[False][t] for t in entries], pa.int64()),
            })

    sample = labelled.select(F.col(text).alias("text"), F.col(label).alias("label")).where("label IN (0, 1)")
    sizes = sample.agg(F.sum("label").alias("toxic"), F.count("*").alias("rows")).first()
    toxic, clean = sizes["toxic"] or 0, sizes["rows"] - (sizes["toxic"] or 0)
    if not toxic or not clean:  # nothing to tell apart: every text gets the share of toxic rows
        share = (toxic + 0.5) / (toxic + clean + 1)
        return Lexicon((), exceptions, (math.log(share / (1 - share)), 0.0))
    ratio = F.log(((F.col("toxic") + 0.1) / toxic) / ((F.col("clean") + 0.1) / clean))
    least = max(SEEN, SHARE * toxic)
    ranked = (
        sample.mapInArrow(terms, "term string, toxic long, clean long").groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= least).withColumn("weight", ratio).where(F.col("weight") > math.log(RATIO))
        .orderBy(F.desc(F.col("weight") * F.log1p("toxic")), "term").limit(CANDIDATES).collect()
    )
    number = {r["term"]: n for n, r in enumerate(ranked)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = [sorted(number[t] for t in _terms(body) if t in number) for body in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["terms"])

    documents = [r["terms"] for r in sample.where("label = 1").select("text").mapInArrow(held, "terms array<int>").collect()]
    chosen = explaining(documents, [r["term"] for r in ranked], [r["clean"] for r in ranked], least)
    plain = Lexicon(tuple((ranked[n]["term"], float(ranked[n]["weight"])) for n in chosen), exceptions)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = [feature(*weight_of(body or "", plain)) for body in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1).cast(pa.int32())], ["x", "y"])

    # in a fixed order, as sums of doubles depend on theirs
    points = sorted(map(tuple, sample.mapInArrow(weigh, "x double, y int").collect()))
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    curve = fit(np.column_stack([np.ones(len(x)), x]), y, ridge=1.0)
    return Lexicon(plain.weights, exceptions, (float(curve[0]), float(curve[1])))


def bounded_sample(labels: DataFrame, docs: DataFrame, label: str, keep: object, rows: int, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Texts of at most ``rows`` labelled ids, chosen by the hash of the id; ``keep`` says which ids may be learnt from.

    The sample of the labels is bounded, so it can be sent to every task; only chosen texts are shuffled, one a task for
    each id.  An id labelled more than once counts with its smallest label, one with several texts with the text of the
    smallest digest.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("sample_id"), F.col(label).alias("label"))
        .where(F.col("sample_id").isNotNull() & F.col("label").isin(0, 1) & keep(F.col("sample_id")))
        .groupBy("sample_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("sample_id"), "sample_id").limit(rows)
    )
    texts = docs.select(F.col(doc_id).alias("sample_id"), F.col(text).alias("text"))
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    first = F.min(F.struct(digest.alias("digest"), "text")).alias("first")
    return texts.join(F.broadcast(chosen), "sample_id").groupBy("sample_id", "label").agg(first).select(
        "sample_id", "first.text", "label")


def score_toxicity(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, score, weight, words) for each document; ``score`` rises from 0 to 1 with the toxicity.

    A missing or empty text, or one without words, has weight 0.  Repeated rows are scored each; other columns are
    not looked at; texts are folded whole.
    """
    offset, slope = lexicon.curve

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = [weight_of(body or "", lexicon) for body in batch.column(1).to_pylist()]
            x = np.array([feature(*f) for f in found])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sigmoid(offset + slope * x), pa.float64()),
                pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()),
            ], ["doc_id", "score", "weight", "words"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double, weight double, words long")


def lexicon_from(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, fit_rows: int = FIT_ROWS,
                 doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """A lexicon from at most ``fit_rows`` labelled documents whose crc32 of the id modulo ``folds`` isn't ``held_out``.

    Empty tables give an empty lexicon.  Columns beside id, text and label are not looked at.
    """
    sample = bounded_sample(
        labels, docs, label, lambda i: crc_remainder(i, folds) != held_out, fit_rows, doc_id, text)
    return learn(stored(sample, "labelled"), "text", "label")  # learning reads it several times


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, fit_rows: int = FIT_ROWS,
             doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, weight, words) for all documents by a lexicon learnt from the labels.

    Labels of rows whose crc32 of the id modulo ``folds`` is ``held_out`` are never learnt from.  At most
    ``fit_rows`` labelled rows are used, chosen by the hash of the id.  Without labels of both kinds every score is
    the share of toxic rows.  ``predicted`` is 1 from a score of 0.5.  An empty table of documents gives an empty result;
    other columns are not looked at, whatever their names; repeated rows get a row each.
    """
    lexicon = lexicon_from(docs, labels, folds, held_out, fit_rows, doc_id, text, label)
    return score_toxicity(docs, lexicon, doc_id, text).select(
        "doc_id", (crc_remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "weight", "words")


def without_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The documents with a score below 0.5, with all their columns.  A missing text stays."""
    offset, slope = lexicon.curve
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            x = np.array([feature(*weight_of(body or "", lexicon)) for body in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(sigmoid(offset + slope * x) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
