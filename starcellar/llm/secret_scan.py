"""Secrets by regular expressions, with a trigram index that names the documents each rule has to look at."""

from __future__ import annotations

import functools
import re._constants as ops
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcellar.llm.tables import stored

GRAM = 3
CHOICES = 64  # alternatives that a query spells out; an expression of more is a gap in them

Clauses = list[frozenset[str]]


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    The pattern keeps to what Java's and Python's expressions have in common.  Matches are leftmost and do not
    overlap, those that are too short included; these are then dropped.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


# The kinds asked for, in their order, and further ones after them.  Where a match is one run of
# characters, the least length stands in the expression: within a run too short, no later start gives a longer match.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}", base=False),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}", base=False),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", base=False),
)
RULES = BASE_RULES + MORE_RULES


# A pattern as alternatives; an alternative is a tuple of pieces of text that a match must hold in this order, where
# None stands for anything.  Neighbouring pieces without None between them are one text.
Alternatives = list[tuple[str | None, ...]]
GAP: Alternatives = [(None,)]


def _joined(left: Alternatives, right: Alternatives) -> Alternatives:
    right = right if len(left) * len(right) <= CHOICES else GAP
    return [a + b for a, b in product(left, right)]


def _alternatives(nodes: Sequence) -> Alternatives:
    found: Alternatives = [()]
    for op, value in nodes:
        if op is ops.LITERAL:
            part: Alternatives = [(chr(value),)]
        elif op is ops.SUBPATTERN:
            part = _alternatives(value[3])
        elif op is ops.BRANCH:
            part = [x for branch in value[1] for x in _alternatives(branch)]
            part = part if len(part) <= CHOICES else GAP
        elif op is ops.IN and all(o is ops.LITERAL for o, _ in value) and len(value) <= 8:
            part = [(chr(c),) for _, c in value]
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high, body = value
            inner = _alternatives(body)
            if (low, high) == (0, 1):
                part = [(), *inner]
            elif low == high == 1:
                part = inner
            elif low >= 1:
                part = _joined(_joined(inner, GAP), GAP if low == 1 else inner)
            else:
                part = GAP
        elif op is ops.AT:
            part = [()]
        else:
            part = GAP
        found = _joined(found, part)
    return found


@functools.cache
def trigram_query(pattern: str) -> tuple[frozenset[str], ...] | None:
    """Sets of trigrams (lower-cased A-Z), one of which every match holds as a whole; None if there is no such query."""
    clauses: Clauses = []
    for pieces in _alternatives(parser.parse(pattern)):
        grams: set[str] = set()
        run = ""
        for piece in (*pieces, None):
            if piece is not None:
                run += piece
                continue
            grams |= {run[i:i + GRAM].lower() for i in range(len(run) - GRAM + 1) if run.isascii()}
            run = ""
        if not grams:
            return None
        clauses.append(frozenset(grams))
    smallest = [c for c in set(clauses) if not any(o < c for o in clauses)]
    return tuple(sorted(smallest, key=sorted))


def trigram_index(docs: DataFrame, rules: Sequence[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, doc_id) of the trigrams that the rules' queries name.

    A posting says that some text of the id holds the trigram with A-Z in either case.  The trigrams of each text go
    to the shared folder, so that every text is folded and searched once.
    """
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) or () for g in clause})
    bodies = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text).cast("string")).alias("folded"))
    held = [F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in grams] or [F.lit(None).cast("string")]
    grams_of = bodies.select("doc_id", F.array_compact(F.array(*held)).alias("held"))
    return stored(grams_of, "trigrams").select(F.explode("held").alias("gram"), "doc_id")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows (doc_id, kinds): the indexed rules whose query the postings of the id satisfy.

    A clause's postings are intersected by counting them per id; the clauses of a rule are united.
    """
    spark = index.sparkSession
    terms = [
        (r.kind, n, len(clause), gram)
        for r in rules for n, clause in enumerate(trigram_query(r.pattern) or ()) for gram in sorted(clause)
    ]
    asked = spark.createDataFrame(terms, "kind string, clause int, size int, gram string")
    return (
        index.distinct().join(F.broadcast(asked), "gram").groupBy("doc_id", "kind", "clause", "size")
        .agg(F.count("*").alias("held")).where("held = size")
        .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))  # at most one entry for each rule
    )


def _spans_of(rule: Rule, body: Column) -> Column:
    """Spans (start, end) of a rule in a text, in code points.

    What lies between the matches comes from splitting at the same expression; adding up the lengths of both gives
    the places.
    """
    matches = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0))
    sizes = F.transform(matches, F.length)
    counted = sizes if rule.group == 0 else F.transform(
        F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    gaps = F.transform(F.split(body, rule.pattern, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, part: Column) -> Column:
        begin = state["at"] + part["gap"]
        end = begin + part["size"]
        span = F.struct(begin.alias("start"), end.alias("end"))
        spans = F.when(part["counted"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    parts = F.arrays_zip(
        F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"), sizes.alias("size"), counted.alias("counted"))
    return F.aggregate(parts, start, add, lambda state: state["spans"])


def with_spans(docs: DataFrame, rules: Sequence[Rule], doc_id: str, text: str, spans: str) -> DataFrame:
    """The documents with a further column ``spans``: (start, rank, kind, end) by start, then rule order."""
    listed = stored(candidates(trigram_index(docs, rules, doc_id, text), rules), "secret-candidates").select(
        F.col("doc_id").alias("listed id"), F.col("kinds").alias("listed kinds"))
    rows = docs.join(listed, F.col(doc_id).eqNullSafe(F.col("listed id")), "left")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int>>")
    found = []
    for n, rule in enumerate(rules):
        wanted = F.rlike(body, F.lit(rule.pattern))
        if trigram_query(rule.pattern) is not None:
            wanted = F.array_contains("listed kinds", rule.kind) & wanted
        found.append(_ranked(F.when(wanted, _spans_of(rule, body)).otherwise(none), n, rule))
    return rows.select(*docs.columns, F.array_sort(F.concat(*found)).alias(spans))


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row (doc_id, spans) for each document: spans (start, rank, kind, end) by start, then rule order.

    Rules whose expression has mandatory trigrams look at those documents alone that the index names; a rule without
    any, like runs of hexadecimal digits, scans every text.  Candidates are found by id, so the texts of a repeated id
    are all looked at; the expression decides in the end, and the result does not depend on the index.

    A missing text counts as empty and has no spans.  Repeated rows are scanned each.  An id that is NULL is an id
    like others.  Other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_spans(rows, rules, "doc_id", "text", "spans").select("doc_id", "spans")


def mask_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, mask: str = "[secret]", doc_id: str = "doc_id",
                 text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents, with all their columns, in which each stretch that spans cover is replaced by ``mask``.

    The column ``length``, where there is one, is set to the new length of a text that was changed.  A missing text
    stays missing.
    """
    names = docs.columns
    rows = with_spans(docs, rules, doc_id, text, "found spans")
    hit = F.size("found spans") > 0
    rows = rows.withColumn(text, F.when(hit, masked(F.col(text), F.col("found spans"), mask)).otherwise(F.col(text)))
    if length in names:
        kind = docs.schema[length].dataType
        rows = rows.withColumn(length, F.when(hit, F.length(text).cast(kind)).otherwise(F.col(length)))
    return rows.select(*names)


def _ranked(spans: Column, rank: int, rule: Rule) -> Column:
    """The spans with the rule's place and name."""
    return F.transform(spans, lambda s: F.struct(
        s["start"], F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"]))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(body: Column, spans: Column, mask: str) -> Column:
    """The text with each stretch that spans cover, overlapping ones together, replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("gaps"))

    def add(state: Column, span: Column) -> Column:
        gap = F.struct(state["at"].alias("start"), span["start"].alias("end"))
        apart = (span["start"] > state["at"]) | (F.size(state["gaps"]) == 0)
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(apart, F.concat(state["gaps"], F.array(gap))).otherwise(state["gaps"]).alias("gaps"))

    def pieces(state: Column) -> Column:
        gaps = F.concat(state["gaps"], F.array(F.struct(state["at"].alias("start"), F.length(body).alias("end"))))
        return F.array_join(
            F.transform(gaps, lambda g: F.substring(body, g["start"] + 1, g["end"] - g["start"])), mask)

    return F.when(F.size(spans) == 0, body).otherwise(F.aggregate(spans, start, add, pieces))
