"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel and stitched; decoding joins raw bytes."""

from __future__ import annotations

import base64
import functools
import itertools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcellar.llm.tables import portions, stored

CHUNK = 32_768  # characters a chunk adds
OVERLAP = 512  # characters two neighbouring chunks share
LOOKAHEAD = 3  # characters before a chunk's end whose splits may depend on what follows

ENCODED = "doc_id {kind}, ids array<int>"


@functools.lru_cache(maxsize=4)
def token_bytes(ranks: bytes) -> dict[int, bytes]:
    """The bytes of each token of a rank file."""
    return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, ranks.splitlines())}


class Vocabulary:
    """Ranks of byte strings and the pattern that splits text before any merge."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {token: rank for rank, token in token_bytes(ranks).items()}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.sizes = np.zeros(max(table.values(), default=-1) + 1, dtype=np.int64)
        for token, rank in table.items():
            self.sizes[rank] = len(token)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text: its pieces one after the other, each merged by itself."""
        return np.array(self.library.encode_ordinary(text), dtype=np.int32)


@functools.lru_cache(maxsize=4)
def vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(ranks, pattern)


@functools.cache
def _newer_characters() -> regex.Pattern:
    """Characters that the pattern library classifies and Python's own tables, which are older, do not."""
    assigned = regex.compile(r"[\p{L}\p{N}\s]")
    new = [c for c in range(0x250, 0x110000) if unicodedata.category(chr(c)) == "Cn" and assigned.match(chr(c))]
    runs = [list(g) for _, g in itertools.groupby(enumerate(new), key=lambda x: x[1] - x[0])]
    return regex.compile("[" + "".join(f"{chr(r[0][1])}-{chr(r[-1][1])}" for r in runs) + "]") if runs else regex.compile(r"(?!)")


_BEYOND = regex.compile("[^\x00-ɏ]")


def _newer(text: str) -> bool:
    """Whether the encoder's own character tables must decide, since tables of different age may disagree."""
    return not text.isascii() and _BEYOND.search(text) is not None and _newer_characters().search(text) is not None


def cut(text: str, chunk: int, overlap: int) -> list[str]:
    """Chunks from every ``chunk``-th character, each reaching ``overlap`` characters into the next one."""
    starts = range(0, max(len(text) - overlap, 1), chunk)
    return [text[s:s + chunk + overlap] if s + chunk < starts.stop else text[s:] for s in starts]


def encoded_chunk(text: str, vocab: Vocabulary, chunk: int, overlap: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's ids, and as rows (place, ids before it) the piece starts in the overlaps with its neighbours.

    The first rows are those in the overlap with the chunk before, places from this chunk's start; the second those in
    the overlap with the next, places from that one's start.  Starts so near the end that what follows the chunk may
    change them are none.
    """
    pieces, ids = vocab.pieces(text), vocab.ids(text)
    starts = np.cumsum([0, *map(len, pieces)], dtype=np.int32)[:-1]
    in_bytes = starts if text.isascii() else np.cumsum([0, *(len(p.encode()) for p in pieces)])[:-1]
    before = np.searchsorted(np.cumsum(vocab.sizes[ids]), in_bytes, "right").astype(np.int32)
    sure = slice(None) if last else starts <= len(text) - LOOKAHEAD - 1
    places = np.column_stack([starts, before])[sure]
    head = places[places[:, 0] <= overlap]
    tail = places[places[:, 0] >= chunk] - np.array([chunk, 0], dtype=np.int32)
    return ids, head, tail[:0] if last else tail


def stitch(chunks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray] | None:
    """Ids of the whole text from its encoded chunks in order; None if two neighbours share no piece start.

    A chunk's pieces hold from a true start on, as the pattern never looks back.  The first chunk begins at one; the
    first start that two neighbours share in their overlap is true for the later chunk too.
    """
    found: list[np.ndarray] = []
    ids, tail, begin = None, None, 0
    for next_ids, head, next_tail in chunks:
        if ids is not None:
            _, of_tail, of_head = np.intersect1d(tail[:, 0], head[:, 0], assume_unique=True, return_indices=True)
            if not len(of_tail):
                return None
            found.append(ids[begin:int(tail[of_tail[0], 1])])
            begin = int(head[of_head[0], 1])
        ids, tail = next_ids, next_tail
    return found if ids is None else [*found, ids[begin:]]


def _ids_array(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, np.int32)]), pa.int32()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row (doc_id, ids) for each document: the tokens of its whole text, without special tokens.

    Texts of at most ``chunk`` characters are one chunk.  Longer texts are cut into overlapping chunks, which are dealt
    out, pre-tokenised and encoded apart from each other; the ids of a text's chunks then meet in their order, and
    neighbours are joined at the first piece start that both found in their overlap.  A text in which neighbours share
    none, as one of a single piece, is encoded whole where it lies.

    Each distinct long text is encoded once: a task cuts only the first of its copies, of these the task that encodes a
    chunk keeps one.  Ids of rows travel by text and task and meet the chunks' ids in the shuffle that gathers those; a
    task's rows are written with the text's ids once and come apart when they are read.

    Texts with characters that the tables of the encoder and of the pattern library may classify differently are
    encoded whole by the encoder.  Missing and empty texts give an empty array.  Repeated rows come back as often
    as given.  Other columns are not looked at.
    ``ranks_path`` is read by the driver and sent to the tasks.
    """
    if overlap <= 2 * LOOKAHEAD or chunk < overlap:
        raise ValueError("a chunk must be at least as long as the overlap, and the overlap longer than the lookahead")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ranks = _sent(docs, ranks_path)
    load = lambda: vocabulary(ranks.value, pattern)
    size = F.char_length("text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load()
        for batch in portions(batches):
            found = [vocab.ids(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _ids_array(found)], ["doc_id", "ids"])

    encode_whole = lambda df: df.mapInArrow(whole, ENCODED.format(kind=kind))
    long = rows.where(size > chunk).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    holders = long.withColumn("task", F.spark_partition_id()).groupBy("digest", "task").agg(
        F.collect_list(F.struct("doc_id")).alias("rows"))  # in a struct, as missing ids are rows too
    gathered = stored(encoded_long(long, holders, load, chunk, overlap), "bpe")
    found = encode_whole(rows.where(size <= chunk)).unionByName(
        gathered.where("ids IS NOT NULL").select(F.explode("rows").alias("row"), "ids").select("row.doc_id", "ids"))
    apart = gathered.where("ids IS NULL").select("digest").distinct()
    if apart.limit(1).count():
        found = found.unionByName(encode_whole(long.join(apart, "digest", "left_semi").select("doc_id", "text")))
    return found


def encoded_long(long: DataFrame, holders: DataFrame, load: Callable[[], Vocabulary], chunk: int, overlap: int) -> DataFrame:
    """A row (digest, rows, ids) for each row of ``holders``: the ids of its text, NULL where its chunks do not meet.

    ``long`` has rows (digest, text).  Chunks of a text are shuffled once, as text, to the tasks that encode them, and
    once as ids to the task that joins them.
    """
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for row in range(batch.num_rows):
                digest = batch.column(0)[row].as_py()
                if digest in seen:
                    continue
                seen.add(digest)
                body = batch.column(1)[row].as_py()
                parts = [body] if _newer(body) else cut(body, chunk, overlap)
                yield pa.RecordBatch.from_arrays([
                    pa.array([digest] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()),
                    pa.array([len(parts)] * len(parts), pa.int32()), pa.array(parts, pa.string()),
                ], ["digest", "n", "of", "text"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen = load(), set()
        for batch in portions(batches):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            fresh = [row for row, key in enumerate(keys) if not (key in seen or seen.add(key))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            digests, n, of, body = (batch.column(i).to_pylist() for i in range(4))
            none = np.zeros((0, 2), np.int32)
            found = [(vocab.ids(t), none, none) if o == 1 else encoded_chunk(t, vocab, chunk, overlap, i + 1 == o)
                     for i, o, t in zip(n, of, body)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:2], _ids_array([f[0] for f in found]),
                *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (1, 2)),
            ], ["digest", "n", "ids", "head", "tail"])

    places = lambda held: np.frombuffer(held, np.int32).reshape(-1, 2)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((batch, row, batch.column(0)[row].as_py(), batch.column(1)[row].as_py())
                  for batch in batches for row in range(batch.num_rows))
        for digest, group in itertools.groupby(stream, key=lambda r: r[2]):
            rows, first = [], None
            for batch, row, _, n in group:
                if n >= 0:
                    first = batch, row
                    break
                rows.append(batch.column(5).slice(row, 1))
            parts = ((b.column(2)[r].values.to_numpy(), places(b.column(3)[r].as_py()), places(b.column(4)[r].as_py()))
                     for b, r, *_ in itertools.chain([first], group))
            ids = stitch(parts)
            ids = pa.array([None], pa.list_(pa.int32())) if ids is None else _ids_array([np.concatenate(ids)])
            for held in rows:
                yield pa.RecordBatch.from_arrays([pa.array([digest], pa.string()), held, ids], ["digest", "rows", "ids"])

    chunked = (
        long.select("digest", "text").mapInArrow(chunks, "digest string, n int, of int, text string")
        .repartition("digest", "n").mapInArrow(encoded, "digest string, n int, ids array<int>, head binary, tail binary")
    )
    of_rows = holders.select(
        "digest", F.lit(-1).alias("n"), F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("binary").alias("head"),
        F.lit(None).cast("binary").alias("tail"), "rows")
    listed = holders.schema["rows"].dataType
    return (
        chunked.withColumn("rows", F.lit(None).cast(listed)).unionByName(of_rows)
        .repartition("digest").sortWithinPartitions("digest", "n")
        .mapInArrow(join, f"digest string, rows {listed.simpleString()}, ids array<int>")
    )


def decode(encoded: DataFrame, ranks_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The rows (doc_id, ids) with ``decoded``: the bytes of all ids one after the other.  No ids: no bytes."""
    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ranks = _sent(encoded, ranks_path)

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks.value)  # all that decoding needs
        for batch in portions(batches):
            column = batch.column(1)
            found = [b"".join(map(table.__getitem__, x.values.to_pylist())) if x.is_valid else b"" for x in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(found, pa.binary())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(bytes_of, f"doc_id {kind}, ids array<int>, decoded binary")


def _sent(df: DataFrame, ranks_path: str) -> Broadcast:
    """The rank file, read by the driver and sent to the tasks."""
    with open(ranks_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def digests(decoded: DataFrame) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
