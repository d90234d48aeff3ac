import hashlib
import random

import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from starcellar.llm import bpe
from starcellar.llm.bpe import decode, digests, encode, encoded_long
from starcellar.llm.queries import PATTERN, RANKS
from tests.llm.conftest import bag, sentence


@pytest.fixture(scope="module")
def vocab():
    with open(RANKS, "rb") as file:
        return bpe.vocabulary(file.read(), PATTERN)


def test_against_the_library(docs, texts, vocab):
    want = []
    for i, t in texts:
        ids = vocab.library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert bag(digests(decode(encode(docs, RANKS, PATTERN), RANKS)).collect()) == bag(want)


def test_small_chunks(docs, texts, vocab):
    rows = encode(docs, RANKS, PATTERN, chunk=200, overlap=20).collect()
    assert bag((r.doc_id, r.ids) for r in rows) == bag((i, vocab.library.encode_ordinary(t or "")) for i, t in texts)


def test_stitching(vocab):
    draw = random.Random(6)
    pieces = ["a", "b", "  ", " ", "\n", "'", "'s", "'ll", "'ve", "1", "23", "!", "é", "漢", "\t", " ", "x" * 50, "!!" * 20, "   \n  ", " w"]
    apart = joined = 0
    for n in range(400):
        text = "".join(draw.choice([p[:n % 8 + 1] for p in pieces]) for _ in range(draw.randint(0, 200)))
        want = vocab.library.encode_ordinary(text)
        for chunk, overlap in ((16, 16), (40, 8), (64, 32)):
            parts = bpe.cut(text, chunk, overlap)
            found = bpe.stitch(bpe.encoded_chunk(p, vocab, chunk, overlap, i + 1 == len(parts)) for i, p in enumerate(parts))
            if found is None:
                apart += 1
                continue
            assert [i for ids in found for i in ids.tolist()] == want
            joined += len(parts) > 1
    assert apart > 50 and joined > 200


def test_texts_whose_chunks_do_not_meet(make_docs, vocab):
    rows = [(1, "x" * 70_000), (2, "x" * 70_000), (3, "y" * 40_000 + " plain words" * 300), (4, " " * 66_000), (5, "a b " * 10_000)]
    got = encode(make_docs(rows), RANKS, PATTERN).collect()
    assert bag((r.doc_id, list(r.ids)) for r in got) == bag((i, vocab.library.encode_ordinary(t)) for i, t in rows)


def test_characters_that_tables_disagree_on(vocab):
    assert bpe._newer("abc" + chr(0x88F)) and bpe._newer(chr(0x11DE0)) and not bpe._newer("naïve 漢字 \U0001f600")
    step, probe = 4001, [c for c in range(128, 0x110000, 1) if not 0xD800 <= c <= 0xDFFF]
    for c in probe[::step]:
        for text in (f"a{chr(c)}1", f" {chr(c)} {chr(c)}b"):
            assert vocab.ids(text).tolist() == vocab.library.encode_ordinary(text)


def test_pattern_tables_differ_only_where_the_library_decides():
    """A tokeniser that has each two-character text as one token shows which characters it takes for letters."""
    points = [c for c in range(0x250, 0x110000) if not 0xD800 <= c <= 0xDFFF and regex.match(r"\p{L}", chr(c))][::7]
    ranks = {bytes([b]): b for b in range(256)}
    for c in points:
        encoded = chr(c).encode()
        for part in (*(encoded[:n] for n in range(2, len(encoded) + 1)), b"a" + encoded):
            ranks.setdefault(part, len(ranks))
    library = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    differ = [c for c in points if len(library.encode_ordinary("a" + chr(c))) != 1]
    assert all(bpe._newer(chr(c)) for c in differ)


def test_empty(no_docs):
    assert decode(encode(no_docs, RANKS, PATTERN), RANKS).collect() == []


def test_copies_of_a_long_text_are_encoded_once(spark, make_docs, vocab):
    draw = random.Random(9)
    hot, other = sentence(draw, 9_000), sentence(draw, 8_000)
    rows = [(i % 25, hot) for i in range(40)] + [(None, hot), (None, hot), (50, other), (51, "short"), (52, None)]
    docs = make_docs(rows).repartition(4)
    long = docs.where("char_length(text) > 32768").selectExpr("sha2(cast(text AS binary), 256) AS digest", "text")
    holders = long.groupBy("digest").agg(F.collect_list(F.struct(F.lit(1).alias("doc_id"))).alias("rows"))
    once = encoded_long(long, holders, lambda: bpe.vocabulary(open(RANKS, "rb").read(), PATTERN), 32_768, 512).collect()
    assert len(once) == 2 and {r.digest for r in once} == {hashlib.sha256(t.encode()).hexdigest() for t in (hot, other)}
    assert sorted(len(r.rows) for r in once) == [1, 42]
    want = [(i, vocab.library.encode_ordinary(t or "")) for i, t in rows]
    assert bag((r.doc_id, list(r.ids)) for r in encode(docs, RANKS, PATTERN).collect()) == bag(want)
