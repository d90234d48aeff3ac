import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "se", "ti", "vo") for c in ("", "n", "s", "lle")]
EXTRA = "score double, digest string, bits long, key string, block int, spans string, root long, label int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
CLASHING = (1.5, "d", 7, "k", 3, "s", 9, 1)


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def corpus():
    """Ids and texts: copies, near copies, shared passages, white space, nothing, one very long text, repeated rows."""
    draw = random.Random(11)
    shared, long = sentence(draw, 40), sentence(draw, 30_000)
    rows = [(i, sentence(draw, draw.randint(0, 120))) for i in range(40)]
    rows += [(40 + i, f"{sentence(draw, 20)} {shared}\n{sentence(draw, 15)}") for i in range(12)]
    rows += [(60 + i, rows[30][1]) for i in range(6)]
    rows += [(70 + i, f"{rows[45][1]} {WORDS[i]}") for i in range(6)]
    rows += [(80, None), (81, ""), (82, " \n\t "), (83, "one two"), (84, "ONE  Two"), (85, long), (86, "x" * 70_000)]
    rows += [(None, rows[41][1]), (None, None), (5, rows[5][1]), (5, rows[5][1]), (85, long), (81, None), (30, "other text")]
    rows += [(90, "naïve café 漢字 \u00a0 \u2003 \U0001f600 don't you'll 123 ..."), (91, "a\u0000b \x1c c\u200d")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *CLASHING) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: frame(spark, rows)


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)
