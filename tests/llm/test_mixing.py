import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from starcellar.llm import tables
from starcellar.llm.mixing import in_order, mixed, mixture, source_targets
from starcellar.llm.tables import unfolded
from tests.llm.conftest import EXTRA, bag


def shared(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Targets by sharing what is left among the sources that can take more, one round after the other."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    target, rest, open_ = dict.fromkeys(order, Fraction(0)), share * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if most * sizes[s] <= rest * weight[s] / total]
        if not full:
            target.update({s: rest * weight[s] / total for s in open_})
            break
        target.update({s: Fraction(most * sizes[s]) for s in full})
        rest -= sum(most * sizes[s] for s in full)
        open_ -= set(full)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected(rows):
    """rows (doc_id, text, source) to rows (doc_id, source, size, source_size, target, copies)."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    target, number, found = shared(sizes), Counter(), []
    for doc_id, text, source in rows:
        digest = hashlib.md5((text or "").encode()).hexdigest()
        n = number[doc_id, source, digest]
        number[doc_id, source, digest] += 1
        name = f":{'' if doc_id is None else doc_id}:{digest}:{n}"
        drawn = int(hashlib.md5(name.encode()).hexdigest()[:8], 16)
        rate = target[source] / sizes[source] if sizes[source] else Fraction(0)
        copies = rate.numerator // rate.denominator
        copies += Fraction(drawn, 1 << 32) < rate - copies
        found.append((doc_id, source, words(text), sizes[source], float(target[source]), copies))
    return found


def sourced(texts):
    return [(i, t, [None, "b", "a", "é", "B"][n % 5] if n % 3 else "hot") for n, (i, t) in enumerate(texts)]


def frame(spark, rows):
    values = [(i, t, s, "en", 0, 1.5, "d", 7, "k", 3, "s", 9, 1) for i, t, s in rows]
    return spark.createDataFrame(values, f"doc_id long, text string, source string, lang string, n_chars long, {EXTRA}")


def test_against_plain_sharing(spark, texts):
    rows = sourced(texts)
    rows += [(7000 + i, "word " * 10, "tiny") for i in range(3)] + [(None, "", "none"), (None, "same", "hot"), (None, "same", "hot")]
    df = frame(spark, rows)
    got = mixture(df.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "copies")
    assert bag(got.collect()) == bag(expected(rows))


def test_targets_stop_at_twice_the_source(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 5, "e": 0, None: 200}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: Fraction(int(r.part), int(r.whole)) for r in source_targets(rows).collect()}
    assert got == shared(sizes)
    assert sum(got.values()) == Fraction(3, 2) * sum(sizes.values()) and got["a"] == 20


def test_all_sources_stop(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 20)], "source string, size long")
    got = {r.source: Fraction(int(r.part), int(r.whole)) for r in source_targets(rows, share=(5, 2)).collect()}
    assert got == {"a": 20, "b": 40}


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 7}") for i in range(8000)] + [(1, "same row here", "s1")] * 5000
    got = mixture(frame(spark, rows).repartition(6)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert r.copies <= 2
    assert all(abs(taken[s] - target[s]) < 0.03 * target[s] for s in target)


def test_the_mix_holds_the_copies(spark, texts):
    rows = sourced(texts) + [(5, "many rows alike", "hot")] * 9
    df = frame(spark, rows)
    held = Counter()
    for (doc_id, text, source), row in zip(rows, expected(rows)):
        held[doc_id, source, text or ""] += row[-1]
    got = mixed(df).collect()
    assert Counter((r.doc_id, r.source, r.text or "") for r in got) == +held
    of = defaultdict(list)
    for r in got:
        of[r.doc_id, r.source, r.text or ""].append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in of.values())


def test_same_result_however_dealt(spark, texts):
    df = frame(spark, sourced(texts))
    assert bag(mixture(df).collect()) == bag(mixture(df.repartition(7, "lang")).collect())
    assert bag(mixture(df, seed="x").collect()) != bag(mixture(df).collect())


def test_order_of_names(spark):
    names = [None, "", "a", "B", "é", "zz", "z", "\U0001f600", "￿"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").repartition(4)
    got = {r.name: r.place for r in in_order(rows, "name").collect()}
    want = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    assert got == {n: i for i, n in enumerate(want)}


def test_unfolding_in_steps(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10), ("d", 25), (None, 3)], "name string, many long")
    got = Counter((r.name, r.n) for r in unfolded(rows, "many", "n", step=10).collect())
    assert got == Counter((n, i) for n, c in [("a", 0), ("b", 1), ("c", 10), ("d", 25), (None, 3)] for i in range(c))


def test_empty(no_docs):
    assert mixture(no_docs).collect() == []
    assert mixed(no_docs).collect() == []


def test_native(docs):
    plan = mixture(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and tables.STEP == 65536
    assert mixture(docs).agg(F.count("*")).first()[0] == docs.count()
