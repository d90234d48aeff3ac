"""Mixing sources to target weights: repetition rates from sums a source, documents repeated by whole and drawn copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcellar.llm.tables import stored, unfolded

WEIGHTS = (3, 1, 2)  # of the sources in their order, repeating
SHARE = (3, 2)  # words that the mix takes against all words, as a fraction
MOST = 2  # copies of a document at most
DRAWS = 1 << 32  # a draw is a whole number below this
EXACT = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Stretches without blank, tab, line feed, vertical tab, form feed and carriage return; of a missing text none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def in_order(rows: DataFrame, column: str) -> DataFrame:
    """The rows with ``place``, counted from 0 in the order of ``column``, missing ones last.

    Ranges of the order are dealt out and numbered apart; only their sizes meet in one place.
    """
    ranges = stored(
        rows.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("range", F.spark_partition_id()), "in-order")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("range").agg(F.count("*").alias("size")).select(
        "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col(column).asc_nulls_last()))
    return ranges.withColumn("inside", inside).join(starts, "range").select(
        *rows.columns, (F.col("start") + F.col("inside") - 1).alias("place"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE,
                   most: int = MOST) -> DataFrame:
    """Rows (source, source_size, part, whole) from rows (source, size): a source's target is part / whole words.

    Sources in the order of their names by code point, the missing one last, get the weights in turn, and split
    ``share`` of all words by weight.  A target stops at ``most`` times its source's words; the excess is shared again
    by weight among the others, until none is above.  A source without words has target 0.

    Every number is whole, so targets are exact.  A round of sharing is one sum over the stored sources, of which the
    driver sees two totals; a round in which no further source stops is the last.
    """
    summed = in_order(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(summed.select("source", "source_size", weight.cast(EXACT).alias("weight")), "sources")
    limit = F.col("source_size").cast(EXACT) * F.lit(most).cast(EXACT)
    totals = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, part, whole = share[0] * (totals["size"] or 0), 0, 1

    def stops() -> Column:
        """Whether the limit is not above weight * part / whole."""
        return limit * F.lit(whole).cast(EXACT) <= F.col("weight") * F.lit(part).cast(EXACT)

    rest, open_weight = budget, share[1] * int(totals["weight"] or 0)
    while open_weight and rest * whole != part * open_weight:
        part, whole = rest, open_weight
        row = sources.agg(F.sum(F.when(stops(), limit)).alias("held"),
                          F.sum(F.when(~stops(), F.col("weight"))).alias("weight")).first()
        rest, open_weight = budget - share[1] * int(row["held"] or 0), share[1] * int(row["weight"] or 0)
    return sources.select(
        "source", "source_size",
        F.when(stops(), limit).otherwise(F.col("weight") * F.lit(part).cast(EXACT)).cast(EXACT).alias("part"),
        F.when(stops(), F.lit(1)).otherwise(F.lit(whole)).cast(EXACT).alias("whole"))


def repetition_rates(targets: DataFrame) -> DataFrame:
    """Rows (source, source_size, target, base, odds): a document is taken ``base`` times, once more if it draws below ``odds``."""
    return (
        targets.withColumn("size", F.col("whole") * F.col("source_size").cast(EXACT))
        .withColumn("base", F.when(F.col("size") > 0, F.expr("part div size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", (F.col("part") - F.col("base").cast(EXACT) * F.col("size")) * F.lit(DRAWS).cast(EXACT))
        .select(
            "source", "source_size", (F.col("part").cast("double") / F.col("whole").cast("double")).alias("target"), "base",
            F.when(F.col("size") > 0, F.expr("(rest + size - 1) div size")).otherwise(F.lit(0)).cast("long").alias("odds"))
    )


def draw(*parts: Column) -> Column:
    """A whole number below ``DRAWS`` from the text of the parts, the same in every run."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST,
            seed: str = "", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row (doc_id, source, digest, n, size, source_size, target, copies) for each document.

    ``size`` counts the text's words, ``copies`` is how often the mix takes the document: the whole part of its
    source's target / source_size, and one more with the probability of the fraction, by a draw from the MD5 of seed,
    id, text and ``n``.  Runs agree, whatever the order of rows.

    Rows alike in id, text and source are told apart by ``n``, their number among each other, so that they draw apart;
    they are counted and unfolded in steps, and no group of them meets in one task.  A missing text has no words; a
    missing source is one of its own, a missing id draws as an empty one.  Other columns are not looked at; an empty
    table gives an empty result.  Texts are read once; what is joined and shuffled afterwards are ids and numbers.
    """
    body = F.col(text).cast("string")
    rows = stored(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(body).alias("size"),
        F.md5(F.coalesce(body, F.lit("")).cast("binary")).alias("digest")), "mixing")
    rates = stored(repetition_rates(source_targets(rows, weights, share, most)).withColumnRenamed("source", "of"), "rates")
    counted = rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("rows"))
    drawn = draw(F.lit(seed), F.col("doc_id"), F.col("digest"), F.col("n"))
    return (
        unfolded(counted, "rows", "n").join(rates, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", F.col("base") + (drawn < F.col("odds")).cast("long"))
        .select("doc_id", "source", "digest", "n", "size", "source_size", "target", "copies")
    )


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST,
          seed: str = "", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: rows (doc_id, source, text, copy), a document as often as ``mixture`` says.

    Rows alike in id, text and source come as often as all of them together are taken, numbered by ``copy`` from 0.
    The texts are joined to the copies of their id and digest; of rows alike one text is sent.
    """
    key = ["doc_id", "source", "digest"]
    taken = stored(
        mixture(docs, weights, share, most, seed, doc_id, text, source).groupBy(*key)
        .agg(F.count("*").alias("alike"), F.sum("copies").alias("copies")).where("copies > 0")
        .select(*(F.col(k).alias(f"{k}_of") for k in key), "alike", "copies"), "mixture")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    keyed = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    match = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in key]
    found = keyed.join(taken, match).select(*key, "text", "alike", "copies")
    alone = found.where("alike = 1").select("doc_id", "source", "text", "copies")
    repeated = found.where("alike > 1").groupBy(*key, "copies").agg(F.first("text").alias("text")).select(
        "doc_id", "source", "text", "copies")
    return unfolded(alone.unionByName(repeated), "copies", "copy")
