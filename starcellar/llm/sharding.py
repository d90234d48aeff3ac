"""Shards of nearly equal bytes: groups of equal texts stay together, the largest goes first to the emptiest shard."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from starcellar.llm.tables import stored, unfolded

BINS = 4096  # units that the light groups are gathered in; bounds what the driver sees
CELL_ROWS = 65536  # rows numbered by one window


def least_loaded(sizes: dict, shards: int) -> dict:
    """Unit to shard: units by falling size (ties by key) go to the shard with the least so far (ties: the first)."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for unit, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text",
                    bins: int = BINS) -> DataFrame:
    """One row (doc_id, size, text_crc32, law, shard, slot, grown_shard) for each document.

    Law ``bytes``: sizes of shards are near equal.  ``size`` is the text's UTF-8 bytes plus 1, ``slot`` numbers a
    shard's documents from 0 without gaps.  ``grown_shard`` belongs to another law and is always NULL.

    Documents with equal texts are one group and share a shard.  A group above 1 / ``bins`` of all bytes is a unit of
    its own (fewer than ``bins`` of them exist); the others fall into ``bins`` units by the digest of their text.  The
    driver schedules these at most 2 * ``bins`` units, whatever the size of the corpus, longest first.

    A missing text is a group of its own kind with size 1 and crc32 0, apart from empty texts.  Rows repeated in all
    output columns are counted, numbered by the sum of counts and unfolded again, so no group of them meets in one
    task.  Other columns are not looked at.  An empty table gives an empty result.  Texts are read once: ids, sizes and
    digests go to the shared folder, and the later passes read those.
    """
    body = F.coalesce("body", F.lit(b""))
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("body")).select(
        "doc_id", (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"),
        F.coalesce(F.sha2("body", 256), F.lit("")).alias("digest"),
    ), "sharding")
    bin_of = F.pmod(F.xxhash64("digest"), F.lit(bins)).cast("int")
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("members")), "groups")
    totals = groups.agg(F.sum("bytes").alias("bytes"), F.sum("members").alias("members")).first()
    limit, members = (totals["bytes"] or 0) / bins, totals["members"] or 0
    heavy = {r["digest"]: r["bytes"] for r in groups.where(F.col("bytes") > limit).select("digest", "bytes").collect()}
    light = {r["bin"]: r["bytes"] for r in groups.where(F.col("bytes") <= limit).groupBy(bin_of.alias("bin"))
             .agg(F.sum("bytes").alias("bytes")).collect()}
    placed = least_loaded({**{f"bin {b:08d}": n for b, n in light.items()}, **heavy}, shards)

    spark = docs.sparkSession
    alone = spark.createDataFrame([(d, placed[d]) for d in heavy], "digest string, heavy_shard int")
    of_bin = spark.createDataFrame([(b, placed[f"bin {b:08d}"]) for b in light], "bin int, bin_shard int")
    cells = max(1, -(-members // CELL_ROWS))
    outcome = ["doc_id", "size", "text_crc32", "shard"]
    counted = (
        rows.join(F.broadcast(alone), "digest", "left")
        .withColumn("bin", bin_of).join(F.broadcast(of_bin), "bin", "left")
        .withColumn("shard", F.coalesce("heavy_shard", "bin_shard"))
        .groupBy(*outcome).agg(F.count("*").alias("copies"))
        .withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(cells)))
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("shard", "cell").agg(F.sum("copies").alias("held")).select(
        "shard", "cell", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32").rowsBetween(
        Window.unboundedPreceding, -1)
    begin = F.col("first") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    numbered = counted.join(starts, ["shard", "cell"]).withColumn("begin", begin)
    return unfolded(numbered, "copies", "n").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("n")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
