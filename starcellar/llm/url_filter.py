"""Allow and block rules over URLs by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcellar.llm.tables import ascii_lower

PREFIX_DIGITS = 8  # hex digits of the digest that the join compares: 32 bits
SENT_RULES = 100_000  # rule tables up to this size are sent to every task; larger ones are shuffled by the prefix
RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table; large rule sets are read as a table of the same columns."""
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """One row (page_id, host, path, rule, verdict) for each page.

    Every URL becomes one expression for each suffix of its host at a dot and each prefix of its path.  Expressions
    meet the rules by the first 32 bits of their SHA-256; of these candidates only equal digests count.  A rule fits
    its host and all subdomains if the path starts with the rule's path.  The longest rule (host and path together)
    wins, then the longer host, then ``block``, then the smaller text.  Without a rule the verdict is ``default``.

    Only prefixes and suffixes as long as some rule's are made: others cannot fit.  A prefix of a length that only
    rules ending in ``/`` have must end in ``/`` itself.  The lengths are whole numbers up to the longest rule.

    Missing URLs and URLs without ``://`` have an empty host and path and fit no rule.  Rules with a missing host or
    path are left out, repeated rules count once.  Equal URLs are judged once, so repeated rows cost one comparison
    and come back as often as they were given; other columns of either table are not looked at.
    """
    rules = rules.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"),
    ).where("rule_host IS NOT NULL AND rule_path IS NOT NULL").distinct()
    lengths = rules.agg(
        F.count("*").alias("rules"),
        F.collect_set(F.length("rule_host")).alias("hosts"), F.collect_set(F.length("rule_path")).alias("paths"),
        F.collect_set(F.when(~F.endswith("rule_path", F.lit("/")), F.length("rule_path"))).alias("open_paths"),
    ).first()
    listed = rules.withColumn("digest", F.sha2(F.concat("rule_host", "rule_path"), 256)).withColumn(
        "short", F.left("digest", F.lit(PREFIX_DIGITS)))
    listed = F.broadcast(listed) if lengths["rules"] <= SENT_RULES else listed

    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    urls = pages.where("url IS NOT NULL").select("url").distinct()
    expressions = (
        urls.withColumns({"url_path": path_of(F.col("url")), "labels": F.split(host_of(F.col("url")), r"\.")})
        .withColumn("label", F.explode(F.sequence(F.lit(1), F.size("labels"))))
        .withColumn("suffix", F.array_join(F.slice("labels", F.col("label"), F.size("labels")), "."))
        .where(F.length("suffix").isin(lengths["hosts"]))
        .withColumn("cut", F.explode(F.filter(_numbers(lengths["paths"]), lambda n: n <= F.length("url_path"))))
        .withColumn("prefix", F.substr("url_path", F.lit(1), F.col("cut")))
        .where(F.endswith("prefix", F.lit("/")) | F.col("cut").isin(lengths["open_paths"]))
        .select("url", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"), "suffix", "prefix")
        .withColumn("short", F.left("digest", F.lit(PREFIX_DIGITS)))
    )
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").alias("blocks"), F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    found = (
        expressions.join(listed, "short")
        .where((expressions["digest"] == listed["digest"]) & (F.col("suffix") == F.col("rule_host")))
        .groupBy("url").agg(F.max(rank).alias("best"))
    )
    return pages.join(found, "url", "left").select(
        "page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def _numbers(values: list[int]) -> Column:
    return F.array(*(F.lit(v) for v in sorted(values))) if values else F.array().cast("array<int>")
