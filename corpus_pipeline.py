"""The corpus cleaned and tokenised in five stages, each a job that reads what the stage before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starcellar.llm.bpe import decode, digests, encode
from starcellar.llm.decontaminate import without_leaks
from starcellar.llm.queries import PATTERN, RANKS
from starcellar.llm.secret_scan import mask_secrets
from starcellar.llm.simhash import one_of_each
from starcellar.llm.tables import stored, table
from starcellar.llm.toxicity import lexicon_from, without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon calls toxic go."""
    return without_toxic(docs, lexicon_from(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group within three bits stays."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_found_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return mask_secrets(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded texts."""
    return digests(decode(encode(docs, RANKS, PATTERN), RANKS))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_found_secrets),
    ("byte-level bpe", tokenise),
]

ORACLE_SQL = None  # fingerprints, the learnt lexicon and the tokens are beyond SQL; tests hold each stage to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; what a stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
