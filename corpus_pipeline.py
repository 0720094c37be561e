"""Documents to a deduplicated, mixed and encoded training corpus.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.llm import catalog, factorisation, mixing, sentencepiece_lattice, simhash, suffix_dedup
from stationcast.session import prepare_session, stage

#: Repeated passages of this many bytes lose their later copies: about fifty short words.
PASSAGE_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    machine = catalog.quality_machine(spark, sf_dir, docs)
    kept = factorisation.score(docs, machine, name="quality_score").filter(F.col("quality_score") >= catalog.ACCEPT)
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike by 0.8 or more on five-word shingles.

    SimHash groups, judged by exact similarity; then the alike pairs that the fingerprints leave apart.
    """
    return simhash.keep_one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of long passages; ``n_chars`` follows the text."""
    cut = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES, keep_first=True)
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents come as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the check that they decode to the text."""
    return catalog.encoded_documents(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The classifier's fit and the fingerprints have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stored and read again for the next."""
    docs = prepare_session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
