"""From raw documents to a training mix: five stages, each one operator of ``lanternlog.llm``.

Every stage works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanternlog import session
from lanternlog.llm import decontaminate, jaccard_join, mixing, pii, quality
from lanternlog.llm.tables import remove, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.pin(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep(docs, _table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard_join.representatives(docs, words=5, percent=80)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not repeat the benchmark."""
    return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document goes into a mix of the target weights."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", accept),
    ("near_duplicates", one_of_each),
    ("decontamination", unseen),
    ("pii", masked),
    ("mixing", mixed),
]

#: The classifier cannot be said in SQL; the stages are tested one by one and as a whole.
ORACLE_SQL: str | None = None


def _folder(table: DataFrame) -> str | None:
    """Where a written table lies; an empty one may have no files."""
    files = table.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; what a stage read is removed once it is written."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = _folder(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
