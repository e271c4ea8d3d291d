"""The training-data pipeline: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage gets the documents that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ostinato.llm import common, decontam, nearcopies, packing, pii, toxicity
from ostinato.llm.queries import read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; learned from the labels of training folds.

    Null and empty texts have what the bias gives, and stay where most labels are 0; very long texts are
    scored whole; repeated rows go or stay together; an empty table stays empty; other columns are passed on.
    """
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates by SimHash (five-word shingles, 0.8).

    Null and empty texts are one group; very long texts count with all their shingles; of rows with one id and
    text one stays, of equal ids with unlike texts each; ties at 0.8 are near; an empty table stays empty; other columns are passed on.
    """
    return nearcopies.clean(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts have none and stay; very long texts are searched whole; repeated rows go or stay
    together; without items all stay; an empty table stays empty; other columns are passed on.
    """
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with `<KIND>` in place of personal data and n_chars to match.

    Null and empty texts stay as they are; very long texts are searched whole; of overlapping spans the first
    names the place; repeated rows are treated alike; an empty table stays empty; other columns are passed on.
    """
    return pii.redact(docs, size_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    Null and empty texts are the end id alone; very long texts are cut; repeated rows are documents of their own; equal
    lengths take any of the places that fit; an empty table has no pieces; other columns don't matter.
    """
    return packing.report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: No stage but decontamination can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each copy of them is deleted when the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        now: list[str] = []
        docs = common.written(stage(spark, docs, sf_dir), now)
        common.dropped(spark, before)
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
