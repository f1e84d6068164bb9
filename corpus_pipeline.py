"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.llm.common import fresh, table, text_key, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    A null or empty text has no grams, so the model's bias decides on it; equal texts go or stay together, whatever
    their ids. A null id has no label. Texts of any length are scored whole. No rows give no rows; all columns
    stay as they are."""
    from stratagrid.llm.nbsvm import keep, train

    return keep(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked on five-word shingles at 0.8, that with the smallest doc_id.

    Rows that are not linked stay, also where they repeat the doc_id of one that is. Null ids come last where one is
    chosen; of rows equal in id and text any one stays. Null and empty texts are linked with nothing and all stay.
    Texts of any length are compared by their full sets. No rows give no rows; all columns stay."""
    from stratagrid.llm.near_dup import one_of_each

    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold ten consecutive words of a benchmark item; others that repeat their doc_id stay.

    Rows equal in id and text go or stay together. Null and empty texts stay. Texts of any length are searched whole.
    No rows give no rows; all columns stay, whatever their names."""
    from stratagrid.llm.positional_index import contamination

    found = contamination(docs, table(spark, sf_dir, "benchmark"), keyed=True)
    gone, key = fresh(docs, "gone"), fresh(docs, "text_key")
    named = found.where("contaminated").select(F.col("doc_id").alias(gone), F.col("text_key").alias(key)).distinct()
    return docs.join(named, docs["doc_id"].eqNullSafe(named[gone]) & (text_key(docs["text"]) == named[key]), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars is counted anew, other columns and null texts stay.

    Every row stays, repeated ones too; equal texts become equal texts. Overlapping spans become one, of the first
    kind. Texts of any length are read whole, in time in proportion to it. No rows give no rows."""
    from stratagrid.llm.skip_chain import learn, redact

    return redact(docs, learn(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens; a row for each piece with its token ids.

    A null or empty text is the end id alone. Rows that repeat an id are documents of their own. Pieces of one length
    are interchangeable. Texts of any length are cut whole. No rows give no rows; other columns are not read."""
    from stratagrid.llm.packing import pack_documents

    return pack_documents(docs, ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: A model, links found by hashing and a packing plan have no SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
