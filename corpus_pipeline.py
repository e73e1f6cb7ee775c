"""The training-data pipeline: language, near duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last keep the columns of docs,
extra ones too, whatever their names. An empty table gives an empty table in every stage.
Packed rows of a document that mixing repeats are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidence_spark.llm.common import cut, table
from evidence_spark.llm.jaccard import keep_one_of_each
from evidence_spark.llm.langid import fit_langid, keep_known_language
from evidence_spark.llm.mixing import mix_sources, plan_mix
from evidence_spark.llm.packing import pack_documents
from evidence_spark.llm.pii import fit_pii, redact_pii

#: Words that a packing task remembers: fewer than alone, as executors have served other stages.
KNOWN_WORDS = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language the nearest-centroid model rejects.

    Null and empty texts, and those without a letter, are rejected, and so is every row
    where no row has a known lang to learn from. A null doc_id, lang or source is no
    reason to go. Repeated rows fare alike; long texts are read whole.
    """
    return keep_known_language(docs, fit_langid(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates.

    Of rows that repeat it one stays. Null and empty texts, and rows without a doc_id, are
    in no group and stay.
    """
    return keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by tags; every row stays.

    Null texts stay null. n_chars follows the new text. Repeated rows get the same text.
    """
    return redact_pii(docs, fit_pii(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources reach their target weights.

    Rows without a source are one source; a null or empty text counts one token. Rows that
    repeat a doc_id, or lack one, stay together.
    """
    return mix_sources(docs, plan_mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack token sequences of at most 2048.

    A null or empty text is the end id alone; repeated rows are packed as often as they occur.
    """
    return pack_documents(docs, known_words=KNOWN_WORDS, keep_words=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fitted classifiers, hash orders and local search have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each stage's rows are written between."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
