"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's docs.

Quality drops the documents that the classifier rejects; near-duplicates leaves one document of each group (five words,
similarity 0.8); private data is masked; the sources are mixed to their target weights; what is left is packed.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import mixing, near_duplicates, packing, private_data, quality
from corvane.llm.common import materialize, table
from corvane.llm.queries import tokenizer_path

SIMILAR = Fraction(80, 100)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labels table, accepts, whole.

    Null and empty texts are scored as empty ones, very long ones whole; repeated rows go or stay alike; without labels of
    both kinds all stay; an empty table gives an empty one; columns of any other names are kept.
    """
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, whole: that of least doc_id (null last).

    Texts without words, null ones too, are in no group and stay; of rows alike in id and text one stays; very long texts are
    compared whole; an empty table gives an empty one; columns of any other names are kept.
    """
    return near_duplicates.keep_first(docs, SIMILAR).select(*docs.columns)


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked and n_chars, where there is one, counted anew.

    Null texts stay null with their n_chars; repeated rows stay; very long texts are masked whole; an empty table gives an empty
    one; columns of any other names are kept.
    """
    masked = private_data.mask_documents(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, whole, as often as its source's target takes it: none, one or two times; rows without words once.

    A null source is one of its own; repeated rows are drawn each; an empty table gives an empty one; columns of any other
    names are kept.
    """
    return mixing.draw_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each row of docs, in sequences of at most 2048 tokens.

    Null and empty texts are their end id alone; very long ones are cut into many pieces; repeated rows are packed each; an
    empty table gives an empty one; other columns are dropped.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("private_data", private_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A classifier, the sketches, the field and the packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
