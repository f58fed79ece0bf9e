"""From raw documents to encoded training text, in five stages.

Each stage takes the documents that the one before it kept, all of them, and returns documents
with the same columns (the mixture adds ``copy``); the last returns their pieces. ``run`` writes each stage's result to the
shared folder and reads it back for the next, so that a lost executor costs tasks, not stages. What the last stage
does not read is removed at the end.

Defined results: each stage says what null texts, null ids, repeated rows and empty tables give. Any column
may be null. Extra columns of documents, of any name but ``copy``, pass through all stages but the last.
An empty table gives an empty one in each stage, with its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import mixing, neardup, pieces, pii, quality
from tallymark.llm.queries import tokenizer
from tallymark.llm.store import settle, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects.

    A null text has no words and goes, as an empty one does. Repeated rows are judged alike and all stay or all go. Ids are not looked at.
    """
    return quality.keep(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, null ids last.

    Rows that share an id are one document: one of them stays, that with the longest text. Rows with a null id are
    documents of their own, and stay unless they are copies of others. Texts without words are no copies of each other.
    """
    return neardup.keep_one(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars follows the text.

    A null text stays null, with a null n_chars. Repeated rows get equal surrogates. Ids are not looked at.
    """
    return pii.replace(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, with the number of each copy.

    A null source is a source of its own. A null text has size 0; it is repeated as its source is. Rows with one id, or null ids, are taken alike.
    """
    return mixing.repeat(docs, copy_col="copy")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, ids, lossless.

    A null text has no pieces. Copies of a document are drawn each by itself; rows that share id and copy number are drawn alike.
    """
    return pieces.encode(docs, tokenizer("piece_bpe_32k.model"), carry=("lang", "source"), copy_col="copy")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("surrogates", surrogates),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: Keyed hashes, signatures and the vocabulary are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary() as keep:
        for name, stage in STAGES[:-1]:
            with temporary() as keep_stage:
                docs = keep_stage(settle(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        return keep(STAGES[-1][1](spark, docs, sf_dir), docs)
