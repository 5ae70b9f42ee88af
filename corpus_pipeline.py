"""From raw documents to packed training sequences, in stages that each read what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexifix.llm.common import read, written
from lexifix.llm.line_crf import good_documents, train
from lexifix.llm.line_rules import clean_documents
from lexifix.llm.mixing import poisson_mix
from lexifix.llm.near_copies import keep_one_of_similar
from lexifix.llm.packing import pack_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base rules and cross-document line frequency: rejected documents go, frequent lines go from the others.

    A line is frequent from ``MIN_DOCS`` distinct texts of its source on, however large the source is. Null and empty
    texts have no words, so they go; a null source is the source with the empty name; repeated rows are judged alike
    and all stay or go. An empty table stays empty, other columns pass through.
    """
    return clean_documents(docs, max_share=0.0)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores below one half go.

    The whole text is scored, whatever its length; null and empty texts have one score, that of a document without
    lines; equal texts have equal scores. Null ids match no label. An empty table stays empty, other columns pass through.
    """
    return good_documents(docs, train(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose 5-word shingles are similar to 0.8 stays, that with the smallest id.

    Null ids come last, equal ids go by the text's hash, and of rows equal in both one stays. Null and empty texts are
    one group. An empty table stays empty, other columns pass through.
    """
    return keep_one_of_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to square-root weights: documents repeated by Poisson counts, in a global shuffle.

    Texts aren't looked at. A null source is the source with the empty name, a null id hashes as the empty text, rows
    with equal ids have equal counts. An empty table stays empty, other columns pass through.
    """
    return poisson_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 4096 ids.

    Null and empty texts are their end id, long ones are cut over sequences; rows that share an id, repeated rows too,
    are packed each. An empty table gives no pieces; columns but id and text aren't read.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier, the fingerprints and the tokenizer aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
