"""The training-data pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes documents with any further columns, whatever their names, and gives no rows for an empty
table.  What each does with nulls, empty texts and ties stands in its docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import line_dedup, mixing, piece_bpe, quality, simhash
from lodestrata.llm.common import stage, table
from lodestrata.llm.queries import piece_model


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays within the bound of their language's trusted documents.  Null and empty
    texts go; a null lang is a language of its own; repeated rows are judged alike and all stay or go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur, exactly or nearly, in an earlier place.  Null and empty texts stay as
    they are; a null doc_id comes before all others; repeated rows are one document and stay together."""
    return line_dedup.without_repeats(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that of the smallest doc_id; of repeated rows one stays.  Null and
    empty texts are one group; a null doc_id stays only where its group has no other."""
    return simhash.keep_first(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources in the order of its schedule; documents taken in both passes stand twice.
    Documents without words are in no mix; a null source is one of its own; repeated rows count one by one."""
    return mixing.mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the text decoded from them, of each row; null counts as empty."""
    tokens = piece_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), piece_model())
    return tokens.selectExpr("doc_id", "lang", "source", "cast(size(ids) as long) as n_tokens", "ids", "decoded as text")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", distinct_lines),
    ("SimHash near-dedup", distinct_documents),
    ("mixing sources", mixed_sources),
    ("SentencePiece encoding", encoded),
]
#: SQL can express neither perplexities nor the components of similar lines.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
