"""The corpus pipeline: language, repeated lines, near-duplicates, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; ``run``
writes each stage's rows to the folder that executors share and reads them back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castline.llm.common import discard, scratch, stored, table
from castline.llm.language_id import fit, identify, lettered
from castline.llm.line_templates import drop_repeated_lines
from castline.llm.ngram_join import doc_key, near_duplicates
from castline.llm.packing import pack_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: those without a text or a letter go.

    A document is told by its id; rows without one are told by their text alone. Repeated rows
    stay repeated; an empty table stays empty; columns other than those of documents go. Without
    labels to learn from, all texts with a letter stay.
    """
    model = fit(docs)
    if model is None:
        return lettered(docs.select(*COLUMNS))
    return identify(docs, model, keep=COLUMNS).where("lang_pred != 'und'").select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs go from all documents but the first; so do documents with nothing left.

    A document that had no line to lose stays as it is; n_chars follows the text.
    """
    thin = drop_repeated_lines(docs.select(*COLUMNS))
    left = thin.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, by id, once; documents without words stay.

    A document is an id and a text: rows that agree in both are one, whatever their other columns
    hold, and documents that share an id are told apart by their texts. Rows without an id give way
    to those with one. Null and empty texts stay, each id once; an empty table stays empty; columns
    other than those of documents go.
    """
    first = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key")).distinct()
    named = docs.select(*COLUMNS, doc_key().alias("_doc_key"))
    kept = named.join(first, (named["_doc_key"] == first["_key"]) & named["doc_id"].eqNullSafe(first["_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_doc_key"]).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2048 tokens.

    Null and empty texts become a piece of the end token alone; rows without an id and repeated rows
    are packed like others; an empty table gives no pieces; columns other than doc_id and text are
    not read.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048)


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_shared_lines),
    ("ngram_join", keep_one_of_each_group),
    ("best_fit_packing", pack),
]

#: Kernels, template trees and token ids have no SQL form; tests hold each stage, on its own input, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; nulls, repeated rows and empty tables as each stage has it.

    A stage's rows are stored before the next one starts; what it stored on the way, and the rows
    of the stage before, are deleted then.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        rows = stage_rows(spark, stage, docs, sf_dir, name)
        discard(before)
        docs = before = rows
    return STAGES[-1][1](spark, docs, sf_dir)


def stage_rows(spark: SparkSession, stage, docs: DataFrame, sf_dir: str, name: str) -> DataFrame:
    """The rows of one stage, stored; the tables that it made on the way are gone."""
    with scratch(spark) as keep:
        return keep(stored(stage(spark, docs, sf_dir), name))
