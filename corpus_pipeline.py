"""A training corpus from raw documents: five stages, each on all its predecessor kept.

quality classifier -> near-duplicates -> repeated passages -> secrets -> packing.
Every stage but the last returns the columns of ``documents``; each result is
written as Parquet in the shared folder and read again as the next stage's input.

Defined results: null and empty texts are scored as any other, are near nothing and
hold no passage or secret; if the classifier keeps them, they pass and are packed as one
end token. Of the rows of one id, which count as one document from the second stage on, the
smallest by the columns in order stays. Rows with a null id are never merged. Of equal or near
documents, and of a passage's copies, the smallest id stays. An empty table gives no pieces. Columns
beside those of ``documents`` are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearprose.llm import near_dedup, packing, quality, secrets, substring_dedup
from clearprose.llm.tables import Workspace, once, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows a changed text."""
    return docs.select(*COLUMNS[:-1], F.length("text").cast("long").alias("n_chars"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted without the held-out fifth of labels, doesn't reject."""
    labels = quality.training_labels(read_table(spark, sf_dir, "labels"))
    model = quality.train(quality.training_documents(docs), labels)
    return _columns(quality.score(docs, model).filter("predicted = 1"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates, once; rows without an id stay."""
    verdicts = near_dedup.near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    verdicts = Workspace(spark, "pipeline").written(verdicts.filter("kept").select("doc_id", "n"), "verdicts")
    repeated = verdicts.filter("n > 1").select("doc_id")
    kept = docs.join(verdicts.select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)
    return _columns((kept if repeated.isEmpty() else once(kept, "doc_id", repeated)).unionByName(docs.filter("doc_id is null").select(*COLUMNS)))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All but the first copy of each repeated passage cut; what loses all its words goes."""
    return _columns(substring_dedup.without_passages(docs, substring_dedup.repeated_passages(docs)))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret replaced by a mark."""
    return _columns(secrets.SecretScan(docs).redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each_group),
    ("substring dedup", without_repeats),
    ("secret scan", without_secrets),
    ("packing", packed),
]

#: A classifier and a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = read_table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = work.written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
