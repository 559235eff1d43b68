"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept, whole, and its decisions take
effect: documents without a language go, documents that a quality rule rejects
go, one document of each near-duplicate group stays, documents are repeated or
left out until sources have their target weights, and what remains is packed.

Every stage takes rows with nulls in any column, repeated rows (documents like
others), empty tables (no rows come out) and extra columns of any name, which
the first four keep as they are.  What stages write for themselves lies in the
shared folder until the driver ends, as long as their results read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import jaccard, langid, mixing, packing, quality
from lattica.llm.scratch import set_aside

#: Naive Bayes and the cube method have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None
#: Posterior probability below which a document has no language.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a language that the model is sure of.

    A null or empty text has no letter and goes; rows without a language or an id
    are judged like others; languages that tie go to the first by code point.
    """
    aside = set_aside(docs, ("doc_id", "text", "lang"))
    model = langid.train(aside.where(~langid.held_out(F.col("doc_id"), 4)))
    judged = aside.withColumn("judged", langid.predictor(aside, model))
    sure = judged.where((F.col("judged.lang_pred") != langid.UND) & (F.col("judged.score") >= SURE))
    return sure.select(*aside.columns).toDF(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs.

    A null text has no words and goes; a null language is a stratum of its own;
    with too few labels, or none, the base rules alone decide.
    """
    aside = set_aside(docs, ("doc_id", "text", "lang"))
    kept = quality.assess(aside, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("q_kept")
    return kept.select(*aside.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id, null last.

    Texts without words are in no class and all stay.
    """
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source, a null text has size 0 and is not taken."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of 2048 tokens; a null text is its end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
