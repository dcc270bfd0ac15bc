"""The corpus pipeline: toxicity, line dedup, near-duplicate documents, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and reads it
again as the next stage's input. All stages but the last return the columns of ``documents``, and any extra ones.

Defined results of every stage: rows with a null id or a null or empty text are kept (the encoding has no ids for them); rows that
share an id are judged as one document by line dedup, near dedup and decontamination and row by row by toxicity; repeated rows
with one id stay repeated; of equal documents and lines the one with the smallest id (null first among lines) stays; very long
texts are read whole; an empty table gives an empty one; columns whose names clash with inner ones are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smoothspan.llm.chunk_bpe import digest_documents
from smoothspan.llm.containment import drop_contaminated
from smoothspan.llm.lexicon_automaton import drop_toxic, fit_toxicity
from smoothspan.llm.line_join import drop_duplicate_lines
from smoothspan.llm.registry import vocabulary_path
from smoothspan.llm.scratch import cut
from smoothspan.llm.super_minhash import keep_one_of_each


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 1/2 by the model learned from the labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit_toxicity(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match earlier lines; copies of which no line is left go."""
    return drop_duplicate_lines(docs, drop_emptied=True).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the kept texts."""
    return digest_documents(docs, vocabulary_path())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: No stage before the last can be left out and the learned stages have no SQL form; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
