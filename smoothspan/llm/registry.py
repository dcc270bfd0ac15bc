"""The queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smoothspan.llm import containment, line_join, quote_links, super_minhash, temporal_lists
from smoothspan.llm.chunk_bpe import digest_documents
from smoothspan.llm.containment import contained_items
from smoothspan.llm.feistel_pii import pseudonymise
from smoothspan.llm.lexicon_automaton import fit_toxicity, score_documents
from smoothspan.llm.line_join import LineSettings, line_report
from smoothspan.llm.paragraph_iblt import version_fingerprints
from smoothspan.llm.quote_links import link_conversations
from smoothspan.llm.super_minhash import near_duplicates
from smoothspan.llm.temporal_lists import demo_captures, demo_entries, temporal_join
from smoothspan.llm.zstd_language import fit_dictionaries, identify_languages

#: The key of the registered query; a deployment passes its own.
DEMO_KEY = b"smoothspan demonstration key"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fold(buckets: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % buckets


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"), DEMO_KEY)


def op3_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_documents(spark, sf_dir), LineSettings(short_lines=True))


def op4_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return temporal_join(demo_captures(pages), demo_entries(pages))


def op5_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = identify_languages(docs, fit_dictionaries(docs.where(_fold(4) != 2)))
    return found.select("doc_id", (F.coalesce(_fold(4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op7_paragraph_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_fingerprints(_documents(spark, sf_dir))


def op8_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_documents(spark, sf_dir))
    kept = F.coalesce(F.col("node") == F.col("component_id"), F.lit(True))
    return found.select(F.col("node").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def op9_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score_documents(docs, fit_toxicity(docs, labels.where(_fold(5) != 0)))
    return found.select(
        "doc_id",
        (F.coalesce(_fold(5), F.lit(1)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "abusive",
        "misspelled",
        "quoted",
    )


def op10_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(_documents(spark, sf_dir), vocabulary_path())


QUERIES = (
    op1_quote_links,
    op2_feistel_pseudonyms,
    op3_line_join,
    op4_temporal_lists,
    op5_containment,
    op6_zstd_language,
    op7_paragraph_iblt,
    op8_super_minhash,
    op9_lexicon_toxicity,
    op10_chunk_bpe,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quote_links": quote_links.ORACLE_SQL,
        "op3_line_join": line_join.ORACLE_SQL,
        "op4_temporal_lists": temporal_lists.ORACLE_SQL,
        "op5_containment": containment.ORACLE_SQL,
        "op8_super_minhash": super_minhash.ORACLE_SQL,
    }
