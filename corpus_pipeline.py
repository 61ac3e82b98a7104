"""The corpus pipeline: quality filter, line dedup, document dedup, mixing and tokenization of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowwatch.llm import catalog, linededup, mixing, ngramjoin, quality, sentencepieces
from flowwatch.llm.workspace import Workspace, ship_code

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier rejects go."""
    ship_code(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of near-equal lines the first stays; documents that lose all their words go."""
    ship_code(spark)
    return linededup.without_emptied(docs)


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group stays; near copies reach a Jaccard of 0.8 on shingles of five words."""
    ship_code(spark)
    return ngramjoin.keep_one(docs, ngramjoin.JoinConfig(width=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents as often as the mix to target weights takes them."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents with their ids; the pieces' own bytes decode to the text again."""
    ship_code(spark)
    return sentencepieces.encode(docs, catalog.tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", tokenize),
]

#: Learned and iterative stages: SQL cannot express them; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again as the next one's input."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
