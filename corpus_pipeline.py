"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and handles what its operator's
docstring defines: nulls, empty and very long texts, ties, repeated rows, empty
tables, and extra columns, which pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.llm import contamination, jaccard, language, line_dedup, packing, shared


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those of which no language has half the words; without labelled rows, none."""
    model = language.train(docs.where(language.training()))
    if model is None:
        return docs
    kept = language.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5))
    return kept.select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated three-line windows; a document that loses all its lines goes."""
    out = line_dedup.dedup_lines(docs).where(F.size("removed") < F.greatest("n_lines", F.lit(1)))
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.size("removed") > 0, size).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, one stays: that of the least id, where ids are unique."""
    return jaccard.keep_one(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents of whose words a twentieth or more lie in benchmark passages."""
    return contamination.decontaminate(docs, shared.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    return packing.pack(docs)


STAGES = [("language", identify_language), ("line dedup", dedup_lines), ("near duplicates", dedup_documents), ("decontamination", decontaminate), ("packing", pack)]

#: Tokenisation and trained language scores have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
