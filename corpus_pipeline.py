"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing. Each stage works on all rows that the one
before kept and is stored before the next one starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonist.llm import decontam, dedup, lines, packing, quality
from canonist.llm.common import Scratch, merge, table
from canonist.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.classify(docs).filter("__keep").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds go; documents left without text too."""
    return lines.dedup_lines(docs).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id stays. Five-word shingles, similarity 0.8; with 40
    bands a pair at 0.8 shares fewer than two of them with a chance below 1 in 10,000."""
    return dedup.near_duplicates(docs, width=5, link=(80, 100), bands=40).filter("__keep").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    told = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct()
    same = docs["doc_id"].eqNullSafe(told["__d"]) & (F.xxhash64(docs["text"]) == told["__h"])
    return docs.join(merge(told), same, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    out = packing.pack_documents(docs, tokenizer_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", keep_good), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("decontamination", drop_contaminated), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir), "stage")
        scratch.drop("stage", but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
