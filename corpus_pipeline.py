"""Corpus pipeline: quality rules, line dedup, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. `run` writes what a stage returns as Parquet in the shared folder and hands it to the next.
Stages work on every row they get, whatever ids, nulls or repeated rows it holds; see the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylattice.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from paylattice.llm.common import cut, fresh


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines go from the texts; every document stays, `n_chars` follows its text."""
    report, = fresh(docs, "report")
    cleaned = line_dedup.remove_repeated_lines(docs, out=report).drop(report)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, which may be not at all."""
    mix, = fresh(docs, "mix")
    taken = mixing.mix(docs, out=mix).filter(F.col(mix)["copies"] > 0)
    copies = F.sequence(F.lit(1).cast("long"), F.col(mix)["copies"])
    return taken.withColumn(mix, F.explode(copies)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix),
    ("packing", packed),
]

# No SQL: the stages draw seeded samples, hash and tokenise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline/{name.replace(' ', '_')}")
    return STAGES[-1][1](spark, docs, sf_dir)
