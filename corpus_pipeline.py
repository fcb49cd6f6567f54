"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet
and read again as the next stage's docs. Stages return all columns of documents but
the last, which returns the pieces of the packed sequences. A stage reads what else
it needs (labels, benchmark) from sf_dir.

Null and empty texts pass all filters and are packed as their end token alone; empty
tables stay empty; columns beyond those of documents pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, neardup, packing, paragraphs, quality
from gridloom.llm.store import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity under the trusted model is above their language's threshold."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group linked by 5-word shingles at a Jaccard similarity of 0.8.

    Of rows that repeat a kept doc_id one stays, the one with the smallest text; rows
    with a null doc_id all stay.
    """
    found = neardup.near_duplicates(docs, shingle=5, percent=80)
    # Aggregated by id, so that rows that repeat an id decide once.
    kept = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("_gl_kept"), F.count(F.lit(1)).alias("_gl_rows")).where("_gl_kept").withColumnRenamed("doc_id", "_gl_id")
    stay = docs.join(kept, docs["doc_id"] == F.col("_gl_id"), "left").where("_gl_id is not null or doc_id is null")
    once = stay.where("_gl_rows is null or _gl_rows = 1").select(*docs.columns)
    # Rows that repeat an id: an aggregate of whole rows, only over those.
    row = F.struct(F.col("text"), *[F.col(c) for c in docs.columns if c != "text"])
    many = stay.where("_gl_rows > 1").groupBy("_gl_id").agg(F.min(row).alias("_gl_row")).select(*[F.col(f"_gl_row.{c}").alias(c) for c in docs.columns])
    return once.unionByName(many)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out that another document with a smaller doc_id has too."""
    return paragraphs.remove_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated with benchmark items, and cuts the hit passages out of the others."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Models and trained tokenizers aren't expressible in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None
