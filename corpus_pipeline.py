"""From raw documents to packed training sequences. Each stage works on all that the stage before it kept; ``run`` writes and
rereads the documents between them, as the driver of the pipeline does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, line_dedup, near_copies, packing, quality
from tallyforge.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("_score") >= quality.THRESHOLD).drop("_score")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one holds."""
    cut = line_dedup.line_dedup(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash candidates whose 5-word shingles have a similarity of 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' sequences in their batches."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_copies", near_copy_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]
#: SQL has no classifier, fingerprints of this kind or optimal buckets; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        docs = done if i == len(STAGES) - 1 else scratch.save(done)
    return docs
