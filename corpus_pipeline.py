"""The corpus pipeline: quality rules, near copies, benchmark decontamination, personal data, packing.

Every stage works on all that the one before kept and returns the columns of ``documents``; the last returns the pieces
of the packed sequences.  The stages have no common SQL form; tests compare each with a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import common, queries
from corpuslake.llm.decontamination import decontamination
from corpuslake.llm.harmonic_packing import harmonic_packing
from corpuslake.llm.ngram_join import drop_near_duplicates
from corpuslake.llm.pii import redact_pii
from corpuslake.llm.quality_rules import drop_low_quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive thresholds keep."""
    return drop_low_quality(docs)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontamination(docs, common.table(spark, sf_dir, "benchmark"))
    clean = found.filter(~F.col("contaminated")).select(F.col("did").alias("__did"), F.col("dn").alias("__dn"))
    return common.with_keys(docs).join(clean, ["__did", "__dn"], "left_semi").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    out = redact_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 2048 tokens."""
    return harmonic_packing(docs, queries.tokenizer_path())


STAGES = [("quality rules", keep_quality), ("n-gram Jaccard join", keep_one_copy), ("benchmark decontamination", keep_uncontaminated),
          ("PII", redact), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written once and read by the next."""
    from uuid import uuid4

    from corpuslake.session import checkpoint_dir

    docs = common.table(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
