"""A corpus pipeline of five stages over ``documents``.

Each stage works on all that the one before kept; all but the last return the
columns of ``documents``. Empty tables pass through every stage without a row;
other columns stay, but for names that begin with ``__`` and those that a stage
says it makes. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessara.llm.common import materialize, release, table, tables
from tessara.llm.decontamination import decontaminate
from tessara.llm.jaccard import drop_near_duplicates
from tessara.llm.line_dedup import dedup_lines
from tessara.llm.mixing import mix_sources
from tessara.llm.quality import score_quality

#: Scores below this are rejected.
QUALITY = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it scores below QUALITY go.

    Null and empty texts score the labels' mean, so they stay unless most labels are 0; equal texts fare alike.
    """
    return score_quality(docs, table(spark, sf_dir, "labels"), "__score").where(F.col("__score") >= QUALITY).drop("__score")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of line runs of over 50 words go.

    A document of which nothing is left goes too; n_chars is that of the text left. Null and empty texts stay as
    they are; rows equal in doc_id and text are one document, and none of them is a copy of the other.
    """
    kept = dedup_lines(docs).where((F.col("n_deleted") == 0) | (F.trim(F.regexp_replace("text", r"\s", " ")) != ""))
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays, that of the smallest doc_id (null last), then text key.

    Texts without words, null ones included, all stay; rows equal in doc_id and text count as one.
    """
    return drop_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go, the others stay as they are, null and repeated rows too."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: how many words the mix takes from each document.

    Null texts have size 0; a null source is a source of its own; ties go by the seeded order; repeated rows count each.
    """
    return mix_sources(docs)


STAGES = [("quality classifier", classify), ("line dedup", dedup), ("n-gram Jaccard join", near), ("benchmark decontamination", clean), ("mixing", mix)]

#: Neighbours' votes and MinHash can't be put in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each result is written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), tables()
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        release([*before, tables()[-1]])  # what the stage made on its way, and its input
    return docs
