"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and calls one operator. The first
four return the columns of ``docs``; the last returns the mix. Where a decision must find its rows again, rows are
known by a hash of id and text: rows alike in both are copies of each other, and null ids need no special case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.decontaminate import contamination
from lodestar.llm.line_dedup import line_dedup
from lodestar.llm.mixing import mix
from lodestar.llm.quality import quality_scores
from lodestar.llm.shared import cut, table
from lodestar.llm.simhash import simhash_groups


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).where("__predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; n_chars follows. A text that loses nothing stays as it is, null too."""
    rows = line_dedup(docs)
    lost = F.col("__n_dropped") > 0
    new = {"text": F.when(lost, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays (a null one only if all are)."""
    keyed = _keyed(docs)
    groups = simhash_groups(keyed, shingle=3, limit=2, carry=("__key",))
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("f")).select(F.col("f.__key").alias("__key"))
    kept = keyed.join(first, "__key", "left_semi")
    # copies of one row share its key
    return kept.withColumn("__n", F.row_number().over(W.partitionBy("__key").orderBy("__key"))).where("__n = 1").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    keyed = _keyed(docs)
    found = contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="__key")
    gone = found.where("contaminated").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(gone, "__key", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(docs, weights=(5, 2, 1), share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_copies),
    ("benchmark decontamination", decontaminated),
    ("source mixing", mixed),
]

#: The classifier and the fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
