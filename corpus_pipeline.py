"""From raw documents to packed training sequences: each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm.common import read, row_of, saved
from gantry.llm.decontamination import decontaminated
from gantry.llm.line_dedup import dedup_lines
from gantry.llm.near_dedup import first_of_classes
from gantry.llm.packing import pack, pieces
from gantry.llm.quality_rules import judge


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    # In one struct, so that a column of the documents named as a result stays what it is.
    verdict = judge(docs.select("text", "lang", row_of(docs).alias("_document")))
    return verdict.filter("kept").select("_document.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text."""
    left = dedup_lines(docs.select("doc_id", "text", row_of(docs).alias("_document")))
    names = {c: F.col("_document").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in names:
        names["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.select(*(v.alias(k) for k, v in names.items()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays."""
    return first_of_classes(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and their places in the sequences."""
    return pack(saved(pieces(docs), "pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the near copies, the edit distances and the tokens; a test holds the run
#: against a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
