"""Corpus cleaning: five stages over documents, each a training-data operator.

Defined cases. A document with a null or wordless text has no n-grams and is rejected by the first
stage. Rows of null doc_id keep their lines and their near copies, and can still be rejected,
contaminated and packed. Of repeated rows one stays after the near-duplicate stage. Extra columns of
documents pass through all stages but the last, whatever their names. Empty tables give no windows;
without labels the target is uniform, without benchmark items nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import op02_packing, op03_decontaminate, op04_quality, op07_lines, op08_minhash
from cairn.llm.runtime import stable, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram likelihood ratio rejects go."""
    return op04_quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stand earlier in the corpus are cut from the texts; rows that lose all their text go."""
    return op07_lines.dedup_lines(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays."""
    return op08_minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op03_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ranges of the documents that are left, with the token ids themselves."""
    return op02_packing.pack(docs, tokens=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Random walks, MinHash and bitset programmes have no SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what one keeps is stored in the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if at == 0 else stable(docs), sf_dir)
    return docs
