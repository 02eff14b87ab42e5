"""The corpus pipeline: its stages in order, each written as Parquet and reread as the next one's documents."""

from pyspark.sql import DataFrame, SparkSession

from tallystone.llm import packing, quality_rules, similar, suffix_dedup, toxicity
from tallystone.llm.shared import Table, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from all labelled documents, not only those kept so far."""
    model = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.keep_civil(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 at least) stays."""
    return similar.keep_first(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay in their first document only; all documents stay."""
    return suffix_dedup.without_repeats(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's length bucket and batch."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("toxicity", civility), ("simhash", near_copies), ("suffix_dedup", passages), ("packing", batches)]
#: The toxicity model is trained by iteration, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
