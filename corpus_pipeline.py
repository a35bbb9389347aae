"""A corpus from raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from evidenceframe.llm import decontaminate, jaccard_join, line_dedup, source_mix, toxicity
from evidenceframe.llm.common import scratch, work_path


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores as toxic go.

    Each row is judged by its own text, null and empty ones as texts without words. Without toxic
    labels all rows stay. All columns stay as they are.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts of their site; every row stays, and every other column but n_chars.

    A null source is a site, a null text stays null, a text of nothing but boilerplate becomes empty.
    """
    return line_dedup.without_boilerplate(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest doc_id (null last).

    Rows that repeat a doc_id are judged by their own texts; rows without words all stay.
    """
    return jaccard_join.keep_one_of_each(docs).select(docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none. All columns stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, numbered by ``copy``, which replaces a column of that name.

    A null source is a source of its own; texts without words are taken about once.
    """
    return source_mix.mixed_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_boilerplate),
    ("n-gram Jaccard join", remove_near_copies),
    ("benchmark decontamination", remove_contaminated),
    ("source mix", mix_sources),
]

#: Toxicity and the mix are fitted, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_path(spark, "pipeline")
    for at, (_, stage) in enumerate(STAGES):
        with scratch(spark):  # a stage's work tables go once its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
    return docs
