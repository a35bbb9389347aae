"""Retrieval history as JSON lines: append, load, pick a record, truncate; offline results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A record keeps its hits as JSON text; ``at`` orders records.
HISTORY = "query_id string, at long, question string, stages string"


def append_history(records: DataFrame, folder: str) -> None:
    """Add records; what the folder holds stays. Columns beyond those of the history are kept too."""
    records.write.mode("append").json(folder)


def read_history(spark: SparkSession, folder: str, schema: str = HISTORY) -> DataFrame:
    """All records; a line that is not JSON is an error, blank lines are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(folder)


def latest_records(records: DataFrame, *by: str, order: str = "at") -> DataFrame:
    """The last record for each ``by``, or of all; of equal times, the one whose content sorts last."""
    whole = F.struct(*records.columns)
    last = records.groupBy(*by).agg(F.max_by(whole, F.struct(F.col(order).alias("o"), F.xxhash64(*records.columns).alias("h"))).alias("r"))
    return last.where("r is not null").select("r.*")


def truncate_history(spark: SparkSession, folder: str, schema: str = HISTORY) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").json(folder)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(case_id, ...) of offline results in JSON lines; of repeated cases the last line counts.

    ``case_id`` may be called ``id``, and the fields of ``schema`` may be below ``result``.
    """
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    parsed = lines.select(F.from_json("value", f"case_id string, id string, result struct<{schema}>, {schema}").alias("r"), at.alias("at"))
    key = F.coalesce(F.nullif("r.case_id", F.lit("")), F.nullif("r.id", F.lit("")))
    names = StructType.fromDDL(schema).names
    flat = parsed.select(
        F.when(key.isNull(), F.raise_error(F.lit("a result without case_id or id")).cast("string")).otherwise(key).alias("case_id"), "at",
        F.struct(*[F.when(F.col("r.result").isNotNull(), F.col(f"r.result.{n}")).otherwise(F.col(f"r.{n}")).alias(n) for n in names]).alias("v"),
    )
    return flat.groupBy("case_id").agg(F.max_by("v", "at").alias("v")).select("case_id", "v.*")
