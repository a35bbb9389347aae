"""Readers for markdown, delimited tables and evaluation cases; index writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

CASES = "id string, question string, reference_answer string, prediction string, reference_keywords array<string>, expected_sources array<string>"


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(source, title, tags, content) of all .md files below a folder, with simple front matter."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_name").alias("name"), "value")
    front = F.regexp_extract("value", r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    body = F.regexp_replace("value", r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", "")
    field = lambda n: strip(F.regexp_extract(front, rf"(?m)^{n}:[ \t]*(.*)$", 1))
    tags = F.regexp_replace(field("tags"), r"^\[|\]$", "")
    listed = F.regexp_extract_all(front, F.lit(r"(?m)^\s*-\s+(.+)$"), F.lit(1))
    return raw.select(
        "source", F.coalesce(F.nullif(F.regexp_replace(field("title"), "^[\"']|[\"']$", ""), F.lit("")), F.regexp_replace("name", r"\.md$", "")).alias("title"),
        F.when(tags != "", F.transform(F.split(tags, ","), lambda t: F.regexp_replace(F.trim(t), "^[\"']|[\"']$", ""))).otherwise(listed).alias("tags"), strip(body).alias("content"),
    )


def delimited_markdown(text: Column, separator: str = ",") -> Column:
    """A delimited table (no quoting) as markdown; short rows are padded, piped text is kept."""
    lines = F.filter(F.split(F.regexp_replace(text, "\r", ""), "\n"), lambda x: F.trim(x) != "")
    rows = F.transform(lines, lambda x: F.transform(F.split(x, "\\Q" + separator + "\\E"), F.trim))
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    made = F.transform(rows, line)
    whole = F.array_join(F.concat(F.slice(made, 1, 1), F.array(rule), F.slice(made, 2, F.greatest(F.size(made) - 1, F.lit(0)))), "\n")
    return F.when(F.size(lines) == 0, "").when(lines[0].contains("|"), strip(text)).otherwise(whole)


def read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(source, markdown) of all .csv and .tsv files below a folder."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,tsv}").text(folder, wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("source"), "value")
    return raw.select("source", F.when(F.col("source").endswith(".tsv"), delimited_markdown(F.col("value"), "\t")).otherwise(delimited_markdown(F.col("value"))).alias("markdown"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; lines that start with # and blank lines are left out.

    Reading the question of a case that has none stops the run.
    """
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    cases = lines.select(F.from_json("value", CASES, {"mode": "FAILFAST"}).alias("c")).select("c.*")
    stop = F.raise_error(F.concat(F.lit("a case without a question: "), F.coalesce("id", F.lit("no id"))))
    return cases.withColumn("question", F.when(F.trim("question") != "", F.col("question")).otherwise(stop.cast("string")))


def upsert(existing: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """Rows of ``new`` replace those of ``existing`` with the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)
