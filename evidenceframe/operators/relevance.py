"""Hits against the specifications of a case: which matches, and with what grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(text: Column) -> Column:
    """Letters, digits and underscores in lower case."""
    return F.regexp_replace(F.lower(text.cast("string")), r"(?U)[^\w]+", "")


def matches(page_tolerance: int = 0) -> Column:
    """Whether a hit meets every field that its specification states; one without fields meets none.

    Specifications (spec_id, spec_page, spec_source) and hits (node_id, doc_id, page, source). A
    source matches where one contains the other.
    """
    def stated(c: str) -> Column:
        return F.col(c).isNotNull() & (F.col(c).cast("string") != "")

    wanted, have = normal(F.col("spec_source")), normal(F.col("source"))
    checks = {
        "spec_id": (normal(F.col("spec_id")) == normal(F.col("node_id"))) | (normal(F.col("spec_id")) == normal(F.col("doc_id"))),
        "spec_page": F.abs(F.col("page") - F.col("spec_page")) <= page_tolerance,
        "spec_source": (wanted != "") & (have != "") & (have.contains(wanted) | wanted.contains(have)),
    }
    some, all_met = F.lit(False), F.lit(True)
    for name, met in checks.items():
        some, all_met = some | stated(name), all_met & (~stated(name) | F.coalesce(met, F.lit(False)))
    return some & all_met


def graded(hits: DataFrame, specs: DataFrame, page_tolerance: int = 0, once: bool = False) -> DataFrame:
    """Add spec_idx and grade (0.0 where none matches) to hits (query_id, rank, ...).

    Each hit takes the matching specification of the highest grade, the first of equals. ``once``:
    a specification serves one hit only; hits choose in rank order. Only the matching pairs of one
    query are gathered, at most its hits times its specifications.
    """
    wanted = specs.select("query_id", "spec_idx", "spec_id", "spec_page", "spec_source", F.coalesce("grade", F.lit(1.0)).alias("grade")).where("grade > 0")
    pairs = hits.join(wanted, "query_id").where(matches(page_tolerance)).select("query_id", "rank", "spec_idx", "grade")
    if not once:
        best = pairs.groupBy("query_id", "rank").agg(F.max_by(F.struct("spec_idx", "grade"), F.struct(F.col("grade").alias("g"), (-F.col("spec_idx")).alias("i"))).alias("b"))
    else:
        queue = F.array_sort(F.collect_list(F.struct("rank", (-F.col("grade")).alias("worse"), "spec_idx", "grade")))
        took = lambda done, p: ~F.exists(done, lambda d: (d["rank"] == p["rank"]) | (d["spec_idx"] == p["spec_idx"]))
        pairs = pairs.groupBy("query_id").agg(queue.alias("queue"))
        empty = F.slice("queue", 1, 0)
        chosen = F.aggregate("queue", empty, lambda done, p: F.when(took(done, p), F.array_append(done, p)).otherwise(done))
        best = pairs.select("query_id", F.explode(chosen).alias("c")).select("query_id", F.col("c.rank").alias("rank"), F.struct("c.spec_idx", "c.grade").alias("b"))
    return hits.join(best, ["query_id", "rank"], "left").withColumns({"spec_idx": F.col("b.spec_idx"), "grade": F.coalesce("b.grade", F.lit(0.0))}).drop("b")
