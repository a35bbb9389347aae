"""Choosing hits: distinct ones, head and tail, context of images, hits carried over or dropped before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip01
from ..settings import DEFAULTS, Settings
from .lexical import small

KEY = ["query_id", "node_id"]


def distinct_hits(hits: DataFrame) -> DataFrame:
    """The first hit in rank order of each node of a query, ranked anew."""
    rest = [c for c in hits.columns if c not in KEY]
    first = hits.groupBy(*KEY).agg(F.min_by(F.struct(*rest), F.struct("rank")).alias("h")).select(*KEY, "h.*")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "node_id")))


def head_tail(hits: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The first and the last hits of each query, ``grade_most`` at most."""
    of_query = Window.partitionBy("query_id")
    chosen = hits.withColumn("__n", F.count("*").over(of_query)).where((F.col("rank") <= s.grade_head) | (F.col("rank") > F.col("__n") - s.grade_tail))
    chosen = chosen.withColumn("__at", F.row_number().over(of_query.orderBy("rank")))
    return chosen.where(F.col("__at") <= s.grade_most).drop("__n", "__at")


def image_context(hits: DataFrame, nodes: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, node_id, score, rank, channel): hits and, for images, the first text nodes of their page.

    hits (query_id, node_id, score, rank), nodes (node_id, doc_id, page, modality, chunk_index). A
    text that several images reach takes the score of the first; a hit is not added again. Texts of
    a page are found once, whatever the number of questions.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("chunk_index", "node_id")
    images = small(hits).join(nodes.where("modality = 'image'").select("node_id", "doc_id", "page"), "node_id").select("query_id", "score", "rank", "doc_id", "page")
    # of few hits' pages only; no other text is ranked
    here = nodes.where("modality = 'text'").select("node_id", "doc_id", "page", "chunk_index").join(small(images.select("doc_id", "page").distinct()), ["doc_id", "page"], "left_semi")
    texts = here.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= s.image_context_top)
    near = images.join(texts.select("node_id", "doc_id", "page", "__k"), ["doc_id", "page"])
    added = near.groupBy(*KEY).agg(F.min_by(F.struct("score", "rank", "__k"), F.struct("rank", "__k")).alias("h")).join(hits.select(*KEY), KEY, "left_anti")
    added = added.select(*KEY, clip01(F.col("h.score") * s.image_context_weight).alias("score"), F.col("h.rank").alias("a"), F.col("h.__k").alias("b"), F.lit("image_context").alias("channel"))
    both = hits.select(*KEY, "score", F.col("rank").alias("a"), F.lit(0).alias("b"), F.lit("search").alias("channel")).unionByName(added)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("channel") == "image_context", "a", "b")
    return both.withColumn("rank", F.row_number().over(order)).drop("a", "b")


def carried_forward(current: DataFrame, carried: DataFrame) -> DataFrame:
    """(query_id, node_id, score, rank, carry): carried hits replace current ones in place, or follow them.

    carry is 'replaced', 'added' or null. Both sides have one row for each node of a query.
    """
    a = current.select(*KEY, F.col("score").alias("s0"), F.col("rank").alias("r0"))
    b = carried.select(*KEY, F.col("score").alias("s1"), F.col("rank").alias("r1"))
    merged = a.join(b, KEY, "full_outer")
    order = Window.partitionBy("query_id").orderBy(F.col("r0").isNull(), "r0", "r1")
    kind = F.when(F.col("r1").isNotNull(), F.when(F.col("r0").isNotNull(), "replaced").otherwise("added"))
    return merged.select(*KEY, F.when(F.col("r1").isNotNull(), F.col("s1")).otherwise(F.col("s0")).alias("score"), F.row_number().over(order).alias("rank"), kind.alias("carry"))


def without_dropped(hits: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits that were not dropped before, and those that were (query_id, node_id of earlier drops)."""
    keys = dropped.select(*KEY).distinct()
    return hits.join(keys, KEY, "left_anti"), hits.join(keys, KEY, "left_semi")
