"""Edges between nodes, expansion along them, page windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip01
from .lexical import small

# Weight, priority and family of each relation, in the order in which a node's edges are followed.
RELATIONS = {
    "parent_id": (0.60, 30, "structure"),
    "prev_id": (0.50, 60, "context"),
    "next_id": (0.50, 60, "context"),
    "context_prev_node_id": (0.60, 80, "context"),
    "context_next_node_id": (0.60, 80, "context"),
    "doc_prev_node_id": (0.50, 30, "structure"),
    "doc_next_node_id": (0.50, 30, "structure"),
    "child_ids": (0.60, 30, "structure"),
    "context_node_ids": (0.60, 80, "context"),
    "same_page_node_ids": (0.30, 40, "page"),
    "related_table_node_ids": (0.90, 100, "related"),
    "related_formula_node_ids": (0.85, 100, "related"),
    "related_image_node_ids": (0.80, 100, "related"),
    "page_window": (0.30, 20, "page"),
}
# Weight and priority of any other relation; seed scores and ranks by family, then for page and structure by mode.
OTHER = (0.60, 10, "other")
SEEDS = {"related": (0.30, 6), "context": (0.45, 4), "routed": (0.55, 3), "retry": (0.55, 3)}
CROSS_REASONS = ("need_cross_doc", "possible_conflict", "numeric_value_conflict", "cross_source_polarity_conflict")


def _of_relation(relation: Column, at: int) -> Column:
    out = F.lit(OTHER[at])
    for name, row in RELATIONS.items():
        out = F.when(relation == name, row[at]).otherwise(out)
    return out


def relation_weight(relation: Column) -> Column:
    return _of_relation(relation, 0)


def relation_priority(relation: Column) -> Column:
    return _of_relation(relation, 1)


def relation_family(relation: Column) -> Column:
    return _of_relation(relation, 2)


def allowed_in_mode(relation: Column, mode: Column, reason: Column) -> Column:
    """Whether a mode follows a relation: auto only to related and context nodes; retry not to related ones, and
    along the structure only for a conflict; routed everywhere."""
    family = relation_family(relation)
    retry = family.isin("context", "page") | ((family == "structure") & F.coalesce(reason.isin(*CROSS_REASONS), F.lit(False)))
    return F.when(mode == "auto", family.isin("related", "context")).when(mode == "retry", retry).otherwise(family != "other")


def candidate_pool(relation: Column, mode: Column) -> Column:
    """The pool whose caps count for a relation."""
    family = relation_family(relation)
    far = family.isin("page", "structure") & mode.isin("routed", "retry")
    return F.when(family == "related", "related_modality").when(far, mode).when(family == "context", "context").otherwise("relationship")


def seed_threshold(relation: Column, mode: Column) -> Column:
    """The least score of a seed that a relation is followed from; null where there is none."""
    family = relation_family(relation)
    by_family = F.when(family == "related", SEEDS["related"][0]).when(family == "context", SEEDS["context"][0])
    return F.coalesce(by_family, F.when(mode == "routed", SEEDS["routed"][0]).when(mode == "retry", SEEDS["retry"][0]))


def inherited_score(seed: Column, relation: Column, own: Column) -> Column:
    """What a neighbour inherits: the seed's score by the relation's weight, mixed with its own composite if that is more."""
    passed = clip01(seed * relation_weight(relation))
    return F.greatest(passed, F.coalesce(own * 0.2 + passed * 0.8, passed))


def adjacent_edges(nodes: DataFrame) -> DataFrame:
    """(src_id, relation, dst_id) to the previous and next node of a document, in one window."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    ends = nodes.select("node_id", F.lag("node_id").over(w).alias("prev_id"), F.lead("node_id").over(w).alias("next_id"))
    pairs = F.explode(F.map_from_arrays(F.array(F.lit("prev_id"), F.lit("next_id")), F.array("prev_id", "next_id")))
    return ends.select(F.col("node_id").alias("src_id"), pairs.alias("relation", "dst_id")).where("dst_id is not null")


def same_page_edges(nodes: DataFrame, most: int = 30) -> DataFrame:
    """Edges to the first nodes of the same page, at most ``most`` for each node."""
    near = nodes.select("doc_id", "page", F.col("node_id").alias("dst_id"), F.col("chunk_index").alias("at"))
    w = Window.partitionBy("doc_id", "page").orderBy("at")
    near = near.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most + 1)
    pairs = nodes.select("doc_id", "page", F.col("node_id").alias("src_id")).join(near, ["doc_id", "page"]).where("src_id <> dst_id")
    kept = pairs.withColumn("pos", F.row_number().over(Window.partitionBy("src_id").orderBy("at"))).where(F.col("pos") <= most)
    return kept.select("src_id", F.lit("same_page_node_ids").alias("relation"), "dst_id")


def nearest_text(nodes: DataFrame) -> DataFrame:
    """For each node that is not text, the nearest text node before and after it (as-of)."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    text = F.when(F.col("modality") == "text", F.col("node_id"))
    before = F.last(text, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(text, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return nodes.select("node_id", "modality", before.alias("context_prev_node_id"), after.alias("context_next_node_id")).where("modality <> 'text'").drop("modality")


def page_window(seeds: DataFrame, nodes: DataFrame, width: int = 1) -> DataFrame:
    """Nodes within ``width`` pages of a seed (query_id, node_id); a range join as an equi join.

    Few seeds, and the pages that they want, go to the nodes, which then are not shuffled.
    """
    seeds = small(seeds.select("query_id", "node_id"))
    at = seeds.join(nodes.select("node_id", "doc_id", "page"), "node_id")
    wanted = at.select("query_id", "doc_id", F.explode(F.sequence(F.col("page") - width, F.col("page") + width)).alias("page")).distinct()
    found = small(wanted).join(nodes.select("node_id", "doc_id", "page"), ["doc_id", "page"])
    return found.join(seeds, ["query_id", "node_id"], "left_anti").select("query_id", "node_id", "doc_id", "page")
