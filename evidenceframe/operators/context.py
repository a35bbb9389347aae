"""Text around tables and formulas: found for a grader, then scored or added by the grade it gives.

Hits are looked at in their order, but all that an earlier hit can change for a later one is whether its
context is there. The first hit that adds a context is a minimum over the query, so joins
and windows give what a walk over the hits would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip01

# Relations that lead to context, in the order in which they are tried; modalities that have one.
CONTEXT_RELATIONS = ("context_node_ids", "context_prev_node_id", "context_next_node_id", "same_page_node_ids")
NEEDS_CONTEXT = ("table", "formula")
# By label, the score of context that is added, and what is added to scores of hits and of their context.
ADDED_SCORE = {"irrelevant": 0.0, "weak": 0.40, "relevant": 0.65, "strong": 0.70}
WITH_CONTEXT = {"irrelevant": -0.10, "weak": -0.03, "relevant": 0.03, "strong": 0.08}
CONTEXT_THERE = {"irrelevant": 0.0, "weak": 0.0, "relevant": 0.02, "strong": 0.06}
CONTEXT_ADDED = {"irrelevant": 0.0, "weak": 0.0, "relevant": 0.03, "strong": 0.08}
ADDING = ("strong",)


def _by_label(label: Column, values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, value in values.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def context_hits(hits: DataFrame, edges: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, node_id, context_id, place): the text that a table or formula hit is read with, in order.

    hits (query_id, node_id, modality, and from_node_id where an expansion brought it), edges (src_id, relation, pos, dst_id), pool (query_id,
    node_id, modality) of what may be used. The node that a hit was expanded from comes first, then
    its edges by relation and place; each context counts once.
    """
    asking = hits.where(F.col("modality").isin(*NEEDS_CONTEXT))
    order = F.array_position(F.array(*map(F.lit, CONTEXT_RELATIONS)), F.col("relation"))
    near = edges.where(F.col("relation").isin(*CONTEXT_RELATIONS)).select(F.col("src_id").alias("node_id"), order.cast("long").alias("relation"), F.col("pos").cast("long").alias("pos"), F.col("dst_id").alias("context_id"))
    tried = asking.select("query_id", "node_id").join(near, "node_id")
    if "from_node_id" in hits.columns:
        origin = asking.where("from_node_id is not null").select("node_id", "query_id", F.lit(0).cast("long").alias("relation"), F.lit(0).cast("long").alias("pos"), F.col("from_node_id").alias("context_id"))
        tried = tried.unionByName(origin)
    text = pool.where(F.coalesce("modality", F.lit("text")) == "text").select("query_id", F.col("node_id").alias("context_id")).distinct()
    found = tried.join(text, ["query_id", "context_id"]).groupBy("query_id", "node_id", "context_id").agg(F.min(F.struct("relation", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id", "node_id").orderBy("at", "context_id"))
    return found.select("query_id", "node_id", "context_id", place.alias("place"))


def related_context(hits: DataFrame, contexts: DataFrame, adding: tuple[str, ...] = ADDING) -> DataFrame:
    """Hits (query_id, node_id, rank, score, modality, label) with score_after, context_id and context, and the context that is added.

    ``contexts`` is the table of ``context_hits``, of which the first counts. A graded table or formula
    whose context is a hit too moves its own and the context's score (``present``). Otherwise a label of
    ``adding`` adds the context with a score of its own (``added``), which then is there for the hits after it, and any other
    label only names it (``missing``). What is added comes after the hits, by the rank of what added it.
    """
    first = contexts.where("place = 1").select("query_id", "node_id", "context_id")
    known = hits.select("query_id", F.col("node_id").alias("context_id"), F.lit(True).alias("there"))
    asking = hits.where(F.col("label").isNotNull() & F.col("modality").isin(*NEEDS_CONTEXT)).join(first, ["query_id", "node_id"]).join(known, ["query_id", "context_id"], "left")
    adds = F.col("there").isNull() & F.col("label").isin(*adding)
    adder = F.min(F.when(adds, F.struct("rank", "node_id"))).over(Window.partitionBy("query_id", "context_id"))
    asking = asking.withColumn("adder", adder)
    context = F.when(F.col("there") | (F.col("adder") < F.struct("rank", "node_id")), "present").when(F.col("adder") == F.struct("rank", "node_id"), "added").otherwise("missing")
    asking = asking.withColumn("context", context)
    own = F.when(F.col("context") == "present", _by_label(F.col("label"), WITH_CONTEXT)).when(F.col("context") == "added", _by_label(F.col("label"), CONTEXT_ADDED)).otherwise(0.0)
    moved = asking.select("query_id", "node_id", "context_id", "context", own.alias("own"))

    # What present hits give their context, in their order, as each sum is kept within 0 and 1.
    gifts = asking.where("context = 'present'").groupBy("query_id", "context_id").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id", _by_label(F.col("label"), CONTEXT_THERE).alias("by")))).alias("gifts"))
    gifts = gifts.select("query_id", F.col("context_id").alias("node_id"), F.transform("gifts", lambda g: g["by"]).alias("gifts"))
    summed = lambda score: F.aggregate(F.filter("gifts", lambda g: g != 0), score, lambda x, g: clip01(x + g))
    given = lambda score: F.when(F.col("gifts").isNull(), score).otherwise(summed(score))

    score = F.when(F.coalesce("own", F.lit(0.0)) == 0, F.col("score")).otherwise(clip01(F.col("score") + F.col("own")))
    out = hits.join(moved, ["query_id", "node_id"], "left").join(gifts, ["query_id", "node_id"], "left")
    out = out.select("query_id", "node_id", "rank", given(score.cast("double")).alias("score_after"), "context_id", "context", F.lit(False).alias("is_added"))
    new = asking.where("context = 'added'").select("query_id", F.col("context_id").alias("node_id"), "rank", _by_label(F.col("label"), ADDED_SCORE).alias("base"))
    new = new.join(gifts, ["query_id", "node_id"], "left").withColumn("score_after", given(F.col("base")))
    last = hits.groupBy("query_id").agg(F.max("rank").alias("last"))
    after = F.col("last") + F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    none = F.lit(None).cast("string")
    new = new.join(last, "query_id").select("query_id", "node_id", after.cast(hits.schema["rank"].dataType).alias("rank"), "score_after", none.alias("context_id"), none.alias("context"), F.lit(True).alias("is_added"))
    return out.unionByName(new)
