"""Grades of hits and advice of agents, merged by conservative rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip01
from ..settings import DEFAULTS, Settings
from . import fusion

# What a label adds to a score; what advice may name.
LABEL_DELTAS = {"irrelevant": -0.20, "weak": -0.05, "relevant": 0.03, "strong": 0.10}
CHANNELS = ("vector", "bm25", "page", "table", "image", "formula", "relationship")
MODALITIES = ("text", "table", "page", "image", "formula")
ROUTES = ("text_first", "table_first", "page_first", "image_first", "formula_first", "cross_doc")
FILTERS = ("source", "doc_id", "page", "tags", "modality", "image_semantic_type")


def graded(hits: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Hits (query_id, node_id, score, rerank_score, shares_anchor) with their grade (label, relevance, flagged) applied.

    Adds score_after, dropped, drop_reason, protected and removed_reason. The label moves the score. A
    hit is a candidate to drop for a label that drops and a low relevance together, or, if the
    settings ask for one of them alone, for the agent's flag, label or relevance; a good prior or
    rerank score, where its label is none that drops, or a shared anchor protects it. A hit without a
    label stays as it is.
    """
    bad = F.coalesce(F.col("label").isin(*s.drop_labels), F.lit(False))
    low = F.coalesce(clip01(F.col("relevance")) < s.drop_relevance, F.lit(False))
    known = F.col("label").isNotNull()
    if s.drop_needs_both:
        reason = F.when(known & bad & low, "label_and_score_threshold")
    else:
        reason = F.when(known, F.when(F.coalesce("flagged", F.lit(False)), "agent_drop_flag").when(bad, "label").when(low, "score_threshold"))
    by_score = F.lit(s.protect_drop_labels) | ~bad
    guard = (
        F.when(by_score & (F.col("score") >= s.protect_prior), "prior_score").when(by_score & (F.col("rerank_score") >= s.protect_rerank), "rerank_score")
        .when(F.lit(s.protect_anchors) & F.coalesce("shares_anchor", F.lit(False)), "query_anchor_overlap")
    )
    out = hits.withColumn("drop_reason", reason).withColumn("protected", F.when(F.col("drop_reason").isNotNull(), guard))
    out = out.withColumn("dropped", F.col("drop_reason").isNotNull() & F.col("protected").isNull())
    delta = F.lit(0.0)
    for label, by in LABEL_DELTAS.items():
        delta = F.when(F.col("label") == label, by).otherwise(delta)
    out = out.withColumn("score_after", F.when(known, clip01(F.col("score") + delta)).otherwise(F.col("score")))
    low_only = F.when(F.col("drop_reason") == "score_threshold", "agent_low_relevance_score").otherwise("agent_chunk_drop")
    removed = F.when(F.col("dropped"), F.when(bad, "agent_irrelevant_label").otherwise(low_only))
    return out.withColumn("removed_reason", removed)


def merged_routes(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The rules' route and an agent's in one; advice that is not valid or not sure enough is not used.

    rows: query_id, route, modalities, cross_doc, page_level, and the same with ``a_`` before them, of
    the agent, with its a_confidence.
    """
    none = F.array().cast("array<string>")
    mine, theirs = F.coalesce("modalities", none), F.coalesce("a_modalities", none)
    errors = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("a_route").isin(*ROUTES), F.lit(False)), F.lit("invalid_route")), F.when(F.coalesce("a_confidence", F.lit(0.0)) < s.route_confidence, F.lit("low_route_confidence")),
        F.when(F.exists(theirs, lambda m: ~m.isin(*MODALITIES)), F.lit("invalid_modalities")),
    ))
    used = F.size("errors") == 0
    either = lambda c: F.coalesce(c, F.lit(False)) | (used & F.coalesce(f"a_{c}", F.lit(False)))
    out = rows.withColumn("errors", errors)
    return out.select(
        "query_id", F.when(used, F.col("a_route")).otherwise(F.col("route")).alias("route"), F.when(used, F.array_distinct(F.concat(mine, theirs))).otherwise(mine).alias("modalities"),
        either("cross_doc").alias("cross_doc"), either("page_level").alias("page_level"), "errors", used.alias("used"),
    )


def valid_tasks(tasks: DataFrame, top: int = 32) -> DataFrame:
    """Advised tasks (query_id, channel, top_k, filters map) with ``error``; null for those that may run.

    A channel or a filter key that is not allowed is an error; top_k is kept between 1 and ``top``.
    """
    wrong = F.exists(F.map_keys(F.coalesce("filters", F.create_map().cast("map<string,string>"))), lambda k: ~k.isin(*FILTERS))
    error = F.when(~F.coalesce(F.col("channel").isin(*CHANNELS), F.lit(False)), "invalid_channel").when(wrong, "invalid_filters")
    return tasks.withColumn("error", error).withColumn("top_k", F.greatest(F.lit(1), F.least(F.lit(top), F.col("top_k"))))


def reason_group(reason: Column) -> Column:
    """agent, threshold, topk, citation or other."""
    cut = ("reranker_not_selected", "context_top_n_limit", "stage_top_k_limit", "rerank_empty", "rerank_failed_fallback_excluded")
    return (
        F.when(reason.startswith("agent_"), "agent").when(reason == "score_threshold_failed", "threshold").when(reason.isin(*cut), "topk")
        .when(reason.isin("citation_not_selected", "generation_skipped"), "citation").otherwise("other")
    )


def removed_summary(removed: DataFrame) -> DataFrame:
    """(query_id, removed, agent, threshold, topk, inferred) of removed hits (query_id, reason, inferred)."""
    kind = reason_group(F.col("reason"))
    counts = [F.count_if(kind == name).alias(name) for name in ("agent", "threshold", "topk")]
    return removed.groupBy("query_id").agg(F.count("*").alias("removed"), *counts, F.count_if(F.coalesce("inferred", F.lit(False))).alias("inferred"))


def span_consistency(scores: Column) -> Column:
    """One less the span of the positive scores; a single one stands for itself, none is 0."""
    good = F.filter(scores, lambda x: x > 0)
    span = F.array_max(good) - F.array_min(good)
    return F.when(F.size(good) == 0, 0.0).when(F.size(good) == 1, F.least(F.lit(1.0), F.get(good, F.lit(0)))).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), span)))


def final_hits(hits: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Hits with their final score, in its order, split at the final threshold as ``split_by_threshold`` does."""
    scored = fusion.composite(hits, "final", s)
    ordered = fusion.ranked(scored.withColumnRenamed("rank", "previous_rank"), "score_composite", None, "previous_rank", "node_id")
    return fusion.split_by_threshold(ordered, s.final_threshold)
