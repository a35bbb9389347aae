"""Hits over the stages of a run: comparison, removals and their reasons, relevance and agent states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["query_id", "node_id"]


def hits_of(snapshots: DataFrame, field: str = "hits") -> DataFrame:
    """(query_id, stage, ...) a row for each hit of the snapshots (query_id, stage, hits array of structs)."""
    return snapshots.select("query_id", "stage", F.explode(field).alias("h")).select("query_id", "stage", "h.*")


def compare(hits: DataFrame, stages: list[str]) -> DataFrame:
    """(query_id, node_id, a rank for each stage, status) of hits (query_id, node_id, stage, rank).

    ``stages`` are the first, the reranked and the last one. A node that a stage has twice counts by
    its best rank.
    """
    wide = hits.groupBy(*KEY).pivot("stage", stages).agg(F.min("rank"))
    wide = wide.select(*KEY, *[F.col(s).alias(f"{s}_rank") for s in stages])
    return wide.withColumn("status", rank_status(*[F.col(f"{s}_rank") for s in stages]))


def rank_status(first: Column, reranked: Column, last: Column) -> Column:
    """What became of a hit, joined by commas; stable if nothing did."""
    states = [
        (first.isNull() & reranked.isNotNull(), "new_in_rerank"), (first.isNull() & reranked.isNull() & last.isNotNull(), "new_in_final"),
        (first.isNotNull() & reranked.isNull() & last.isNull(), "dropped_after_initial"), (reranked.isNotNull() & last.isNull(), "dropped_after_rerank"),
        (reranked < first, "promoted_by_rerank"), (reranked > first, "demoted_by_rerank"), (last < reranked, "promoted_after_retry"), (last > reranked, "demoted_after_retry"),
    ]
    found = F.concat_ws(",", *[F.when(c, F.lit(name)) for c, name in states])
    return F.when(found == "", "stable").otherwise(found)


def removed_reason(to_stage: Column, dropped: Column, label: Column, relevance: Column, passed: Column, low: float = 0.25) -> Column:
    """Why a hit of one stage is not in the next, from what is known of it."""
    return (
        F.when(F.coalesce(dropped, F.lit(False)), "agent_chunk_drop").when(F.lower(label) == "irrelevant", "agent_irrelevant_label").when(relevance < low, "agent_low_relevance_score")
        .when(~passed, "score_threshold_failed").when(to_stage.isin("rerank", "retry_1_rerank"), "reranker_not_selected").when(to_stage == "final_output", "citation_not_selected")
        .when(to_stage.isin("final_after_retry", "local_recheck"), "not_selected_for_final_candidates").otherwise("unknown_removed")
    )


def inferred_removals(hits: DataFrame, removed: DataFrame, order: list[str]) -> DataFrame:
    """(query_id, node_id, from_stage, stage, previous_rank, reason): hits of a stage that the next one neither has nor lists as removed.

    hits (query_id, node_id, stage, rank, dropped, label, relevance, passed), removed (query_id,
    node_id, stage). A query that has nothing at a retry stage did not come there.
    """
    follows = F.create_map(*[F.lit(x) for pair in zip(order, order[1:], strict=False) for x in pair])
    before = hits.withColumn("next", F.get(F.array(follows[F.col("stage")]), F.lit(0))).where("next is not null")
    there = hits.select(*KEY, F.col("stage").alias("next")).union(removed.select(*KEY, F.col("stage").alias("next"))).distinct()
    came = there.select("query_id", "next").distinct().withColumn("came", F.lit(True))
    gone = before.join(there, [*KEY, "next"], "left_anti").join(came, ["query_id", "next"], "left")
    gone = gone.where(~F.col("next").startswith("retry_") | F.col("came"))
    reason = removed_reason(F.col("next"), F.col("dropped"), F.col("label"), F.col("relevance"), F.col("passed"))
    return gone.groupBy(*KEY, F.col("stage").alias("from_stage"), F.col("next").alias("stage")).agg(F.min(F.struct("rank", reason.alias("reason"))).alias("r")).select(
        *KEY, "from_stage", "stage", F.col("r.rank").alias("previous_rank"), F.col("r.reason").alias("reason")
    )


def merged_removals(*groups: DataFrame) -> DataFrame:
    """All removed hits of several groups, repeats included."""
    out = groups[0]
    for group in groups[1:]:
        out = out.unionByName(group)
    return out


def reason_counts(removed: DataFrame) -> DataFrame:
    """(query_id, reason, n): how many hits of a query went for each reason; unknown ones as unknown."""
    return removed.groupBy("query_id", F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def agent_status(stage: Column, label: Column, relevance: Column) -> Column:
    """Whether a hit is graded (null), not graded yet, or never was."""
    early = stage.isin("initial_recall", "initial_retrieval", "initial_expanded", "rerank", "retry_1_retrieval", "retry_1_expanded", "retry_1_rerank")
    graded = (F.coalesce(label, F.lit("")) != "") | relevance.isNotNull()
    return F.when(~graded, F.when(early, "not_graded_yet").otherwise("not_graded"))


def relevance_state(iou: Column, threshold: Column, matched: Column, region_label: Column, grade: Column, page: Column, expected_pages: Column) -> Column:
    """relevant, partial or irrelevant: by the region where there is a sign of one, else by grade or page."""
    label, least = F.lower(F.coalesce(region_label, F.lit(""))), F.coalesce(threshold, F.lit(0.5))
    region = label.isin("match", "partial", "miss", "missing_bbox") | iou.isNotNull() | matched.isNotNull()
    by_region = F.when(F.coalesce(matched, F.lit(False)) | F.coalesce(iou > least, F.lit(False)), "relevant").when(iou > 0, "partial").otherwise("irrelevant")
    by_page = F.when(F.coalesce(grade > 0, F.lit(False)) | F.coalesce(F.array_contains(expected_pages, page), F.lit(False)), "relevant").otherwise("irrelevant")
    return F.when(region, by_region).otherwise(by_page)
