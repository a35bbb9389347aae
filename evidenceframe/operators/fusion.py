"""Fusion of channels, composite scores, thresholds and removed hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip01
from ..settings import DEFAULTS, Settings
from .lexical import ranked


def rrf(channels: list[tuple[str, DataFrame]], k: int = DEFAULTS.rrf_k, top: int | None = DEFAULTS.top_k) -> DataFrame:
    """Reciprocal rank fusion of channels (query_id, node_id, score, rank), in the given order.

    Returns score_vector and score_bm25, score_rrf, the channel (the first that found the hit; one
    that is 'vector' gives way to the next) and the rank. Ties keep the order of first sight.
    """
    stacked = None
    for at, (name, hits) in enumerate(channels):
        part = hits.select("query_id", "node_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("r"), F.lit(at).alias("at"), F.lit(name).alias("channel"))
        stacked = part if stacked is None else stacked.unionByName(part)
    order = F.struct("at", "r")
    # Spark 4.1 takes a union of equally partitioned inputs as partitioned alike, which it is not once
    # adaptive execution has coalesced them; so the exchange of the aggregation is asked for.
    fused = stacked.repartition("query_id", "node_id").groupBy("query_id", "node_id").agg(
        F.round(F.sum(1.0 / (k + F.col("r"))), 9).alias("score_rrf"),
        F.max(F.when(F.col("channel") == "vector", F.col("score"))).alias("score_vector"),
        F.max(F.when(F.col("channel") == "bm25", F.col("score"))).alias("score_bm25"),
        F.min(order).alias("seen"),
        F.coalesce(F.min_by(F.when(F.col("channel") != "vector", F.col("channel")), F.when(F.col("channel") != "vector", order)), F.lit("vector")).alias("channel"),
    )
    return ranked(fused, "score_rrf", top, "seen.at", "seen.r").drop("seen")


def min_max(x: str, by: str = "query_id") -> Column:
    """Min-max over a query's hits; a flat list gives 1 if positive, else 0; null stays null."""
    w = Window.partitionBy(by)
    low, high, v = F.min(x).over(w), F.max(x).over(w), F.col(x)
    return F.when(v.isNull(), None).when(high > low, (v - low) / (high - low)).when(v > 0, 1.0).otherwise(0.0)


def rerank_norm(x: str, by: str = "query_id") -> Column:
    """Clipped if any clipped value is positive, else min-max."""
    some = F.max(clip01(F.col(x))).over(Window.partitionBy(by)) > 0
    return F.when(some, F.when(F.col(x).isNotNull(), clip01(F.col(x)))).otherwise(min_max(x, by))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are not null, clipped to 0..1."""
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts), F.lit(0.0))
    return F.when(weight > 0, clip01(total / weight)).otherwise(0.0)


def composite(hits: DataFrame, stage: str = "initial", s: Settings = DEFAULTS) -> DataFrame:
    """Add score_composite for a stage: initial, rerank, final, or a retry.

    The weighted mean of the components that a hit has. A hit without a vector score uses its own
    score in that place (the fused one where there is no ``score``). A final stage keeps a composite
    that is there. A hit that a relation brought, and that has no other component, keeps what it
    inherited. In a rerank, hits of a low prior score are lowered.
    """
    has = set(hits.columns)
    names = ("score_vector", "score_bm25", "score_rrf", "rerank_score", "inherited_score", "agent_score", "score_composite", "score_composite_prior")
    full = hits.withColumns({c: (F.col(c) if c in has else F.lit(None)).cast("double") for c in names} | {"score_policy": F.col("score_policy") if "score_policy" in has else F.lit(None).cast("string")})
    clip = lambda c: F.when(c.isNotNull(), clip01(c))
    vector = clip(F.coalesce("score_vector", "score" if "score" in has else "score_rrf"))
    normed = full.withColumns({"__vector": vector, "__bm25": min_max("score_bm25"), "__rrf": min_max("score_rrf"), "__rerank": rerank_norm("rerank_score")})
    late = stage in ("rerank", "final", "final_after_retry")
    parts = [
        (F.col("__vector"), s.weights["vector"]), (F.col("__bm25"), s.weights["bm25"]), (F.col("__rrf"), s.weights["rrf"]), (F.col("__rerank"), s.weights["rerank"] if late else 0.0),
        (clip(F.col("inherited_score")), s.weights["relationship"]), (clip(F.col("agent_score")), s.weights["agent"]),
    ]
    score = weighted([(v, w) for v, w in parts if w > 0])
    if stage == "rerank":
        score = F.when(F.col("score_composite_prior") < s.prior_min, score * s.prior_penalty).otherwise(score)
    alone = (F.coalesce("__vector", F.lit(0.0)) == 0) & F.col("__bm25").isNull() & F.col("__rrf").isNull() & F.col("__rerank").isNull()
    inherits = (F.col("score_policy") == "inherited_relationship_v1") & F.col("inherited_score").isNotNull() & alone
    score = F.when(inherits, F.col("inherited_score")).otherwise(score)
    if stage.startswith("final"):
        score = F.coalesce("score_composite", score)
    out = normed.withColumn("score_composite", F.round(score, 6)).drop("__vector", "__bm25", "__rrf", "__rerank")
    return out.drop(*[c for c in ("score_composite_prior", "score_policy") if c not in has])


def threshold_of(stage: Column, s: Settings = DEFAULTS) -> Column:
    """The least composite score that a stage lets pass."""
    late = (stage == "rerank") | (stage.startswith("retry") & stage.contains("rerank"))
    return F.when(late, s.rerank_threshold).when(stage == "final", s.final_threshold).otherwise(s.initial_threshold)


def split_by_threshold(hits: DataFrame, threshold: float) -> DataFrame:
    """All hits with ``passed`` and, for those removed, the reason and the rank they had."""
    passed = F.col("score_composite").isNull() | (F.col("score_composite") >= threshold)
    return hits.withColumn("passed", passed).withColumn("removed_reason", F.when(~passed, "score_threshold_failed")).withColumn("removed_rank", F.when(~passed, F.col("rank")))


def variant_boost(hits: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """A small bonus for hits that several variants of the query found."""
    bonus = F.least(F.lit(s.variant_boost_most), (F.col("variant_hits") - 1) * s.variant_boost)
    return hits.withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + F.when(F.col("variant_hits") > 1, bonus).otherwise(0.0)), 6))


def merge_variants(hits: DataFrame) -> DataFrame:
    """One hit for each node from hits (query_id, variant, node_id, score): the best, and how many."""
    return hits.groupBy("query_id", "node_id").agg(
        F.max("score").alias("score"), F.count("*").alias("variant_hits"), F.array_sort(F.collect_set("variant")).alias("variants")
    )

