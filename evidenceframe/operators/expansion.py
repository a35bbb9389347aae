"""Expansion of hits along relations, with the rules of its mode: auto, routed or retry.

What depends on one edge alone (mode, modality, rank and score of the seed) is a filter of columns,
so few candidates are left. Caps depend on what was taken before, in the order of seeds, relations and
edges; they are kept up in one small group for each query.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linking import RELATIONS, SEEDS, allowed_in_mode, candidate_pool, inherited_score, relation_family, relation_priority

# How many nodes a seed, and all seeds of a query, may bring, by pool; by relation, a seed.
PER_SEED = {"related_modality": 3, "context": 2, "routed": 5, "retry": 4}
IN_ALL = {"related_modality": 8, "routed": 20, "retry": 12}
PER_RELATION = {"related_table_node_ids": 5, "related_formula_node_ids": 5, "related_image_node_ids": 3}
ROUTED_MODALITIES = ("text", "table", "formula")
WANTED = {"related_table_node_ids": "table", "related_formula_node_ids": "formula", "related_image_node_ids": "image"}


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Edges (src_id, relation, pos, dst_id) with the place of their relation among a node's relations."""
    place = F.lit(len(RELATIONS))
    for at, name in enumerate(RELATIONS):
        place = F.when(F.col("relation") == name, at).otherwise(place)
    return edges.withColumn("place", place)


def candidates(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, mode: str, reason: str | None, window: int) -> DataFrame:
    """Neighbours that the rules of one edge admit, with the order in which they are tried."""
    seeds = seeds.withColumn("seed_no", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    start = seeds.select("query_id", F.col("node_id").alias("src_id"), F.col("score").alias("seed"), "seed_no", F.coalesce("modality", F.lit("text")).alias("seed_modality"), F.col("doc_id").alias("d"), F.col("page").alias("p"))
    near = nodes.select(F.col("node_id").alias("dst_id"), F.coalesce("modality", F.lit("text")).alias("modality"), "whole_image", "composite", "doc_id", "page")
    found = start.join(ordered_edges(edges), "src_id").join(near.drop("doc_id", "page"), "dst_id").drop("d", "p")
    if mode in ("routed", "retry") and window > 0:
        around = start.where("p is not null").withColumn("page", F.explode(F.sequence(F.col("p") - window, F.col("p") + window))).withColumnRenamed("d", "doc_id")
        of_page = Window.partitionBy("doc_id", "page").orderBy("dst_id")
        pages = near.withColumn("pos", F.row_number().over(of_page))
        pages = around.join(pages, ["doc_id", "page"]).withColumns({"relation": F.lit("page_window"), "place": F.lit(len(RELATIONS) + 1), "pos": F.col("page") * 1_000_000 + F.col("pos")})
        found = found.unionByName(pages.select(found.columns)).repartition("query_id")
    r, m, family = F.col("relation"), F.lit(mode), relation_family(F.col("relation"))
    far = family.isin("page", "structure")
    limit = SEEDS.get(mode, (None, 0))
    rules = allowed_in_mode(r, m, F.lit(reason)) & (
        ((family == "related") & (F.col("seed_modality") == "text") & (F.col("seed_no") <= SEEDS["related"][1]) & (F.col("seed") >= SEEDS["related"][0]))
        | ((family == "context") & (F.col("modality") == "text") & (F.col("seed_no") <= SEEDS["context"][1]) & (F.col("seed") >= SEEDS["context"][0]))
        | (far & F.lit(mode in ("routed", "retry")) & (F.col("seed_no") <= limit[1]) & (F.col("seed") >= F.lit(limit[0])) & (F.lit(mode != "routed") | F.col("modality").isin(*ROUTED_MODALITIES)))
    )
    for name, modality in WANTED.items():
        rules = rules & ((r != name) | (F.col("modality") == modality))
    rules = rules & ~((r == "related_image_node_ids") & F.lit(mode == "auto") & F.coalesce("whole_image", F.lit(False)))
    kept = found.where(rules)
    return kept.select("query_id", "seed_no", "src_id", "place", "pos", "dst_id", "relation", candidate_pool(r, m).alias("pool"), relation_priority(r).alias("priority"), inherited_score(F.col("seed"), r, F.col("composite")).alias("score"))


def expand(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, mode: str = "auto", reason: str | None = None, window: int = 1) -> DataFrame:
    """(query_id, node_id, score, relation, pool, from_node_id, rank): seeds and what their relations bring.

    seeds (query_id, node_id, score, rank, modality, doc_id, page), edges (src_id, relation, pos,
    dst_id), nodes (node_id, doc_id, page, modality, whole_image, composite). Seeds keep their row. A
    node that several relations reach takes the one of the higher priority, then score. One hop: a
    node of the index has no score from which a further hop would be allowed.
    """

    def admit(rows: pd.DataFrame) -> pd.DataFrame:
        taken: dict[str, list] = {}
        brought: dict[str, int] = {}
        by_seed: dict[tuple, int] = {}
        for c in rows.sort_values(["is_candidate", "seed_no", "place", "pos", "dst_id"]).itertuples():
            if not c.is_candidate:
                taken[c.dst_id] = [c.score, None, None, None, 1000]
                continue
            of_seed = by_seed.get((c.seed_no, c.pool), 0)
            full = brought.get(c.pool, 0) >= IN_ALL.get(c.pool, 1 << 30) or of_seed >= PER_SEED.get(c.pool, 1 << 30) or of_seed >= PER_RELATION.get(c.relation, 1 << 30)
            have = taken.get(c.dst_id)
            if full or (have and (have[1] is None or (c.priority, c.score) <= (have[4], have[0]))):
                continue
            if not have:
                brought[c.pool] = brought.get(c.pool, 0) + 1
            taken[c.dst_id] = [c.score, c.relation, c.pool, c.src_id, c.priority]
            by_seed[c.seed_no, c.pool] = of_seed + 1
        query = rows["query_id"].iloc[0]
        return pd.DataFrame([(query, node, *values[:4]) for node, values in taken.items()], columns=["query_id", "node_id", "score", "relation", "pool", "from_node_id"])

    tried = candidates(seeds, edges, nodes, mode, reason, window).withColumn("is_candidate", F.lit(True))
    none = lambda kind: F.lit(None).cast(kind)
    own = seeds.select(
        "query_id", F.lit(0).alias("seed_no"), none("string").alias("src_id"), F.lit(0).alias("place"), F.col("rank").cast("long").alias("pos"), F.col("node_id").alias("dst_id"), none("string").alias("relation"),
        none("string").alias("pool"), F.lit(0).alias("priority"), F.col("score").cast("double").alias("score"), F.lit(False).alias("is_candidate"),
    )
    both = own.unionByName(tried.withColumns({"pos": F.col("pos").cast("long"), "score": F.col("score").cast("double")}))
    kind = seeds.schema["query_id"].dataType.simpleString()
    found = both.groupBy("query_id").applyInPandas(admit, f"query_id {kind}, node_id string, score double, relation string, pool string, from_node_id string")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("relation").isNotNull(), "node_id")
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order))
