"""Reranking with a pluggable scorer, and the prompt context."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from .lexical import ranked
from .metrics import token_overlap


def by_token_f1(pairs: DataFrame) -> DataFrame:
    """Scores of (case_id, prediction, reference): token F1, the offline default."""
    return token_overlap(pairs).select("case_id", F.col("token_f1").alias("rerank_score"))


def rerank(hits: DataFrame, questions: DataFrame, scorer: Callable[[DataFrame], DataFrame] = by_token_f1, s: Settings = DEFAULTS) -> DataFrame:
    """Hits (query_id, node_id, text, rank) with rerank_score, rerank_rank and, if cut, the reason."""
    key = F.to_json(F.struct("query_id", "node_id"))
    pairs = hits.join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    pairs = pairs.select(key.alias("case_id"), F.col("question").alias("prediction"), F.col("text").alias("reference"))
    scored = hits.withColumn("case_id", key).join(scorer(pairs), "case_id", "left").drop("case_id").withColumnRenamed("rank", "previous_rank")
    out = ranked(scored.withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0))), "rerank_score", None, "previous_rank").withColumnRenamed("rank", "rerank_rank")
    reason = F.when(F.col("rerank_rank") > s.rerank_top, "reranker_not_selected").when(F.col("rerank_rank") > s.context_top, "context_top_n_limit")
    return out.withColumn("removed_reason", reason)


def guardrail(hits: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Hits (query_id, node_id, rank, score, shares_anchor) with ``candidate`` and the query's ``top_n``.

    The best hits that share an anchor with the question and reach the least score are candidates;
    the reranker may return as many more hits as there are.
    """
    near = F.coalesce(F.col("shares_anchor"), F.lit(False)) & (F.col("score") >= s.guardrail_score)
    of_query = Window.partitionBy("query_id")
    place = F.row_number().over(of_query.orderBy(F.when(near, 0).otherwise(1), F.desc("score"), "rank"))
    out = hits.withColumn("candidate", near & (place <= s.guardrail_hits))
    widened = F.greatest(F.lit(s.rerank_top), s.context_top + F.count_if("candidate").over(of_query))
    return out.withColumn("top_n", F.least(widened, F.count("*").over(of_query)).cast("int"))


def prompt_context(hits: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, citation, node_id, chars, truncated): hits that fit the character budget, in order.

    Greedy, so each query's few hits are packed in one group. A hit that does not fit is cut if at
    least ``prompt_min_chars`` remain, and ends the context.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = s.prompt_chars, []
        for row in rows.sort_values(["rank", "node_id"]).itertuples():
            n = len(row.text or "")
            if n == 0:
                continue
            take = min(n, left)
            if take < n and take < s.prompt_min_chars:
                break
            out.append((row.query_id, len(out) + 1, row.node_id, take, take < n))
            left -= take
            if take < n:
                break
        return pd.DataFrame(out, columns=["query_id", "citation", "node_id", "chars", "truncated"])

    return hits.select("query_id", "node_id", "rank", "text").groupBy("query_id").applyInPandas(pack, "query_id long, citation int, node_id string, chars long, truncated boolean")
