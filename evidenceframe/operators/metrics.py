"""Ranking, token, keyword and region metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import area, intersection, iou, union_area
from ..functions.text import mixed_tokens, safe_div


def ranking_metrics(ranked: DataFrame, totals: DataFrame, k: int = 10) -> DataFrame:
    """Per query, from (query_id, rank, grade) and (query_id, relevant, ideal array of grades).

    hit_rate, mrr, precision at 1, 3 and over what was returned, recall, ap and ndcg.
    """
    top = ranked.where(F.col("rank") <= k).withColumn("rel", (F.col("grade") > 0).cast("int"))
    run = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    top = top.withColumn("p", F.when(F.col("rel") == 1, run / F.col("rank")).otherwise(0.0))
    sums = top.groupBy("query_id").agg(
        F.sum("rel").alias("hits"), F.count("*").alias("returned"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= 1, F.col("rel")).otherwise(0)).alias("h1"), F.sum(F.when(F.col("rank") <= 3, F.col("rel")).otherwise(0)).alias("h3"),
        F.sum("p").alias("ps"), F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    best = F.slice(F.sort_array("ideal", asc=False), 1, k)
    ideal = F.aggregate(F.transform(best, lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    out = totals.join(sums, "query_id", "left").na.fill(0, ["hits", "returned", "h1", "h3"]).na.fill(0.0, ["ps", "dcg"])
    r = lambda c: F.round(c, 6)
    return out.select(
        "query_id", F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"), r(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        r(F.col("h1") / 1.0).alias("precision_at_1"), r(F.col("h3") / 3.0).alias("precision_at_3"), r(F.col("hits") / F.greatest(F.col("returned"), F.lit(1))).alias("precision"),
        r(safe_div(F.col("hits").cast("double"), F.col("relevant"))).alias("recall"), r(F.col("ps") / F.least(F.greatest(F.col("relevant"), F.lit(1)), F.lit(k))).alias("ap"),
        r(safe_div(F.col("dcg"), ideal)).alias("ndcg"),
    )


def token_overlap(pairs: DataFrame, left: str = "prediction", right: str = "reference") -> DataFrame:
    """(case_id, token_precision, token_recall, token_f1) of the multisets of tokens of two columns.

    A pair is one row, so the common tokens are counted there: both lists are sorted by token and
    number of repetition, and what they have in common is their intersection. Two empty texts agree.
    """
    numbered = lambda c: F.transform(c, lambda t, i: F.concat(t, F.lit("#"), (i - F.array_position(c, t)).cast("string")))
    rows = pairs.select("case_id", F.array_sort(mixed_tokens(F.col(left))).alias("l"), F.array_sort(mixed_tokens(F.col(right))).alias("r"))
    both = F.size(F.array_intersect(numbered(F.col("l")), numbered(F.col("r")))).cast("double")
    rows = rows.select("case_id", F.size("l").alias("nl"), F.size("r").alias("nr"), both.alias("both"))
    empty = (F.col("nl") == 0) & (F.col("nr") == 0)
    p = F.when(empty, 1.0).otherwise(safe_div(F.col("both"), F.col("nl")))
    q = F.when(empty, 1.0).otherwise(safe_div(F.col("both"), F.col("nr")))
    return rows.select("case_id", F.round(p, 6).alias("token_precision"), F.round(q, 6).alias("token_recall"), F.round(safe_div(2 * p * q, p + q), 6).alias("token_f1"))


def region_metrics(hits: DataFrame, regions: DataFrame, relevant: float = 0.5, counted: float = 0.1) -> DataFrame:
    """Per case: best IoU, precision over hits above ``counted``, whether any is above ``relevant``.

    hits (case_id, hit_id, page, box) meet regions (case_id, page, box) of the same page only.
    """
    best = hits.join(regions.select("case_id", "page", F.col("box").alias("region")), ["case_id", "page"], "left")
    best = best.groupBy("case_id", "hit_id").agg(F.max(F.coalesce(iou(F.col("box"), F.col("region")), F.lit(0.0))).alias("v"))
    return best.groupBy("case_id").agg(
        F.count("*").alias("n_hits"), F.round(F.max("v"), 6).alias("max_iou"), F.round(F.avg((F.col("v") > counted).cast("double")), 6).alias("bbox_precision"),
        F.max(F.col("v") > relevant).alias("relevant"),
    )


def region_areas(hits: DataFrame, regions: DataFrame, counted: float = 0.1) -> DataFrame:
    """Per case: hit rate, best IoU, precision over hits above ``counted``, recall by area, and F1.

    hits (case_id, hit_id, page, box) meet regions (case_id, region_id, page, box) of the same page
    only. Recall is the area of the regions that hits cover, each point once a region, over their
    whole area. The area metrics are the same three values, as in the reference. Boxes outside the
    0..1000 range do not count; a case without regions, or without hits, has nulls.
    """
    hits = hits.withColumn("box", _ordered(F.col("box"))).where("box is not null")
    specs = regions.select("case_id", "region_id", "page", _ordered(F.col("box")).alias("region"))
    pairs = specs.where("region is not null").join(hits, ["case_id", "page"])
    best = hits.select("case_id", "hit_id").distinct().join(
        pairs.groupBy("case_id", "hit_id").agg(F.max(iou(F.col("box"), F.col("region"))).alias("v")), ["case_id", "hit_id"], "left"
    )
    best = best.groupBy("case_id").agg(F.max(F.coalesce("v", F.lit(0.0))).alias("most"), F.avg((F.coalesce("v", F.lit(0.0)) > counted).cast("double")).alias("p"))
    met = pairs.groupBy("case_id", "region_id").agg(F.collect_list(intersection(F.col("box"), F.col("region"))).alias("common"))
    whole = area(F.col("region"))
    covered = specs.join(met, ["case_id", "region_id"], "left").withColumn("covered", F.when(whole > 0, F.least(F.coalesce(union_area(F.col("common")), F.lit(0.0)), whole)))
    sums = covered.groupBy("case_id").agg(F.sum("covered").alias("covered"), F.sum(F.when(whole > 0, whole)).alias("expected"))
    out = sums.withColumn("specs", F.lit(1)).join(best, "case_id", "full")
    judged = F.col("specs").isNotNull() & F.col("most").isNotNull()
    r = F.when(F.col("expected") > 0, F.col("covered") / F.col("expected"))
    f1 = F.when(r.isNotNull() & (F.col("p") + r > 0), 2 * F.col("p") * r / (F.col("p") + r)).otherwise(0.0)
    values = {"bbox_hit_rate": F.when(F.col("covered") > 0, 1.0).otherwise(0.0), "bbox_precision": F.col("p"), "bbox_recall": r, "bbox_f1": f1}
    values |= {"bbox_area_precision": F.col("p"), "bbox_area_recall": r, "bbox_area_f1": f1, "bbox_max_iou": F.col("most")}
    return out.select("case_id", *[F.when(judged, F.round(v, 6)).alias(k) for k, v in values.items()])


def _ordered(box: Column) -> Column:
    """A box with its corners in order, in the 0..1000 range, else null."""
    b = F.array(F.least(box[0], box[2]), F.least(box[1], box[3]), F.greatest(box[0], box[2]), F.greatest(box[1], box[3]))
    most = F.array_max(F.transform(b, F.abs))
    return F.when(most <= 1, F.transform(b, lambda x: x * 1000)).when(most <= 1000, b)


def summary(records: DataFrame, *names: str) -> DataFrame:
    """(metric, value, n): mean of each metric over the records that have it."""
    cols = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names]
    long = records.select(F.explode(F.array(*cols)).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("value"), F.count("v").alias("n"))


def rank_flow(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each hit (query_id, node_id, rank) between two stages."""
    out = before.select("query_id", "node_id", F.col("rank").alias("rank_before")).join(after.select("query_id", "node_id", F.col("rank").alias("rank_after")), ["query_id", "node_id"], "full")
    b, a = F.col("rank_before"), F.col("rank_after")
    status = F.when(b.isNull(), "new").when(a.isNull(), "dropped").when(a < b, "promoted").when(a > b, "demoted").otherwise("kept")
    return out.withColumn("status", status)
