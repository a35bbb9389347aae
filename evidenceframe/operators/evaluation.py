"""Evaluation of answers and rankings: partial, page and chunk metrics, assertions, judge scores, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_text, safe_div
from ..settings import DEFAULTS, Settings


def _none() -> Column:
    return F.array().cast("array<string>")


def partial_metrics(ranked: DataFrame, k: int = 10) -> DataFrame:
    """hit_rate, mrr and precisions of (query_id, rank, grade); recall, ap and ndcg are unknown, so null."""
    rel = (F.col("grade") > 0).cast("int")
    top = F.col("rank") <= k
    got = ranked.groupBy("query_id").agg(
        F.sum(F.when(top, rel).otherwise(0)).alias("hits"), F.count_if(top).alias("n"), F.min(F.when(top & (F.col("grade") > 0), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= 1, rel).otherwise(0)).alias("h1"), F.sum(F.when(F.col("rank") <= 3, rel).otherwise(0)).alias("h3"),
    )
    r = lambda c: F.round(c, 6)
    unknown = [F.lit(None).cast("double").alias(c) for c in ("recall", "ap", "ndcg")]
    return got.select(
        "query_id", F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"), r(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        r(F.col("h1") / 1.0).alias("precision_at_1"), r(F.col("h3") / 3.0).alias("precision_at_3"), r(F.col("hits") / F.greatest(F.col("n"), F.lit(1))).alias("precision"), *unknown,
    )


def relevant_keys(hits: DataFrame) -> DataFrame:
    """(query_id, node_id): what any stage found relevant, from (query_id, stage, node_id, rank, grade)."""
    return hits.where("grade > 0").select("query_id", "node_id").distinct()


def chunk_recall(hits: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, stage, recall): relevant nodes among the first k over those that any stage found."""
    found = relevant_keys(hits).groupBy("query_id").agg(F.count("*").alias("all"))
    top = hits.groupBy("query_id", "stage").agg(F.count_distinct(F.when((F.col("grade") > 0) & (F.col("rank") <= k), F.col("node_id"))).alias("n"))
    return top.join(found, "query_id", "left").select("query_id", "stage", F.round(safe_div(F.col("n").cast("double"), F.coalesce("all", F.lit(0))), 6).alias("recall"))


def page_specs(specs: DataFrame) -> DataFrame:
    """Distinct (query_id, spec_source, spec_page) of the specifications that state a page."""
    return specs.where("spec_page is not null").select("query_id", F.nullif(F.col("spec_source"), F.lit("")).alias("spec_source"), "spec_page").distinct()


def page_metrics(hits: DataFrame, specs: DataFrame, tolerance: int = 0) -> DataFrame:
    """(query_id, page_hit_rate, page_mrr, page_precision, page_recall) against the pages that are expected.

    hits (query_id, rank, source, page), specs (query_id, spec_source, spec_page). A source matches
    where one contains the other. A returned page is right if one of its hits is. Queries without
    expected pages, or none of whose hits has a page, have nulls; without hits, zeros.
    """
    want = page_specs(specs).withColumn("spec_no", F.row_number().over(Window.partitionBy("query_id").orderBy("spec_page", "spec_source")))
    asked = specs.select("query_id").union(hits.select("query_id")).distinct()
    size = want.groupBy("query_id").agg(F.count("*").alias("expected"))
    a, b = F.regexp_replace(F.lower("source"), r"(?U)[^\w]+", ""), F.regexp_replace(F.lower("spec_source"), r"(?U)[^\w]+", "")
    met = (F.abs(F.col("page") - F.col("spec_page")) <= tolerance) & (F.col("spec_source").isNull() | ((a != "") & (b != "") & (a.contains(b) | b.contains(a))))
    pairs = hits.join(want, "query_id").where(met)
    covered = pairs.groupBy("query_id").agg(F.count_distinct("spec_no").alias("covered"), F.min("rank").alias("first"))
    right = pairs.select("query_id", a.alias("s"), "page").distinct().groupBy("query_id").agg(F.count("*").alias("right"))
    returned = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("page").isNotNull(), F.struct(a.alias("s"), F.col("page")))).alias("pages"))
    out = asked.join(size, "query_id", "left").join(returned, "query_id", "left").join(covered, "query_id", "left").join(right, "query_id", "left")
    judged = F.col("expected").isNotNull() & (F.col("n").isNull() | (F.col("pages") > 0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    value = {
        "page_hit_rate": F.when(zero("covered") > 0, 1.0).otherwise(0.0), "page_mrr": F.coalesce(1.0 / F.col("first"), F.lit(0.0)),
        "page_precision": safe_div(zero("right").cast("double"), zero("pages")), "page_recall": zero("covered") / F.col("expected"),
    }
    return out.select("query_id", *[F.when(judged, F.round(v, 6)).alias(k) for k, v in value.items()])


def keyword_recall(answer: Column, keywords: Column) -> Column:
    """Share of the keywords that the answer holds, both normalised; null without keywords."""
    stated = F.filter(F.coalesce(keywords, _none()), lambda k: F.trim(k) != "")
    clean = lambda x: F.regexp_replace(F.lower(x), r"(?U)[^\p{L}\p{N}_]+", "")
    found = F.filter(stated, lambda k: clean(F.coalesce(answer, F.lit(""))).contains(clean(k)))
    return F.when(F.size(stated) > 0, F.size(found) / F.size(stated))


def source_recall(citations: Column, expected: Column) -> Column:
    """Share of the expected sources that a citation names, either within the other; null without any."""
    clean = lambda x: F.regexp_replace(F.lower(x), r"(?U)[^\p{L}\p{N}_]+", "")
    stated = F.filter(F.coalesce(expected, _none()), lambda s: F.trim(s) != "")
    cited = F.filter(F.transform(F.coalesce(citations, _none()), clean), lambda c: c != "")
    found = F.filter(stated, lambda s: F.exists(cited, lambda c: c.contains(clean(s)) | clean(s).contains(c)))
    return F.when(F.size(stated) > 0, F.size(found) / F.size(stated))


def answer_metrics(cases: DataFrame) -> DataFrame:
    """The metrics of each answer: cases (case_id, prediction, reference, keywords, citations, sources).

    Texts are normalised in compatibility form for the exact match; it is null without a reference.
    """
    same = (normal_text(F.col("prediction")) == normal_text(F.col("reference"))).cast("double")
    return cases.select(
        "case_id", F.length(F.coalesce("prediction", F.lit(""))).alias("answer_chars"), F.size(F.coalesce("citations", _none())).alias("citation_count"),
        (F.size(F.coalesce("citations", _none())) > 0).cast("double").alias("has_citation"), F.when(F.coalesce("reference", F.lit("")) != "", same).alias("exact_match"),
        F.round(keyword_recall(F.col("prediction"), F.col("keywords")), 6).alias("keyword_recall"), F.round(source_recall(F.col("citations"), F.col("sources")), 6).alias("expected_source_recall"),
    )


def judge_scores(raw: DataFrame) -> DataFrame:
    """(case_id, ai_correctness, ai_completeness, ai_relevance, ai_overall, ai_score_100) of a judge's JSON.

    Scores are clipped to 0..1, missing ones are 0. An overall score that is missing is weighted from
    the others.
    """
    kind = "correctness double, completeness double, relevance double, overall double"
    got = raw.select("case_id", F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), kind).alias("j"))
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    a, b, c = (clip(F.col(f"j.{x}")) for x in ("correctness", "completeness", "relevance"))
    overall = F.when(F.col("j.overall").isNotNull(), clip(F.col("j.overall"))).otherwise(F.bround(0.5 * a + 0.3 * b + 0.2 * c, 6))
    return got.select("case_id", a.alias("ai_correctness"), b.alias("ai_completeness"), c.alias("ai_relevance"), overall.alias("ai_overall"), F.bround(overall * 100, 2).alias("ai_score_100"))


def assertions(rows: DataFrame) -> DataFrame:
    """(case_id, passed, failures): regression checks of a result against its case.

    rows: answer, expected_keywords, keywords_mode (any or all), forbidden_keywords, citations,
    expected_sources, route, expected_route, gate_decision, expected_gate, support_score,
    min_support_score, retry_count, max_retry_count, refusal, should_refuse, uncertain_text. A null
    expectation is no check.
    """
    low = F.lower(F.coalesce("answer", F.lit("")))
    named = lambda c: F.filter(F.coalesce(c, _none()), lambda k: k != "")
    want = named("expected_keywords")
    missing = F.filter(want, lambda k: ~low.contains(F.lower(k)))
    refused = F.coalesce("refusal", F.lit(False)) | F.coalesce(F.col("gate_decision") == "refuse", F.lit(False))
    refused = refused | F.coalesce((F.col("uncertain_text") != "") & (F.trim("answer") == F.trim("uncertain_text")), F.lit(False))
    differs = lambda have, wanted: F.col(wanted).isNotNull() & ~F.col(have).eqNullSafe(F.col(wanted))
    support, retries = F.coalesce("support_score", F.lit(0.0)), F.coalesce("retry_count", F.lit(0))
    checks = {
        "missing_any_expected_answer_keyword": (F.col("keywords_mode") == "any") & (F.size(want) > 0) & (F.size(missing) == F.size(want)),
        "missing_expected_answer_keywords": ~F.coalesce(F.col("keywords_mode") == "any", F.lit(False)) & (F.size(missing) > 0),
        "forbidden_answer_keywords": F.exists(named("forbidden_keywords"), lambda k: low.contains(F.lower(k))),
        "missing_citation_sources": F.size(F.array_except(F.coalesce("expected_sources", _none()), F.coalesce("citations", _none()))) > 0,
        "route_mismatch": differs("route", "expected_route"), "gate_decision_mismatch": differs("gate_decision", "expected_gate"),
        "refusal_expected_but_not_observed": F.col("should_refuse") & ~refused, "refusal_not_expected_but_observed": ~F.col("should_refuse") & refused,
        "support_score_too_low": support < F.col("min_support_score"), "retry_count_too_high": retries > F.col("max_retry_count"),
    }
    out = rows.select("case_id", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()])).alias("failures"))
    return out.withColumn("passed", F.size("failures") == 0)


def chunk_summary(hits: DataFrame, top: int = 10) -> DataFrame:
    """(stage, chunks, relevant_chunks): distinct nodes among the first of each query, over all queries."""
    first = hits.where(F.col("rank") <= top)
    return first.groupBy("stage").agg(F.count_distinct("node_id").alias("chunks"), F.count_distinct(F.when(F.col("grade") > 0, F.col("node_id"))).alias("relevant_chunks"))


def stage_summary(hits: DataFrame) -> DataFrame:
    """(query_id, stage, total, relevant, top1): how many hits, how many right, whether the first is."""
    right = F.col("grade") > 0
    return hits.groupBy("query_id", "stage").agg(F.count("*").alias("total"), F.count_if(right).alias("relevant"), F.coalesce(F.bool_or(right & (F.col("rank") == 1)), F.lit(False)).alias("top1"))


def report(records: DataFrame, names: list[str]) -> DataFrame:
    """(stage, metric, value, n): the mean of each metric by stage, over the records that have it."""
    cols = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names]
    long = records.select("stage", F.explode(F.array(*cols)).alias("x")).select("stage", "x.*")
    return long.groupBy("stage", "metric").agg(F.round(F.avg("v"), 6).alias("value"), F.count("v").alias("n"))


def objective(rerank_p1: Column, rerank_p3: Column, final_p1: Column, final_hit_rate: Column, ai_score: Column) -> Column:
    """The weighted sum that tuning maximises; what is missing counts as 0."""
    parts = [(rerank_p1, 0.30), (rerank_p3, 0.20), (final_p1, 0.20), (final_hit_rate, 0.10), (ai_score / 100.0, 0.20)]
    return sum((F.coalesce(v, F.lit(0.0)) * w for v, w in parts), F.lit(0.0))


def carry_select(reranked: DataFrame, expanded: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Hits that a retry carries forward: reranked ones first, then expanded ones, ``carry_top`` at most.

    Hits (query_id, node_id, rank, score, label, dropped). A hit must reach the least score and
    label, and not be dropped; of a node the first that does counts.
    """
    stacked = reranked.withColumn("at", F.lit(0)).unionByName(expanded.withColumn("at", F.lit(1)))
    good = stacked.where(~F.coalesce("dropped", F.lit(False)) & (F.col("score") >= s.carry_score) & F.lower(F.trim("label")).isin("relevant", "strong"))
    first = good.groupBy("query_id", "node_id").agg(F.min(F.struct("at", "rank", "score")).alias("h")).select("query_id", "node_id", "h.*")
    w = Window.partitionBy("query_id").orderBy("at", "rank", "node_id")
    chosen = first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= s.carry_top)
    return chosen.select("query_id", "node_id", F.when(F.col("at") == 0, "rerank").otherwise("expanded").alias("from_stage"), F.col("rank").alias("previous_rank"), "score", "place")


def supporting(hits: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, node_ids): the first distinct nodes in rank order."""
    first = hits.groupBy("query_id", "node_id").agg(F.min("rank").alias("rank"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x.node_id)
    return first.groupBy("query_id").agg(F.slice(ordered, 1, most).alias("node_ids"))


def citations_hold(citations: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, cited, wrong, citation_ok): whether every citation (query_id, source, chunk_index) is in the context.

    A query without citations is not ok.
    """
    known = context.select("query_id", "source", "chunk_index").distinct().withColumn("there", F.lit(1))
    got = citations.join(known, ["query_id", "source", "chunk_index"], "left").groupBy("query_id").agg(F.count("*").alias("cited"), F.count_if(F.col("there").isNull()).alias("wrong"))
    asked = context.select("query_id").union(citations.select("query_id")).distinct()
    out = asked.join(got, "query_id", "left").na.fill(0, ["cited", "wrong"])
    return out.withColumn("citation_ok", (F.col("cited") > 0) & (F.col("wrong") == 0))
